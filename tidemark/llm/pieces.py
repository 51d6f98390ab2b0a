"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces drives a single-pass
Viterbi: at each position every piece that ends there (the state's outputs)
relaxes the best score. Characters that no piece covers become their UTF-8
bytes. Spaces are written as U+2581 and one more is put in front; a U+2581 of
the text itself becomes bytes, so that decoding gives every text back exactly.

No piece runs across the start of a run of U+2581, so a text falls into
stretches whose best paths don't depend on each other; a task remembers the
paths of stretches it has met.

Null and empty texts have no pieces; every row gives one row.
"""

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How much worse than the worst piece a character is that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Stretches that a task remembers, in each of two generations.
REMEMBERED = 300_000


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in plain}
        if all(s <= 0 and s == int(s) for s in raw.values()):
            # a merge list gives ranks, not log-probabilities: Zipf's law makes them such
            total = np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
            raw = {i: -float(np.log(1 - s) + total) for i, s in raw.items()}
        self.score = raw
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.floor = min(raw.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), raw[i], i))
        self.automaton.make_automaton()
        inner = [p for i in plain if MARK in (p := self.pieces[i]).lstrip(MARK)]
        breaks = "".join(c for c in "\n" if not any(c in self.pieces[i] for i in plain))
        self.stretch = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|[{breaks}]" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else re.compile("(?s).+")
        self.single = frozenset(self.pieces[i] for i in plain if len(self.pieces[i]) == 1)
        self.by_words = not inner and bool(breaks)
        self.out = [b""] * n
        for i in plain:
            self.out[i] = self.pieces[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])

    def best_path(self, text: str) -> list[int]:
        """Piece ids of the best-scoring segmentation; of equal ones, the one whose last piece is longest, and so on backwards."""
        n = len(text)
        score = [-1e300] * (n + 1)
        score[0] = 0.0
        size_at, id_at = [1] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(text):  # some piece ends everywhere
            for end, (size, s, i) in self.automaton.iter(text):
                s += score[end + 1 - size]
                if s > score[end + 1]:
                    score[end + 1] = s
                    size_at[end + 1] = size
                    id_at[end + 1] = i
        else:
            reached = 0
            for end, (size, s, i) in self.automaton.iter(text):
                for at in range(reached + 1, end + 2):
                    score[at] = score[at - 1] + self.floor
                reached = end + 1
                s += score[end + 1 - size]
                if s > score[end + 1] or s == score[end + 1] and size > size_at[end + 1]:
                    score[end + 1] = s
                    size_at[end + 1] = size
                    id_at[end + 1] = i
        ids: list[int] = []
        while n:
            i = id_at[n]
            if i >= 0:
                ids.append(i)
            else:
                ids += self.fallback(text[n - 1])
            n -= size_at[n]
        return ids[::-1]

    def fallback(self, c: str) -> list[int]:
        """A character's bytes, last first; the unknown piece where the model has no byte pieces."""
        return [self.bytes[b] for b in reversed(c.encode("utf-8", "surrogatepass"))] if len(self.bytes) == 256 else [self.unknown]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, and remembers the paths of stretches: in ``new`` by a word that follows one space, or by a line feed and the word that follows it."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missed(self, s: str) -> bytes:
        got = self.new.get(s) or self.old.get(s)
        if got is None:
            path = self.vocab.best_path
            got = np.array(path("\n") + path(s[1:]) if s.startswith("\n") else path(MARK + s), np.int32).tobytes()
        if len(s) <= 64:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if MARK not in text:
            return self.marked(text)
        mark = np.array(self.vocab.fallback(MARK)[::-1], np.int32)
        parts = text.split(MARK)
        out = [self.marked(parts[0])]
        for p in parts[1:]:
            out += [mark, self.stretches(p.replace(" ", MARK))]
        return np.concatenate(out)

    def stretches(self, marked: str) -> np.ndarray:
        return np.array([i for s in self.vocab.stretch.findall(marked) for i in self.vocab.best_path(s)], np.int32)

    def marked(self, text: str) -> np.ndarray:
        """A space is put before the text."""
        if not self.vocab.by_words:
            return self.stretches(MARK + text.replace(" ", MARK))
        out: list[bytes | None] = []
        front = ""
        for line in text.split("\n"):
            if "  " in line or line[:1] == " " or line[-1:] == " ":  # runs of spaces, and spaces next to a line's end
                out.append(self.stretches(("\n" if front else MARK) + line.replace(" ", MARK)).tobytes())
            else:
                found = line.split(" ")
                found[0] = front + found[0]
                got = list(map(self.new.get, found))
                if None in got:
                    got = [x if x is not None else self.missed(s) for s, x in zip(found, got, strict=True)]
                out += got
            front = "\n"
        return np.frombuffer(b"".join(out), np.int32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def decode_ids(ids: np.ndarray | list[int], vocab: Vocabulary) -> str:
    """The text of piece ids, without the space put in front."""
    return b"".join(map(vocab.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding the ids gives the text back."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)

        def made(keys: list, rows: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
            sizes = [len(r) for r in rows]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array(sizes, pa.int64()), pa.array(same)], schema=schema)

        for b in batches:
            keys, rows, same, size = [], [], [], 0
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                ids = enc.encode(text)
                keys.append(key)
                rows.append(ids)
                same.append(decode_ids(ids, enc.vocab) == text)
                size += len(ids)
                if size > 1_000_000:
                    yield made(keys, rows, same)
                    keys, rows, same, size = [], [], [], 0
            if keys:
                yield made(keys, rows, same)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, exact boolean")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for b in batches:
            texts = [decode_ids(ids or [], vocab) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
