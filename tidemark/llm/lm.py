"""Language-model scoring by deleted interpolation.

Tokens are lower-cased (A-Z) words and one end per text. Unigrams and bigrams
are counted over every word of every training text; the word before a text's
first is the end. The bigram, unigram and uniform estimates are mixed with
weights that depend on how often the context was seen (one bucket per power of
two); the weights are learned by expectation-maximisation on training texts
held out of the counts, after which the counts are taken over all training
texts.

What is broadcast is bounded whatever the corpus: the words, and the bigrams,
that make up at least ``1 / 2**18`` of the training tokens (at most 2**18 of
each). All other bigrams are dealt out by their rarer words, many packed in one
row, and meet those words' counts there. The weights are learned from sums over
bins of an eighth of an octave of both estimates, each at its bin's mean.

Words are keyed by 64 bits of a hash, and by 63 where they meet as parts of
bigrams, so two of n words share a key with a probability of about n**2 / 2**64
(5e-8 for a million different words); such words would be counted as one.

Null and empty texts have one token, the end. Without training texts every
count is zero. Each input row gives one row, repeated ones too; other columns
play no part.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import LOWER, U64, chunks, crc_mod, cut, grouped, mix, release, word_hashes, words

FREQUENT = 2**18
#: Key of the end of a text among the word hashes.
END = np.int64(0)


def _keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (never END), and the first word of each document."""
    low = LOWER[buf]
    starts, ends, first = words(low, off)
    h = word_hashes(low, starts, ends).view(np.int64)
    h[h == END] = 1
    return h, first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at, axis=0)


def unigram_counts(train: DataFrame, most: int = 1_500_000) -> DataFrame:
    """key, c, held: how often each word, and the end, stand in the texts, and in those held out (column ``held``). Each task adds up what it can before the shuffle."""
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("held", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                k, c = _summed(keys, counts)
                for i in range(0, len(k), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (k, c[:, 0].copy(), c[:, 1].copy())], schema=schema)

        for b in batches:
            for part, buf, off in chunks(b):
                h, first = _keys(buf, off)
                apart = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                k, at, c = np.unique(h, return_inverse=True, return_counts=True)
                keys += [k, np.array([END])]
                counts += [np.stack([c, np.bincount(at, np.repeat(apart, np.diff(first)), len(k)).astype(np.int64)], axis=1), np.array([[part.num_rows, apart.sum()]])]
                held += len(k) + 1
                if held > most:
                    k, c = _summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > most // 2:
                        yield from out()
                        keys, counts, held = [], [], 0
        yield from out()

    rows = train.select(F.col("text").cast("string"), F.col("held")).mapInArrow(run, "key long, c long, held long")
    return rows.groupBy("key").agg(F.sum("c").alias("c"), F.sum("held").alias("held"))


def _weights(bucket: np.ndarray, c: np.ndarray, f: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of each bucket, from held-out counts c of rows with estimates f, by expectation-maximisation."""
    weights = np.full((64, 3), 1 / 3)
    weights[0] = [0.0, 0.5, 0.5]
    for _ in range(rounds):
        part = weights[bucket] * f
        part *= (c / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, j], 64) for j in range(3)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, new / np.maximum(total, 1e-300), weights)
    return np.maximum(weights, [0.0, 0.0, 1e-6]) / np.maximum(weights, [0.0, 0.0, 1e-6]).sum(axis=1, keepdims=True)


def interpolation_weights(main: np.ndarray, held: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the bigram, unigram and uniform estimates for each bucket of context counts, by expectation-maximisation on held-out counts. Buckets without held-out counts keep equal weights; contexts never seen give the bigram none."""
    classes = main.shape[0]
    context = main.sum(axis=1)
    unigram = main.sum(axis=0) / max(1, main.sum())
    u, w = np.nonzero(held)
    c = held[u, w].astype(np.float64)
    bucket = buckets(context)
    f = np.stack([main[u, w] / np.maximum(1, context[u]), unigram[w], np.full(len(u), 1 / classes)], axis=1)
    return _weights(bucket[u], c, f, rounds)


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the count's power of two."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(1, context))), 0).astype(np.int64)


def log_table(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of each symbol (column) after each context (row)."""
    context = counts.sum(axis=1)
    mix = weights[buckets(context)].astype(np.float64)
    p = counts * (mix[:, 0] / np.maximum(1, context))[:, None]
    p += mix[:, 1, None] * (counts.sum(axis=0) / max(1, counts.sum()))[None, :]
    p += mix[:, 2, None] / counts.shape[0]
    # without any count the uniform estimate is all there is
    if not counts.sum():
        p[:] = 1 / counts.shape[0]
    return np.log10(p).astype(np.float32)


class Places:
    """Where each of some distinct values in order is, or -1, by a slot for each of their hashes; values that share a slot are searched for."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        bits = max(1, (16 * len(values)).bit_length())
        self.down = U64(64 - bits)
        slot = self._slot(values)
        self.at = np.full(1 << bits, -1, np.int32)
        self.at[slot] = np.arange(len(values), dtype=np.int32)
        self.shared = np.zeros(1 << bits, bool)
        self.shared[slot[self.at[slot] != np.arange(len(values))]] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * U64(0x9E3779B97F4A7C15)) >> self.down

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.full(len(x), -1)
        slot = self._slot(x)
        at = self.at[slot].astype(np.int64)
        at[self.values[at] != x] = -1
        more = np.flatnonzero(self.shared[slot] & (at < 0))
        if len(more):
            k = np.minimum(np.searchsorted(self.values, x[more]), len(self.values) - 1)
            at[more] = np.where(self.values[k] == x[more], k, -1)
        return at


class Model:
    """What scoring needs besides the counts of rare words and pairs. Words are coded: the end 0, frequent ones by their place from 1 on, rare ones by their hash with the sign bit set."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, held: np.ndarray, ends: tuple[int, int], tokens: int, tokens_held: int, distinct: int, parts: int) -> None:
        self.keys, self.tokens, self.tokens_held, self.distinct, self.parts = keys, tokens, tokens_held, distinct, parts
        self.counts = np.concatenate([[ends[0]], counts])
        self.main = self.counts - np.concatenate([[ends[1]], held])
        self.weights = np.zeros((64, 3))
        #: pairs that are frequent: a * 2**20 + b, in order, and their log-probabilities
        self.pairs, self.pair_logs = np.zeros(0, np.int64), np.zeros(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, Places)}

    def places(self, name: str) -> "Places":
        """Where the values of an attribute are, built where it is first asked for."""
        values, known = getattr(self, name), self.__dict__.get(name + "_at")
        if known is None or known.values is not values:
            known = self.__dict__[name + "_at"] = Places(values)
        return known

    def code(self, h: np.ndarray) -> np.ndarray:
        at = self.places("keys").of(h)
        return np.where(at >= 0, at + 1, h | RARE)

    def log_probability(self, cab: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.full(len(cab), -np.log10(self.distinct + 1))
        w = self.weights[buckets(ca)]
        return np.log10(w[:, 0] * cab / np.maximum(1, ca) + w[:, 1] * cb / self.tokens + w[:, 2] / (self.distinct + 1))


RARE = np.int64(-(2**63))
#: Rows of packed columns: counts of rare words (key, c, held); pairs (a, b, x, y); the first word's counts for pairs of two rare words (a, b, c, main); what the tables tell about whole texts.
WORDS, PAIRS, BOTH, WHOLE = range(4)
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_PACKED_DDL = "bucket int, kind int, data binary"
FLUSH = 2_000_000


def _pack(columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, byte by place, compressed."""
    k, n = columns.shape
    raw = np.ascontiguousarray(np.ascontiguousarray(columns, "<i8").view(np.uint8).reshape(k, n, 8).transpose(0, 2, 1)).tobytes()
    return n.to_bytes(4, "little") + k.to_bytes(1, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    raw = pa.Codec("zstd").decompress(data[5:], n * k * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k, 8, n).transpose(0, 2, 1)).view("<i8").reshape(k, n)


def _spread(key: np.ndarray) -> np.ndarray:
    return mix(key.view(np.uint64))


def _new(p: np.ndarray) -> np.ndarray:
    """Where the first two columns differ from the row before."""
    new = np.ones(p.shape[1], bool)
    new[1:] = (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])
    return new


def _rows(kind: int, home: np.ndarray, columns: np.ndarray, parts: int, combine: bool = False) -> Iterator[pa.RecordBatch]:
    """One packed row per bucket, in order of the first two columns as far as the key's bits reach. Combine: equal pairs that meet are added up."""
    bucket = home % U64(parts)
    a, b = columns[:2].view(np.uint64)
    far = U64(63)  # set in rare words
    inner = np.where(a >> far, (a & U64(2**64 - 2**29)) | ((b & U64(0xFFFFF)) << U64(9)), (a << U64(43)) | np.where(b >> far, b >> U64(21), b << U64(23)))
    bits = U64(max(1, (parts - 1).bit_length()))
    order = np.argsort((bucket << (U64(64) - bits)) | (inner >> bits))
    bucket, columns = bucket[order].astype(np.int64), columns[:, order]
    if combine and len(bucket):
        at = np.flatnonzero(_new(columns))
        bucket, columns = bucket[at], np.concatenate([columns[:2, at], np.add.reduceat(columns[2:], at, axis=1)])
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    ends = [*at[1:], len(bucket)] if len(bucket) else []
    for i in range(0, len(at), 500):
        some = list(zip(at[i : i + 500], ends[i : i + 500], strict=True))
        data = [_pack(columns[:, x:y]) for x, y in some]
        yield pa.RecordBatch.from_arrays([pa.array([bucket[x] for x, _ in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array(data, pa.binary())], schema=_PACKED)


def _home(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs go to where the second word's count is if that is rare, else to the first one's, else are dealt by both."""
    return _spread(np.where(b < 0, b, np.where(a < 0, a, a * (1 << 20) + b)))


def _distinct(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns with equal pairs of the first two together, and where each new pair of these starts."""
    key = mix(_spread(p[0]) + p[1].view(np.uint64))
    order = np.argsort(key)
    key, q = key[order], p[:, order]
    new = _new(q)
    if (new[1:] & (key[1:] == key[:-1])).any():  # two pairs of one key
        q = p[:, np.lexsort((p[1], p[0]))]
        new = _new(q)
    return q, np.flatnonzero(new)


def _pairs(docs: DataFrame, shared, what: str) -> DataFrame:
    """Packed pairs of the texts (row, doc_id, text, fold). "count": x and y are main and held-out counts. "score": each place is one, x and y are row and fold, and there is what is known of whole texts. "rare": only those of two rare words, at the first one's home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        log_counts = np.log10(model.counts + 0.1)
        kept: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if kept:
                p = np.concatenate(kept, axis=1)
                kept.clear()
                yield from _rows(PAIRS, _spread(p[0]) if what == "rare" else _home(p[0], p[1]), p, model.parts, what != "score")

        for batch in batches:
            for part, buf, off in chunks(batch):
                h, first = _keys(buf, off)
                n = np.diff(first) + 1
                s = np.insert(model.code(h), first[1:], 0)
                before = np.concatenate([[0], s[:-1]])
                doc = np.repeat(np.arange(part.num_rows), n)
                fold = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                if what == "score":
                    rows = part.column(0).to_numpy(zero_copy_only=False)
                    known = s >= 0
                    base = np.bincount(doc[known], log_counts[s[known]], part.num_rows)
                    n_known = np.bincount(doc[known], model.counts[s[known]] > 0, part.num_rows).astype(np.int64)
                    lm = np.zeros(part.num_rows)
                    if len(model.pairs):
                        key = np.where(known & (before >= 0), before * (1 << 20) + s, -1)
                        at = model.places("pairs").of(key)
                        there = at >= 0
                        lm = np.bincount(doc[there], model.pair_logs[at[there]], part.num_rows)
                        before, s, doc, fold = before[~there], s[~there], doc[~there], fold[~there]
                    ids = part.column(1)
                    whole = np.stack([rows, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n, n_known, base.view(np.int64), lm.view(np.int64)])
                    yield from _rows(WHOLE, np.full(part.num_rows, _spread(rows[:1])[0]), whole, model.parts)
                    kept.append(np.stack([before, s, rows[doc], fold]))
                else:
                    p = np.stack([before, s, fold == 0, fold == 1])
                    kept.append(p[:, (before < 0) & (s < 0)] if what == "rare" else p)
                held += kept[-1].shape[1]
                if held > FLUSH:
                    yield from out()
                    kept, held = [], 0
        yield from out()

    return docs.mapInArrow(run, _PACKED_DDL)


def _word_rows(rare: DataFrame, parts: int) -> DataFrame:
    """Packed counts of rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, c, held = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            yield from _rows(WORDS, _spread(k | RARE), np.stack([k | RARE, c, held]), parts)

    return rare.select("key", "c", "held").mapInArrow(run, _PACKED_DDL)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | None]]:
    """The columns of each kind, bucket by bucket."""
    for t in grouped(batches, ["bucket"]):
        bucket = t.column("bucket").to_numpy()
        at = [0, *(1 + np.flatnonzero(bucket[1:] != bucket[:-1])), len(bucket)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            if i == j:
                continue
            g = t.slice(i, j - i)
            got: list[list[np.ndarray]] = [[], [], [], []]
            for kind, data in zip(g.column("kind").to_pylist(), g.column("data"), strict=True):
                got[kind].append(_unpack(data.as_py()))
            yield [np.concatenate(x, axis=1) if x else None for x in got]


class _Counts:
    """Counts of the rare words of a bucket."""

    def __init__(self, words: np.ndarray | None) -> None:
        w = np.zeros((3, 0), np.int64) if words is None else words
        self.key, self.c, self.held = w[:, np.argsort(w[0])]

    def of(self, model: Model, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All and main counts of coded words."""
        c, main = (np.where(code >= 0, x[np.maximum(code, 0)], 0) for x in (model.counts, model.main))
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, code), len(self.key) - 1)
            here = self.key[at] == code
            c[here], main[here] = self.c[at[here]], self.c[at[here]] - self.held[at[here]]
        return c, main


def _dealt(packed: DataFrame, run, schema: str) -> DataFrame:
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _both(docs: DataFrame, words_: DataFrame, shared) -> DataFrame:
    """Packed counts of the first words of pairs of two rare words, to go to the second ones' home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for group in _groups(batches):
            if group[PAIRS] is not None:
                p, at = _distinct(group[PAIRS])
                a, b = p[:2, at]
                yield from _rows(BOTH, _spread(b), np.stack([a, b, *_Counts(group[WORDS]).of(model, a)]), model.parts)

    return _dealt(_pairs(docs, shared, "rare").unionByName(words_), run, _PACKED_DDL)


def _together(model: Model, group: list[np.ndarray | None]) -> tuple[np.ndarray, ...]:
    """a, b, x, y of a bucket's pairs, equal ones together; the pairs' first places; all and main counts of a, and of b."""
    counts = _Counts(group[WORDS])
    p, at = _distinct(np.zeros((4, 0), np.int64) if group[PAIRS] is None else group[PAIRS])
    a, b = p[:2, at]
    ca, ma = counts.of(model, a)
    if (two := group[BOTH]) is not None:
        # every pair of two rare words is among these once: after sorting, each is followed by its place in p
        k = np.flatnonzero((a < 0) & (b < 0))
        every = np.concatenate([np.concatenate([two, np.full((1, two.shape[1]), -1)]), np.stack([a[k], b[k], ca[k], ma[k], k])], axis=1)
        every = every[:, np.lexsort((every[4], every[1], every[0]))]
        at_ = np.flatnonzero(every[4] >= 0)
        ca[every[4, at_]], ma[every[4, at_]] = every[2, at_ - 1], every[3, at_ - 1]
    return p, at, ca, ma, *counts.of(model, b)


def _bins(packed: DataFrame, shared) -> DataFrame:
    """Sums over pairs with held-out counts, by the context's bucket and both estimates' bins (context, p, q, c, f, g); and the frequent pairs (context -1: p, q the words, c the count)."""
    schema = pa.schema([("context", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("c", pa.int64()), ("f", pa.float64()), ("g", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for group in _groups(batches):
            p, at, _, ma, _, mb = _together(model, group)
            if not len(at):
                continue
            main, held = np.add.reduceat(p[2], at), np.add.reduceat(p[3], at)
            f, g = main / np.maximum(1, ma), mb / max(1, model.tokens - model.tokens_held)
            bins = [np.where(x > 0, np.floor(8 * np.log2(np.maximum(x, 1e-300))), 1).astype(np.int64) for x in (f, g)]
            k = held > 0
            key, inverse = np.unique(np.stack([buckets(ma), *bins])[:, k], axis=1, return_inverse=True)
            sums = [np.bincount(inverse.ravel(), w, key.shape[1]) for w in (held[k], held[k] * f[k], held[k] * g[k])]
            top = (main + held) * FREQUENT >= max(1, model.tokens)
            a, b, c = p[0, at[top]], p[1, at[top]], (main + held)[top]
            none = np.zeros(len(c))
            columns = [np.concatenate(x) for x in ((key[0], np.full(len(c), -1)), (key[1], a), (key[2], b), (sums[0].astype(np.int64), c), (sums[1], none), (sums[2], none))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    got = _dealt(packed, run, "context long, p long, q long, c long, f double, g double")
    return got.groupBy("context", "p", "q").agg(*(F.sum(x).alias(x) for x in "cfg"))


def vocabulary(counts: DataFrame, parts: int = 0) -> Model:
    """A model that knows the words, from the training texts' unigram counts. Parts: how many groups of pairs; by default about 500,000 tokens each."""
    end = F.col("key") == int(END)
    total = counts.agg(F.sum("c"), F.sum("held"), F.count("*"), F.sum(F.when(end, F.col("c"))), F.sum(F.when(end, F.col("held")))).first()
    tokens, tokens_held, distinct, ends, ends_held = (int(x or 0) for x in total)
    top = counts.where(~end & (F.col("c") * FREQUENT >= tokens)).toArrow().sort_by("key")
    return Model(top["key"].to_numpy(), top["c"].to_numpy(), top["held"].to_numpy(), (ends, ends_held), tokens, tokens_held, distinct, parts or max(64, tokens // 500_000))


def fit(model: Model, shared, train: DataFrame, more: DataFrame) -> None:
    """Weights and frequent pairs, from training texts (row, doc_id, text, fold; 1 is held out of the counts) and the packed counts of rare words and before rare words."""
    bins = _bins(_pairs(train, shared, "count").unionByName(more), shared).toArrow()
    context, p, q, c, f, g = (bins[x].to_numpy() for x in bins.column_names)
    k = context >= 0
    order = np.lexsort((q[k], p[k], context[k]))  # in whatever order they came
    estimates = np.stack([f[k] / c[k], g[k] / c[k], np.full(k.sum(), 1 / (model.distinct + 1))], axis=1)
    model.weights = _weights(context[k][order], c[k][order].astype(np.float64), estimates[order])
    a, b, c = p[~k], q[~k], c[~k]
    order = np.argsort(a * (1 << 20) + b)
    a, b, c = a[order], b[order], c[order]
    model.pairs, model.pair_logs = a * (1 << 20) + b, model.log_probability(c, model.counts[a], model.counts[b])


def _scored(packed: DataFrame, shared) -> DataFrame:
    """Parts of each text's figures: those of the tables, and those of its other pairs."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for group in _groups(batches):
            if (w := group[WHOLE]) is not None:
                for i in range(0, w.shape[1], 50_000):
                    x = np.ascontiguousarray(w[:, i : i + 50_000])
                    ids = pa.array(x[1], mask=x[2] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x[0]), ids, pa.array(x[3]), pa.array(x[4]), pa.array(x[5].view(np.float64)), pa.array(x[6].view(np.float64))], schema=schema)
            p, at, ca, _, cb, _ = _together(model, group)
            if not len(at):
                continue
            cab = np.add.reduceat((p[3] < 2).astype(np.int64), at)
            of = np.repeat(np.arange(len(at)), np.diff(np.append(at, p.shape[1])))
            rare = p[1, at] < 0  # other words' base is known already
            row, inverse = np.unique(p[2], return_inverse=True)
            known = np.bincount(inverse, (rare & (cb > 0))[of], len(row)).astype(np.int64)
            base = np.bincount(inverse, np.where(rare, np.log10(cb + 0.1), 0.0)[of], len(row))
            lm = np.bincount(inverse, model.log_probability(cab, ca, cb)[of], len(row))
            for i in range(0, len(row), 50_000):
                j = slice(i, i + 50_000)
                m = len(row[j])
                yield pa.RecordBatch.from_arrays([pa.array(row[j]), pa.nulls(m, pa.int64()), pa.array(np.zeros(m, np.int64)), pa.array(known[j]), pa.array(base[j]), pa.array(lm[j])], schema=schema)

    return _dealt(packed, run, "row long, doc_id long, n_tokens long, n_known long, base double, lm double")


def score(docs: DataFrame, parts: int = 0) -> DataFrame:
    """One row per text: held_out, token counts, the unigram base score and the model's score, both log10."""
    spark = docs.sparkSession
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    fold = F.when(held_out, 2).when(crc_mod("doc_id", 10) == 1, 1).otherwise(0)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("fold", fold)
    counts = cut(unigram_counts(docs.where("fold < 2").select("text", (F.col("fold") == 1).alias("held"))))
    model = vocabulary(counts, parts)
    rare = counts.where((F.col("key") != int(END)) & (F.col("c") * FREQUENT < model.tokens))
    words_ = _word_rows(rare, model.parts)
    shared = spark.sparkContext.broadcast(model)
    more = words_.unionByName(cut(_both(docs, words_, shared)))
    fit(model, shared, docs.where("fold < 2"), more)
    release(spark)
    whole = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    shared = spark.sparkContext.broadcast(model)
    got = _scored(_pairs(docs, shared, "score").unionByName(more), shared)
    out = got.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lm")))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), F.col("lm").alias("score"))
