"""Secret scans by assignment-aware lexing.

Three fixed base kinds are found by pattern (``assign``, ``access``, ``hex``).
On top, every assignment in source or configuration syntax (``name = expr``,
``name: expr``, ``"name": expr``, ``name := expr``, ``name => expr``,
``x["name"] = expr``, ``name: type = expr``, ``<name>text</name>``,
``key="name" value="text"``) is lexed into a target name and the literals on its
right-hand side: quoted ones (also triple-quoted, over several lines where a
``+`` or parenthesis says so, in brackets, and as arguments of calls) and bare
ones; also the lines of YAML's block texts, what follows ``Bearer`` and the like,
the sides of ``a, b = x, y``, what a setter is called with, and what a name is
compared to. Bare words that read as a reference (``self.request.token``,
``getPassword``) are no literals, nor are names that stand for something about a
secret (``token_url``). Names already assigned are constants and are followed
(``a = "x"; password = a + "y"`` reports both literals). A literal is reported (kind ``literal``) when the
weight of the sensitive words in its target's name, times a factor for how
secret-like the whole value is, reaches ``min_score``.

Null and empty texts give no spans; every row of the input gives one row,
repeated ids included; other columns play no part.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
_RANK = {k: i for i, k in enumerate(KINDS)}

_BASE_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_BASE_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 or more with the prefix; a shorter run holds no longer one
_BASE_HEX = re.compile(r"[0-9a-f]{32,}")

_OPERATOR = re.compile(r":=|=>|[=:]")
_QUOTED = r"\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"
_TERM = re.compile(rf"[ \t]*(?:(?<![A-Za-z0-9_])(?:[rbfu]{{1,2}}(?=[\"'`]))?(?:{_QUOTED})|([A-Za-z0-9_+/.\-=~$@%{{}}<>!*#]+))", re.DOTALL)
_ARGUMENT = re.compile(rf"{_QUOTED}|[()\n=:]", re.DOTALL)
_PLUS = re.compile(r"[ \t]*[+.]?[ \t]*(?=[\"'])|[ \t]*\+[ \t]*(?:\r?\n[ \t]*)?")
_PLUS_WITHIN = re.compile(r"\s*[+.]?\s*(?=[\"'])|\s*\+\s*")
#: A type between a name and its value.
_TYPED = re.compile(r":[ \t]*[A-Za-z_][A-Za-z0-9_.<>\[\]|, ?]{0,80}?[ \t]*=(?![=>])")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?: [^<>]*)?>[ \t]*([^<>\s]+)[ \t]*</")
_PAIR = re.compile(r"\b(?:key|name)=[\"']([^\"'\n]+)[\"'][ \t]+value=[\"']([^\"'\n]+)[\"']", re.IGNORECASE)
#: Bare words that are references rather than values: plain words, with digits at their ends at most, joined by dots and dashes.
_REFERENCE = re.compile(r"(?=[A-Za-z_])(?:(?<![0-9])[A-Za-z]+|[._-]+|(?<=[A-Za-z._-])[0-9]{1,2}(?![0-9]))++\Z|[A-Za-z]++(?:_++(?:[A-Za-z]++[0-9]{0,2}|[0-9]{1,4}))++\Z")
#: A way of authorization, before what is secret.
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token|digest|negotiate)[ \t]+(?=\S)")
_BLOCK_TEXT = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*\r?\n")
_LINE = re.compile(r"([ \t]*)([^\r\n]*)(?:\r?\n|\Z)")
_LIST = re.compile(r"[ \t]*\[\s*(?=[\"'`])")
_ITEM = re.compile(rf"(?:[rbfu]{{1,2}}(?=[\"'`]))?(?:{_QUOTED})\s*(,?)\s*", re.DOTALL)
#: Names before the last one of ``a, b = x, y``, from the start of its line.
_NAMES = re.compile(r"[ \t]*((?:[A-Za-z_][A-Za-z0-9_.]*+[ \t]*,[ \t]*)+)\Z")
_COMMA = re.compile(r"[ \t]*,")
_INSERTED = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*)\}")
_SETTER = re.compile(rf"(?<![A-Za-z0-9_])(?:set|with|put)_?([A-Za-z][A-Za-z0-9_]*+)\(\s*(?>{_QUOTED})\s*\)", re.DOTALL)
_COMPARED = re.compile(rf"(?<![A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_.]*+)[ \t]*[=!]==?[ \t]*(?:{_QUOTED})", re.DOTALL)
_PRIVATE_KEY = re.compile(r"\s*-----BEGIN [A-Z ]*PRIVATE KEY-----")
_NAME_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)\[[a-z]+_removed\]|x{4,}|\*{3,}|\.{3,}|\$\{|\{\{|<[a-z_ -]*>|change_?me|example|placeholder|your[_-]|\Anull\Z|\Anone\Z|\Atrue\Z|\Afalse\Z|\Aundefined\Z|\A(.)\1*\Z")
#: Those of them that make no difference by where they stand, so that a longer value keeps them.
_PLACEHOLDER_WITHIN = re.compile(_PLACEHOLDER.pattern.split(r"|\Anull", 1)[0])

#: How much each word in a target's name says that its value is secret; the largest counts.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pass": 0.8, "pwd": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "signature": 0.6, "salt": 0.6, "cookie": 0.6, "dsn": 0.6, "pin": 0.5,
}
#: "key" counts next to one of these.
KEY_NEIGHBOURS = frozenset("api private access secret encryption signing auth master session client account storage service ssh aes hmac".split())

#: Words that weigh as much at the end of a fused one, as in PGPASSWORD.
FUSED = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey")
#: A name with such a last word tells something about a secret.
ABOUT = frozenset("url uri urls endpoint name names path file filename dir directory type types length size count limit expiry expires ttl timeout format prefix label title hint help policy field column param version issuer audience".split())


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1: camelCase, snake_case, kebab-case and dotted names are split first."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if len(parts) > 1 and parts[-1] in ABOUT:
        return 0.0
    best = max((NAME_WEIGHTS.get(p, 0.0) for p in parts), default=0.0)
    fused = max((NAME_WEIGHTS[w] for p in parts for w in FUSED if p.endswith(w)), default=0.0)
    best = max(best, fused)
    if ("key" in parts or "keys" in parts) and KEY_NEIGHBOURS & set(parts):
        best = max(best, 0.9)
    return best


def value_factor(value: str) -> float:
    """How secret-like a value is, 0 to 1: long enough, no placeholder, mixed letters."""
    if _PRIVATE_KEY.match(value):
        return 1.0
    if len(value) < 8 or _PLACEHOLDER.search(value) or " " in value.strip():
        return 0.0
    return _mixed(Counter(value), len(value))


def _mixed(counts: Counter, n: int) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    letters = "".join(counts)
    kinds = sum(map(bool, (re.search("[a-z]", letters), re.search("[A-Z]", letters), re.search("[0-9]", letters), re.search("[^A-Za-z0-9]", letters))))
    return min(1.0, entropy / 3.0) * (1.0 if kinds >= 2 else 0.6)


#: Values up to this length are held and scored as texts; longer ones by sums over their pieces.
_HELD = 4096
_EDGE = 64


class Value:
    """A value put together from literals and earlier values: its pieces, and what scoring needs of the whole. Nothing is copied per piece, so a text that builds a value step by step stays linear."""

    __slots__ = ("pieces", "text", "n", "counts", "head", "tail", "first", "last", "blank", "never")

    def __init__(self, pieces: list) -> None:
        """Pieces: literals (value, start, end), and values."""
        self.pieces = pieces
        parts = [p if isinstance(p, Value) else Value._literal(p[0]) for p in pieces]
        self.n = sum(p.n for p in parts)
        self.text = "".join(p.text for p in parts) if self.n <= _HELD else None
        if self.text is not None:
            self._measure(self.text)
            return
        self.counts, self.never = Counter(), False
        self.head = self.tail = ""
        self.first = self.last = 0
        self.blank = True
        for p in parts:
            self.never |= p.never or bool(_PLACEHOLDER_WITHIN.search(self.tail + p.head))
            self.head = (self.head + p.head)[:_EDGE] if len(self.head) < _EDGE else self.head
            self.tail = (self.tail + p.tail)[-_EDGE:]
            self.last = p.last + (self.counts[" "] if self.blank else self.last) if p.blank else p.last
            if self.blank:
                self.first = self.counts[" "] + p.first
            self.counts.update(p.counts)
            self.blank &= p.blank

    @staticmethod
    def _literal(text: str) -> "Value":
        v = Value.__new__(Value)
        v.pieces, v.text, v.n = [], text, len(text)
        v._measure(text)
        return v

    def _measure(self, text: str) -> None:
        self.counts, self.head, self.tail = Counter(text), text[:_EDGE], text[-_EDGE:]
        self.blank = not text.strip()
        # spaces before and after all else
        self.first = text[: len(text) - len(text.lstrip())].count(" ")
        self.last = text[len(text.rstrip()) :].count(" ")
        self.never = bool(_PLACEHOLDER_WITHIN.search(text))

    def factor(self) -> float:
        """As :func:`value_factor` of the whole; a placeholder in angle brackets is seen across pieces only within 64 characters of where they meet."""
        if self.text is not None and self.n <= _HELD:
            return value_factor(self.text)
        if _PRIVATE_KEY.match(self.head):
            return 1.0
        if self.never or len({c.lower() for c in self.counts}) == 1 or not self.blank and self.counts[" "] > self.first + self.last:
            return 0.0
        return _mixed(self.counts, self.n)


class Term(NamedTuple):
    name: str | None  #: of a bare word that may have been assigned
    value: str
    start: int
    literal: bool  #: whether it stands for itself if it wasn't


def _quoted(m: re.Match) -> tuple[str, int] | None:
    return _quoted_from(m, 1)


def _quoted_from(m: re.Match, first: int) -> tuple[str, int] | None:
    """The text of a match of quotes whose groups begin at `first`, without a way of authorization, and its place."""
    g = next((g for g in range(first, first + 5) if m[g] is not None), 0)
    if not g:
        return None
    skip = scheme.end() if (scheme := _SCHEME.match(m[g])) else 0
    return m[g][skip:], m.start(g) + skip


def _inserted(text: str, start: int) -> list[Term]:
    """The literals and names of a format string."""
    terms: list[Term] = []
    at = 0
    for m in _INSERTED.finditer(text):
        if m.start() > at:
            terms.append(Term(None, text[at : m.start()], start + at, True))
        terms.append(Term(m[1], m[1], start + m.start(1), False))
        at = m.end()
    return terms + ([Term(None, text[at:], start + at, True)] if at < len(text) else [])


def _block_text(text: str, at: int, indent: int) -> list[Term]:
    """The lines from a place on that are indented by more than `indent`."""
    terms: list[Term] = []
    while at < len(text) and (m := _LINE.match(text, at)) and (not m[2] or len(m[1]) > indent):
        if m[2].strip():
            terms.append(Term(None, m[2].rstrip(), m.start(2), True))
        at = m.end()
    return terms


def _arguments(text: str, at: int) -> tuple[list[Term], int]:
    """The quoted arguments of a call that opens at a place, and where they end: with its parenthesis or line, or before the next operator, which has a target of its own."""
    terms: list[Term] = []
    depth = 1
    while depth and (m := _ARGUMENT.search(text, at)):
        if m[0] in "\n=:":
            break
        at = m.end()
        if q := _quoted(m):
            if not re.fullmatch(r"[A-Z0-9_]+", q[0]):  # a name to look up
                terms.append(Term(None, *q, True))
        else:
            depth += 1 if m[0] == "(" else -1
    return terms, at


def _right(text: str, at: int) -> tuple[list[Term], int]:
    """The terms of a right-hand side, and where it ends; with a call it ends where the call opens, as its arguments may be assignments."""
    terms: list[Term] = []
    call = None
    opened = re.compile(r"[ \t]*\(\s*").match(text, at)
    plus = _PLUS_WITHIN if opened else _PLUS
    at = opened.end() if opened else at
    while t := _TERM.match(text, at):
        if q := _quoted(t):
            at = t.end()
            if q[0] and "f" in text[t.start() : q[1]]:
                terms += _inserted(*q)
            elif q[0]:
                terms.append(Term(None, *q, True))
        elif not terms and (scheme := _SCHEME.match(text, t.start(6))):
            at = scheme.end()
            continue
        else:
            bare = t[6].rstrip(".")
            at = t.end()
            if text[at : at + 1] == "(":
                call = call or at + 1
                more, at = _arguments(text, at + 1)
                terms += more
            elif bare:
                name = bare if _IDENTIFIER.match(bare) else None
                terms.append(Term(name, bare, t.start(6), text[at : at + 1] != "[" and not _REFERENCE.match(bare)))
        p = plus.match(text, at)
        if not q and not (p and "+" in p[0]) or not p or p.end() == at:
            break
        at = p.end()
    return terms, call or at


def assignments(text: str) -> Iterator[tuple[str, list[Term]]]:
    """Name and right-hand terms, in order."""
    done = 0
    for m in _OPERATOR.finditer(text):
        i, after = m.start(), m.end()
        if i < done:
            continue
        while i > done and text[i - 1] in " \t":
            i -= 1
        if i > done and text[i - 1] == "]":
            i -= 1
        if i > done and text[i - 1] in "\"'":
            i -= 1
        end = i
        while i > done and text[i - 1] in _NAME_CHAR:
            i -= 1
        name = text[i:end].lstrip("-.0123456789")
        if not name:
            continue
        if m[0] == ":" and (typed := _TYPED.match(text, m.start())):
            after = typed.end()
        if m[0] == ":" and (block := _BLOCK_TEXT.match(text, after)):
            if name_weight(name):
                line = text[max(text.rfind("\n", done, i) + 1, done) : i]
                yield name, _block_text(text, block.end(), len(line) - len(line.lstrip(" \t")))
            done = block.end()  # the lines may be assignments themselves
            continue
        if each := _LIST.match(text, after):
            done = each.end()
            while item := _ITEM.match(text, done):
                if (q := _quoted(item)) and q[0]:
                    yield name, [Term(None, *q, True)]
                done = item.end()
                if not item[6]:
                    break
            continue
        terms, upto = _right(text, after)
        if m[0] == "=" and terms and (comma := _COMMA.match(text, upto)) and text[i - 2 : i] == ", ":
            line = max(text.rfind("\n", done, i) + 1, done)
            if several := _NAMES.match(text[line:i]):
                for one in [*(x.strip() for x in several[1].split(",")[:-1]), name]:
                    if terms:
                        yield one, terms
                        done = upto
                    terms, upto = _right(text, comma.end()) if comma else ([], upto)
                    comma = _COMMA.match(text, upto) if terms else None
                continue
        if terms:
            # a bare word may be the target of the next operator
            first = terms[0]
            chained = first.name or len(terms) == 1 and m[0] == ":" and "=" in first.value and text[first.start - 1] not in "\"'"
            done = max(first.start if chained else upto, after)
            yield name, terms
        else:
            done = max(done, after)


def _marked_up(text: str) -> Iterator[tuple[str, list[Term]]]:
    """Names and values of elements, of key-value attributes, of setters and of comparisons."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            if text.startswith(m[1], m.end()):
                yield m[1], [Term(None, m[2], m.start(2), True)]
    if "value=" in text:
        for m in _PAIR.finditer(text):
            yield m[1], [Term(None, m[2], m.start(2), True)]
    for sign, pattern in (("(", _SETTER), ("==", _COMPARED), ("!=", _COMPARED)):
        if sign in text:
            for m in pattern.finditer(text):
                if name_weight(m[1]) and (q := _quoted_from(m, 2)):
                    yield m[1], [Term(None, *q, True)]


def literals(text: str, min_score: float = 0.5) -> list[tuple[str, int, int]]:
    """Spans of the literals that end up in sensitive targets; constants assigned earlier in the text are followed."""
    known: dict[str, Value] = {}
    found: dict[tuple[int, int], None] = {}
    told: set[int] = set()  # values whose pieces are found already; known and pieces keep them alive
    kept: list[Value] = []
    for name, terms in chain(assignments(text), _marked_up(text)):
        pieces = [known[t.name] if t.name in known else (t.value, t.start, t.start + len(t.value)) for t in terms if t.name in known or t.literal]
        if not pieces:
            known.pop(name, None)
            continue
        value = known[name] = Value(pieces)
        kept.append(value)
        weight = 1.0 if _PRIVATE_KEY.match(value.head) else name_weight(name)
        if weight and weight * value.factor() >= min_score:
            todo = [value]
            while todo:
                one = todo.pop()
                if id(one) in told:
                    continue
                told.add(id(one))
                for p in one.pieces:
                    if isinstance(p, Value):
                        todo.append(p)
                    elif len(p[0]) >= 4:
                        found[p[1], p[2]] = None
    return [("literal", a, b) for a, b in found]


def _assigned(text: str) -> list[re.Match]:
    return [m for m in _BASE_ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]


def scan_text(text: str | None, min_score: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of one text, each by start, then kind as listed; code points, end exclusive."""
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    if text:
        if ":" in text or "=" in text or "</" in text or "(" in text:
            base += [("assign", *m.span()) for m in _assigned(text)]
            more = literals(text, min_score)
        if "AKIA" in text:
            base += [("access", *m.span()) for m in _BASE_ACCESS.finditer(text)]
        base += [("hex", *m.span()) for m in _BASE_HEX.finditer(text)]
    by = lambda s: (s[1], _RANK[s[0]], s[2])
    return sorted(base, key=by), sorted(base + more, key=by)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_literal", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in b.column(1):
                base, every = scan_text(text.as_py(), min_score)
                n = Counter(k for k, _, _ in every)
                for out, x in zip(rows, (n["assign"], n["access"], n["hex"], n["literal"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(x, t.type) for x, t in zip(rows, list(_OUT)[1:], strict=True))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def mask(text: str | None, min_score: float = 0.5) -> str | None:
    """The text with every found value replaced by a tag of its kind; names and quotes stay, overlapping values become one."""
    _, spans = scan_text(text, min_score)
    if not spans:
        return text
    values = [("assign", *m.span(2)) for m in _assigned(text)] if any(k == "assign" for k, _, _ in spans) else []
    spans = sorted([s for s in spans if s[0] != "assign"] + values, key=lambda s: (s[1], _RANK[s[0]], s[2]))
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind.upper()}_REMOVED]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The same rows and columns, with secrets masked in ``text``."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, min_score))

    return docs.withColumn("text", masked(F.col("text").cast("string")))
