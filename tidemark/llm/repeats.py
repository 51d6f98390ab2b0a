"""Removal of byte strings that repeat anywhere in the corpus.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier
(in a document of smaller id, or earlier in the same one). Texts are judged as
given; strings don't cross documents.

Method. Column-wise construction inserts one symbol per document and round into
the collection's suffix order and keeps the common prefixes of neighbours. Its
rounds are as many as the longest document has bytes and run one after the
other over the whole collection, which no cluster shortens. So the collection
is first cut where equal strings must meet: of the ``SEED``-byte strings in a
window the one with the smallest hash (the leftmost of equal ones) is its seed;
equal windows have equal seeds at equal places. Seeds that occur once hold no
repeat. All occurrences of a seed come together with their surroundings, and
are ordered column by column from the right: each round adds one symbol to
every surrounding, sorts stably by it within the seed, and updates the common
prefixes of neighbours. Where these reach ``WINDOW``, windows are equal, and
all but the earliest go. Between the stages lie Spark's sorted, spilled
shuffle files.

Occurrences with equal surroundings are one before that: only the earliest is
ordered, the others are repeats as a whole. So a passage in a third of all
documents makes one row. A seed with more than ``CROWD`` different surroundings
is not ordered in one task: its windows are hashed (128 bits) and the earliest
of each found by an aggregate.

A long text is looked at in blocks of ``BLOCK`` bytes that overlap by all that a
seed depends on. In periodic text (one letter over and over) seeds in a row have
equal surroundings; they are one row and one range.

Null and empty texts have no bytes. Rows that repeat an id and its text count
as one text and get the same result; texts of one id that differ are taken as
versions of one place, so that neither is earlier at equal positions. Rows
without an id are left whole.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import chunks, cut, grouped, mix, release

WINDOW = 100
SEED = 24
#: Seeds in a window.
SPAN = WINDOW - SEED + 1
#: Bytes on each side of a seed that a window with it can reach.
REACH = WINDOW - SEED
#: Bytes of a long text that are looked at together.
BLOCK = 1 << 20
#: Rows with these for a seed are no seeds but ranges that repeat for certain.
RANGES = 64
#: Most different surroundings of a seed that one task orders.
CROWD = 50_000

U64 = np.uint64
_RNG = np.random.default_rng(6_100)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = U64(pow(int(_P), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            x = np.full(max(n, 1 << 20), base)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hashes of all substrings of a byte array, from prefix sums."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def _slide(x: np.ndarray, span: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + span] for each i that has so many."""
    size = 1
    while size * 2 <= span:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def seeds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of seeds in a run of texts, their hashes, and the texts they are in."""
    none = np.zeros(0, np.int64)
    if len(buf) < WINDOW:
        return none, none.astype(np.uint64), none
    hashes = Hashes(buf)
    at = np.arange(len(buf) - SEED + 1)
    h = hashes.of(at, at + SEED)
    least = _slide(h, SPAN, np.minimum)  # of the window that starts here
    size = np.diff(off)
    end = np.repeat(off[1:], size)
    inside = np.arange(len(least)) + WINDOW <= end[: len(least)]
    # the seed of each window inside one text: its leftmost place with the least hash
    best = np.where(inside, least, U64(0))
    pad = np.zeros(SPAN - 1, np.uint64)
    reached = _slide(np.concatenate([pad, best, pad]), SPAN, np.maximum)[: len(h)]
    places = np.flatnonzero((h == reached) & (reached > 0))
    if not len(places):
        return none, none.astype(np.uint64), none
    doc = np.searchsorted(off, places, side="right") - 1
    # of equal hashes in a row, a place is the leftmost of some window only if the one before it lies outside that window
    hp = h[places]
    before = np.full(len(places), -(10**9))
    order = np.lexsort((places, hp))
    same = np.flatnonzero(hp[order][1:] == hp[order][:-1])
    before[order[same + 1]] = places[order[same]]
    lo = np.maximum(np.maximum(places - SPAN + 1, off[doc]), before + 1)
    hi = np.minimum(places, off[doc + 1] - WINDOW)
    ok = lo <= hi
    places, doc, hp, lo, hi = places[ok], doc[ok], hp[ok], lo[ok], hi[ok]
    # and if no window of those has a smaller hash
    top = hp.copy()
    some = np.flatnonzero(lo > np.maximum(places - SPAN + 1, off[doc]))
    if len(some):
        top[some] = ~_range_minima(~best, lo[some], hi[some])
    ok = top == hp
    return places[ok], hp[ok], doc[ok]


def blocks(part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int, int]]:
    """A run of texts as it is, or a long text in blocks: the rows, bytes and edges, where the bytes start in the text, and which of the places in the bytes are the block's own. Each block has what its own places' seeds and surroundings depend on."""
    size = size or BLOCK
    if part.num_rows > 1 or len(buf) <= 2 * size:
        yield part, buf, off, 0, 0, len(buf)
        return
    for a in range(0, len(buf), size):
        first, last = max(0, a - 2 * WINDOW), min(len(buf), a + size + 2 * WINDOW)
        yield part, buf[first:last], np.array([0, last - first]), first, a - first, min(a + size, len(buf)) - first


def _occurrences(docs: DataFrame) -> DataFrame:
    """seed, around (hash of the surroundings), doc, pos, reach of each seed. Of seeds in a row with equal surroundings (periodic text) the first is told, and the range of the others: a seed below ``RANGES``, its end for around, its start for pos."""
    schema = pa.schema([("seed", pa.int64()), ("around", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("reach", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for whole, every, edges in chunks(b):
                for part, buf, off, shift, own, end in blocks(whole, every, edges):
                    places, h, doc = seeds(buf, off)
                    mine = (places >= own) & (places < end)
                    places, h, doc = places[mine], h[mine], doc[mine]
                    if not len(places):
                        continue
                    a = np.maximum(places - REACH, off[doc])
                    z = np.minimum(places + WINDOW, off[doc + 1])
                    around = mix(Hashes(buf).of(a, z) + (places - a).astype(np.uint64))
                    ids = part.column(0).to_numpy()[doc]
                    reach = ((places - a) * 128 + (z - places)).astype(np.int16)
                    seed = np.where(h < RANGES, h + U64(RANGES), h).view(np.int64)
                    pos, around = places - off[doc] + shift, around.view(np.int64)
                    again = np.zeros(len(places), bool)
                    again[1:] = (seed[1:] == seed[:-1]) & (around[1:] == around[:-1]) & (doc[1:] == doc[:-1])
                    head = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
                    tail = np.flatnonzero(again & ~np.concatenate([again[1:], [False]]))
                    start, stop = (a - off[doc] + shift)[head], (z - off[doc] + shift)[tail]
                    one = ~again
                    columns = [(seed[one], ids[head] % RANGES), (around[one], stop), (ids[one], ids[head]), (pos[one], start), (reach[one], np.zeros(len(head)))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.mapInArrow(run, "seed long, around long, doc long, pos int, reach short")


def order_columns(group: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For rows (sorted by group, then by age) of symbols, whether the window that starts at each of the first columns also starts there in an older row of its group.

    Columns are added from the right, one symbol per row and round. ``order``
    is the order of the rows' suffixes within each group, ``common`` how long a
    prefix each shares with the one before it.
    """
    n, width = matrix.shape
    repeated = np.zeros((n, width - WINDOW + 1), bool)
    order = np.arange(n)
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    common = np.full(n, width, np.int16)
    common[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))] = 0
    for col in range(width - 1, -1, -1):
        key = rank[order] * 512 + matrix[order, col]
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        new = np.zeros(n, np.int16)
        i = np.flatnonzero(same)
        if len(i):
            # the prefix shared by two suffixes is the least of those between neighbours
            a, z = to[i - 1] + 1, to[i]
            new[i] = np.minimum(_range_minima(common, a, z) + 1, width)
            new[i[matrix[order[to[i]], col] == 256]] = 0  # beyond an end nothing is shared
        order, common = order[to], new
        if col < repeated.shape[1]:
            run = np.flatnonzero(common < WINDOW)
            oldest = np.minimum.reduceat(order, run)
            repeated[order, col] = np.repeat(oldest, np.diff(np.append(run, n))) != order
    return repeated


def _range_minima(x: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """min(x[a..z]), both ends included."""
    size = z - a + 1
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(a), x.dtype)
    for k in range(int(level.max()) + 1):
        pick = level == k
        if pick.any():
            out[pick] = np.minimum(x[a[pick]], x[z[pick] - (1 << k) + 1])
        x = np.minimum(x[: max(1, len(x) - (1 << k))], x[1 << k :] if len(x) > 1 << k else x[:1])
    return out


_RANGES = "doc long, a int, b int"
_RANGE_SCHEMA = pa.schema([("doc", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _window_ranges(doc: np.ndarray, start: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Byte ranges that repeated windows cover; start: the place of column 0 in its text."""
    row, col = np.nonzero(repeated)
    if len(row):
        head = np.concatenate([[True], (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)])
        tail = np.concatenate([head[1:], [True]])
        row, a, b = row[head], col[head], col[tail] + WINDOW
    else:
        a = b = col
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((start[row] + a).astype(np.int32)), pa.array((start[row] + b).astype(np.int32))], schema=_RANGE_SCHEMA)


def _matrix(t: pa.Table) -> np.ndarray:
    """Surroundings in columns, the seeds below each other; 256 beyond an end."""
    left = t.column("reach").to_numpy().astype(np.int64) >> 7
    out = np.full((t.num_rows, REACH + WINDOW), 256, np.int16)
    for i, (x, l) in enumerate(zip(t.column("bytes").to_pylist(), left.tolist(), strict=True)):
        out[i, REACH - l : REACH - l + len(x)] = np.frombuffer(x, np.uint8)
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    """Ranges of repeated windows among the surroundings of each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["seed"]):
            seed = t.column("seed").to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])), len(seed))
            i = 0
            while i < len(edges) - 1:  # whole groups, some ten thousand rows at a time
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + 10_000, side="right")) - 1)
                s = t.slice(int(edges[i]), int(edges[j] - edges[i]))
                i = j
                once = np.concatenate([[True], (np.diff(s.column("seed").to_numpy()) != 0) | (np.diff(s.column("doc").to_numpy()) != 0) | (np.diff(s.column("pos").to_numpy()) != 0)])
                s = s.filter(pa.array(once))
                start = s.column("pos").to_numpy().astype(np.int64) - REACH
                yield _window_ranges(s.column("doc").to_numpy(), start, order_columns(s.column("seed").to_numpy(), _matrix(s)))

    return rows.select("seed", "doc", "pos", "reach", "bytes").repartition("seed").sortWithinPartitions("seed", "doc", "pos").mapInArrow(run, _RANGES)


def _hashed(rows: DataFrame) -> DataFrame:
    """The same ranges for seeds with a crowd of surroundings: by the earliest place of each window's hash."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            if not texts:
                continue
            buf = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(x) for x in texts])
            off = np.concatenate([[0], np.cumsum(size)])
            count = np.maximum(0, size - WINDOW + 1)
            row = np.repeat(np.arange(len(texts)), count)
            a = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = b.column(1).to_numpy().astype(np.int64) - (b.column(2).to_numpy().astype(np.int64) >> 7)
            hashes = Hashes(buf)
            h1 = hashes.of(off[row] + a, off[row] + a + WINDOW)
            h2 = mix(hashes.of(off[row] + a, off[row] + a + WINDOW // 2) + U64(7)) ^ hashes.of(off[row] + a + WINDOW // 2, off[row] + a + WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(b.column(0).to_numpy()[row]), pa.array((start[row] + a).astype(np.int32))], schema=schema)

    windows = rows.select("doc", "pos", "reach", "bytes").mapInArrow(run, "h1 long, h2 long, doc long, at int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    return windows.join(first, ["h1", "h2"]).where(F.struct("doc", "at") > F.col("first")).select("doc", F.col("at").alias("a"), (F.col("at") + WINDOW).alias("b"))


def _surroundings(texts: DataFrame) -> DataFrame:
    """doc, text, wanted (seed, pos, reach, crowded): each wanted seed with its surroundings' bytes."""
    schema = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("reach", pa.int16()), ("crowded", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode()
                want = b.column(2)[i].values
                pos, reach = want.field("pos").to_numpy(), want.field("reach").to_numpy()
                cuts = [raw[p - (r >> 7) : p + (r & 127)] for p, r in zip(pos.tolist(), reach.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([want.field("seed"), pa.array(np.full(len(pos), b.column(0)[i].as_py())), want.field("pos"), want.field("reach"), want.field("crowded"), pa.array(cuts, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "seed long, doc long, pos int, reach short, crowded boolean, bytes binary")


def _applied(texts: DataFrame) -> DataFrame:
    """doc_id, text, ranges (a, b): the digest of what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                if ranges.is_valid and len(ranges.values):
                    for a, z in sorted(zip(ranges.values.field("a").to_pylist(), ranges.values.field("b").to_pylist(), strict=True)):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], z)
                        else:
                            spans.append([a, z])
                at, digest = 0, hashlib.sha256()
                for a, z in spans:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                for out, x in zip(rows, (len(raw), sum(z - a for a, z in spans), len(spans), digest.hexdigest(), [y for s in spans for y in s]), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip(rows, list(schema)[1:], strict=True))], schema=schema)

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")


def repeats(docs: DataFrame) -> DataFrame:
    """One row per text: bytes, bytes and runs to remove, a digest of the rest, and the runs (start, end, start, ...) in bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _occurrences(docs.where("doc_id is not null"))
    # counts are combined before the shuffle and joins can split a hot seed's rows: no task sees all of them
    again = cut(found.groupBy("seed").agg(F.count("*").alias("c")).where(f"c > 1 or seed >= 0 and seed < {RANGES}").select("seed"))
    release(docs.sparkSession)
    both = cut(found.join(again, "seed"))
    release(docs.sparkSession)
    certain = F.col("seed").between(0, RANGES - 1)
    rows = both.where(~certain)
    first = rows.groupBy("seed", "around").agg(F.min(F.struct("doc", "pos")).alias("first"))
    kinds = first.groupBy("seed").agg(F.count("*").alias("kinds"))
    ranked = rows.join(first.join(kinds, "seed"), ["seed", "around"]).withColumn("later", F.struct("doc", "pos") > F.col("first"))
    ranked = cut(ranked.where("later or kinds > 1").select("seed", "doc", "pos", "reach", "later", (F.col("kinds") > CROWD).alias("crowded")))
    left, right = F.shiftright("reach", 7), F.col("reach").bitwiseAND(127)
    whole = ranked.where("later").select("doc", (F.col("pos") - left).cast("int").alias("a"), (F.col("pos") + right).cast("int").alias("b"))
    wanted = ranked.where("not later").groupBy("doc").agg(F.collect_set(F.struct("seed", "pos", "reach", "crowded")).alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc")
    release(docs.sparkSession)
    crowded = not ranked.where("crowded").isEmpty()
    around = _surroundings(texts.select("doc", "text", "wanted"))
    runs = both.where(certain).select("doc", F.col("pos").alias("a"), F.col("around").cast("int").alias("b"))
    ranges = whole.unionByName(runs).unionByName(_ordered(around.where("not crowded") if crowded else around))
    if crowded:
        ranges = ranges.unionByName(_hashed(around.where("crowded")))
    del found, again, rows, first, kinds, ranked  # so that what they keep on disk goes once it isn't needed
    ranges = cut(ranges)
    del both, around, texts, wanted, whole, runs
    release(docs.sparkSession)
    per_text = ranges.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).withColumnRenamed("doc", "doc_id")
    return _applied(docs.join(per_text, "doc_id", "left").select("doc_id", "text", "ranges"))
