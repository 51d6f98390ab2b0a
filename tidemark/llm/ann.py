"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled by the largest norm; where norms differ they are given one
more coordinate that makes them unit vectors, so that the largest inner product
is the smallest angle.
Each table turns them by fast Hadamard pseudo-rotations (three rounds of random
signs and a Hadamard transform), once for each of its functions, and takes the
nearest signed axes together as bucket; a query also probes the next nearest
ones. The number of functions follows the number of vectors, so that a bucket
holds about ``BUCKET`` of them however many there are. How many buckets a query
probes follows from the data: for a bounded sample of queries the true nearest
are found by brute force, and probes are as many as it takes to meet ``RECALL``
of those. Clustered vectors need few, vectors without structure many; where they
would need over ``MOST_PROBES`` of each table, hashing spares little, and every
query is compared with all vectors in blocks, which is exact.

Buckets that differ in the last function only are a cell. A cell's vectors come
together, in parts of ``BLOCK`` rows, with the queries that probe some of its
buckets; products are taken bucket by bucket in single precision, and only each
task's best go on. Their scores are then taken anew in double precision from the
original vectors, summed in one order.

Equal vectors are one before anything is compared; of their ids only the
``k + 1`` smallest can be among the nearest. A query that finds fewer than
there are (few vectors, empty buckets) is compared with all vectors in blocks.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as candidates or as queries. Rows that
repeat an id and vector count once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.textkit import cut, grouped

TABLES = 8
#: Vectors of a bucket, about, and most rows of a cell that one task takes together.
BUCKET, BLOCK = 64, 4096
#: Queries of the sample that sets the number of probes, and the share of their nearest that must be met.
SAMPLE, RECALL = 64, 0.96
#: Most buckets of a table that a query probes. Queries that would need more are compared with all vectors.
MOST_PROBES = 1 << 14
#: How many more than the k best by single precision are scored in double precision.
SPARE = 8


def functions_for(n: int, padded: int) -> int:
    """Hash functions of a table, for n vectors of padded coordinates."""
    return max(1, int(np.ceil(np.log(max(n, 1) / BUCKET) / np.log(2 * padded))))


def rotations(size: int, functions: int = 1, seed: int = 42) -> np.ndarray:
    """Signs of each table's functions: (tables, functions, rounds, size)."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (TABLES, functions, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the number of columns is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def nearest_axes(x: np.ndarray, signs: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the codes of the best signed-axis combinations of one table's functions, nearest first, and their scores."""
    codes = np.zeros((len(x), 1), np.int64)
    score = np.zeros((len(x), 1))
    n = x.shape[1]
    for rounds in signs:
        y = x
        for s in rounds:
            y = hadamard(y * s)
        both = np.concatenate([y, -y], axis=1)
        best = np.argpartition(-both, min(probes, 2 * n) - 1, axis=1)[:, :probes]
        # nearest to an axis: the largest coordinate; a farther one costs the square of what is missing
        miss = (both.max(axis=1, keepdims=True) - np.take_along_axis(both, best, axis=1)) ** 2
        codes = (codes[:, :, None] * (2 * n) + best[:, None, :]).reshape(len(x), -1)
        score = (score[:, :, None] + miss[:, None, :]).reshape(len(x), -1)
        if score.shape[1] > probes:
            some = np.argpartition(score, probes - 1, axis=1)[:, :probes]
            codes, score = np.take_along_axis(codes, some, axis=1), np.take_along_axis(score, some, axis=1)
        order = np.argsort(score, axis=1, kind="stable")
        codes, score = np.take_along_axis(codes, order, axis=1), np.take_along_axis(score, order, axis=1)
    return codes, score


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (double) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    usual = v.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("size")).first()
    return v.where(F.size("v") == (usual["size"] if usual else 0))


class Shape:
    """What hashing needs to know of the vectors."""

    def __init__(self, n: int, size: int, norm: float, uneven: bool) -> None:
        self.size, self.norm, self.uneven = size, norm, uneven
        self.padded = 1 << max(1, (size + uneven - 1).bit_length())
        self.functions = functions_for(n, self.padded)
        self.signs = rotations(self.padded, self.functions)
        self.codes = (2 * self.padded) ** self.functions

    def scaled(self, x: np.ndarray, asks: bool) -> np.ndarray:
        full = np.zeros((len(x), self.padded))
        full[:, : self.size] = x / self.norm
        if self.uneven and not asks:  # queries have nothing there
            full[:, self.size] = np.sqrt(np.maximum(0.0, 1 - (full * full).sum(axis=1)))
        return full


def _singles(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())


_PLACED = pa.schema([("cell", pa.int64()), ("asks", pa.bool_()), ("buckets", pa.list_(pa.int32())), ("rep", pa.int64()), ("x", pa.binary())])
_PLACED_DDL = "cell long, asks boolean, buckets array<int>, rep long, x binary"


def _placed(rows: DataFrame, shape: Shape, probes: int, asks: bool) -> DataFrame:
    """cell, asks, buckets (last codes), rep, x for each cell that a vector falls in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, (1 << 22) // (probes * 2 * shape.padded)) if asks else 2000
        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, shape.size)
                full, single = shape.scaled(x, asks), _singles(x)
                for t in range(TABLES):
                    codes, _ = nearest_axes(full, shape.signs[t], probes)
                    row = np.repeat(np.arange(len(x)), codes.shape[1])
                    code = np.sort(codes, axis=1).ravel()
                    cell = code // (2 * shape.padded)
                    new = np.ones(len(cell), bool)
                    new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
                    at = np.flatnonzero(new)
                    buckets = pa.ListArray.from_arrays(pa.array(np.append(at, len(cell)), pa.int32()), pa.array((code % (2 * shape.padded)).astype(np.int32)))
                    take = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at] * TABLES + t), pa.array(np.full(len(at), asks)), buckets, part.column(0).take(take), single.take(take)], schema=_PLACED)

    return rows.select("rep", "v").mapInArrow(run, _PLACED_DDL)


def _probes(classes: DataFrame, asked: DataFrame, shape: Shape, k: int) -> int | None:
    """How many buckets of each table a query must probe to meet its k nearest, by a sample of queries; None if over MOST_PROBES."""
    chosen = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).select("v").collect()
    if not chosen:
        return 1
    q = np.array([r["v"] for r in chosen])
    schema = pa.schema([("query", pa.int32()), ("v", pa.list_(pa.float64())), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                col = b.column(0).slice(i, 20_000)
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, shape.size)
                s = q @ x.T
                best = _top(s, min(k + 1, len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), best.shape[1])), col.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, axis=1).ravel())], schema=schema)

    near = classes.select("v").mapInArrow(run, "query int, v array<double>, score double")
    nth = Window.partitionBy("query").orderBy(F.desc("score"))
    rows = near.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1).select("query", "v").collect()  # at most SAMPLE * (k + 1)
    of, found = np.array([r["query"] for r in rows]), np.array([r["v"] for r in rows])
    other = (found != q[of]).any(axis=1)
    of, found = of[other], found[other]
    if not len(of):
        return 1
    most = min(MOST_PROBES, shape.codes)
    home = np.stack([nearest_axes(shape.scaled(found, False), signs, 1)[0][:, 0] for signs in shape.signs])
    first = np.full(len(of), shape.codes)  # where the query's probes meet the bucket of each
    needed = min(len(first) - 1, int(np.ceil(RECALL * len(first))))
    probes = 0
    while probes < most:
        probes = min(most, max(64, 4 * probes))
        for i in np.unique(of[first == shape.codes]):  # one by one: each may have 2 * MOST_PROBES * padded combinations in memory
            theirs = np.flatnonzero((of == i) & (first == shape.codes))
            for signs, homes in zip(shape.signs, home, strict=True):
                probed = nearest_axes(shape.scaled(q[i : i + 1], True), signs, probes)[0][0]
                order = np.argsort(probed)
                at = order[np.minimum(np.searchsorted(probed, homes[theirs], sorter=order), len(order) - 1)]
                first[theirs] = np.where(probed[at] == homes[theirs], np.minimum(first[theirs], at), first[theirs])
        if (enough := np.sort(first)[needed]) < probes:
            return int(enough) + 1
    return None


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values, of equal ones the first."""
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    above = s > least[:, None]
    level = s == least[:, None]
    level &= np.cumsum(level, axis=1) <= (k - above.sum(axis=1))[:, None]
    return np.nonzero(above | level)[1].reshape(len(s), k)


def _compared(rows: DataFrame, size: int, k: int) -> DataFrame:
    """rows as placed, with block. The k best of each task for each row that asks: query, rep, score."""
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows_held = 0

        def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """The k best of each query among what is held, each once."""
            query, rep, score = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((-score, rep, query))
            query, rep, score = query[order], rep[order], score[order]
            once = np.concatenate([[True], (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])])
            query, rep, score = query[once], rep[once], score[once]
            order = np.lexsort((rep, -score, query))
            query, rep, score = query[order], rep[order], score[order]
            head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            nth = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
            return [(query[nth < k], rep[nth < k], score[nth < k])]

        def out(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for query, rep, score in rows:
                for i in range(0, len(query), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (query, rep, score)], schema=schema)

        for t in grouped(batches, ["cell", "block"]):
            cell, block, rep = (t.column(c).to_numpy() for c in ("cell", "block", "rep"))
            asks = t.column("asks").to_numpy(zero_copy_only=False)
            v = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, size)
            buckets = t.column("buckets").combine_chunks()
            many = np.diff(buckets.offsets.to_numpy())
            group = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])]))
            # one row per vector or query and bucket; a bucket's vectors stand before its queries, by id
            row = np.repeat(np.arange(len(rep)), many)
            code = group[row] * (1 << 32) + buckets.flatten().to_numpy()
            order = np.lexsort((rep[row], asks[row], code))
            row, code = row[order], code[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            n_asks = np.add.reduceat(asks[row].astype(np.int64), start) if len(row) else start
            ends = np.append(start[1:], len(row))
            for i in np.flatnonzero((n_asks > 0) & (n_asks < ends - start)).tolist():
                m, q = np.split(row[start[i] : ends[i]], [ends[i] - start[i] - n_asks[i]])
                for at in range(0, len(q), 512):
                    ask = q[at : at + 512]
                    s = v[ask] @ v[m].T
                    best = _top(s, min(k, len(m))) if len(m) > 4 * k else np.broadcast_to(np.arange(len(m)), s.shape)
                    held.append((np.repeat(rep[ask], best.shape[1]), rep[m][best].ravel(), np.take_along_axis(s, best, axis=1).ravel()))
                    rows_held += best.size
                if rows_held > 1_000_000:
                    held = merged()
                    rows_held = len(held[0][0])
                    if rows_held > 500_000:
                        yield from out(held)
                        held, rows_held = [], 0
        if held:
            yield from out(merged())

    return rows.select("cell", "block", "asks", "buckets", "rep", "x").repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(run, "query long, rep long, score float")


def _blocks(members: DataFrame, asking: DataFrame, size: int, k: int) -> DataFrame:
    """Vectors and queries as placed, compared cell by cell, full cells in parts."""
    n = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    there = members.join(n, "cell", "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), "blocks").cast("int")).otherwise(0)).drop("blocks")
    coming = asking.join(n, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return _compared(there.unionByName(coming), size, k)


def _lone(rows: DataFrame, size: int, asks: bool) -> DataFrame:
    """All rows placed in one cell and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                part = b.slice(i, 20_000)
                n = part.num_rows
                one = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.zeros(n, np.int32)))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), pa.array(np.full(n, asks)), one, part.column(0), _singles(x)], schema=_PLACED)

    return rows.select("rep", "v").mapInArrow(run, _PLACED_DDL)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) its k nearest among vectors, itself left out."""
    valid = _valid(vectors).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    classes = cut(
        valid.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = classes.agg(F.max(F.size("v")), F.max(square), F.min(square)).first()
    size, norm = (most[0] or 1), float(np.sqrt(most[1] or 1.0)) * (1 + 1e-12)
    uneven = (most[2] or 1.0) < 0.999 * (most[1] or 1.0)
    asked = _valid(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("v"))
    asked = cut(asked.where(F.size("v") == size).withColumn("rep", F.col("query_id")))
    total = classes.count()
    shape = Shape(total, size, norm, uneven)
    probes = _probes(classes, asked, shape, k)
    members, asking = (_lone(classes, size, False), _lone(asked, size, True)) if probes is None else (_placed(classes, shape, 1, False), _placed(asked, shape, probes, True))
    found = cut(_blocks(members, asking, size, k + 1 + SPARE).groupBy("query", "rep").agg(F.max("score").alias("score")))
    got = found.groupBy("query").agg(F.count("*").alias("reps"))
    # queries that met too few classes: all there are, in blocks
    short = asked.join(got, asked["query_id"] == got["query"], "left").where(F.coalesce("reps", F.lit(0)) < min(k + 1, total))
    if not short.isEmpty():
        found = found.unionByName(_blocks(_lone(classes, size, False), _lone(short, size, True), size, k + 1 + SPARE))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1 + SPARE).drop("score")
    exact = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    top = top.join(classes.select("rep", "ids", "v"), "rep").join(asked.select(F.col("query_id").alias("query"), F.col("v").alias("w")), "query").withColumn("score", exact)
    each = top.select("query", F.explode("ids").alias("vec_id"), "score").where("query <> vec_id")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
