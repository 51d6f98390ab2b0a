"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words (letters, digits and non-ASCII characters, A-Z
lower-cased) and their beginnings, hashed into ``2**18`` buckets. Features are
the buckets that stand clearly more often in toxic training texts, or in
others, and both parts of each pair of frequent buckets that stands together
more often in toxic texts than either part alone lets expect; a
factorization machine (bias, a weight per feature, and a ``rank``-vector per
feature whose inner products weigh pairs of features) is trained on them with
Adam on the logistic loss. Pairs thus count in their own right, beyond what
their parts weigh alone.

The machine is fitted on a bounded sample of labelled rows, at most
``sample`` for each label, chosen by a hash of the id; prior odds come from all
labelled rows. Every text is scored whole. Null and empty texts get the bias
alone. Conflicting labels of one id count as toxic. Without labels of both
kinds all scores are the prior. Each row gives one row.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import LOWER, chunks, crc_mod, cut, mix, word_hashes, words

BITS = 18
#: Lengths in bytes of the word beginnings that count as terms.
PREFIXES = (6, 7)
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[48:58] = IS_TERM[97:123] = IS_TERM[128:] = True


def term_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each term."""
    low = LOWER[buf]
    starts, ends, first = words(low, off, IS_TERM)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    hashes, docs = [word_hashes(low, starts, ends)], [doc]
    for size in PREFIXES:
        long = ends - starts > size
        hashes.append(mix(word_hashes(low, starts[long], starts[long] + size) + np.uint64(size)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def sampled_labels(labels: DataFrame, sample: int) -> tuple[DataFrame, list[int]]:
    """At most ``sample`` labelled ids of each kind outside the held-out fold, and how many rows there are of each."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by = F.xxhash64("doc_id")
    parts = [one.where(F.col("toxic") == y).orderBy(by, "doc_id").limit(sample) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), [n.get(0, 0), n.get(1, 0)]


def _sample_terms(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """toxic and the distinct term buckets of each sampled text."""
    schema = pa.schema([("toxic", pa.int32()), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in chunks(b):
                doc, bucket = term_buckets(buf, off)
                both = np.unique((doc << BITS) | bucket)
                at = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
                terms = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((both & (2**BITS - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), terms], schema=schema)

    # the sample is bounded, whatever the corpus: its ids go to the texts
    return docs.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, terms array<int>")


class Machine:
    def __init__(self, feature: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.feature, self.bias, self.weight, self.factor = feature, bias, weight, factor

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts, from the document and number of each distinct feature present."""
        z = self.bias + np.bincount(doc, self.weight[feature], n)
        for v in self.factor.T:
            s = np.bincount(doc, v[feature], n)
            z += 0.5 * (s * s - np.bincount(doc, v[feature] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_machine(x: np.ndarray, y: np.ndarray, importance: np.ndarray, feature: np.ndarray, bias: float, rank: int = 8, steps: int = 2500, seed: int = 5) -> Machine:
    """Adam on the weighted logistic loss with a small decay, so many batches long however many texts there are; x: texts by features, 0 or 1."""
    rng = np.random.default_rng(seed)
    m = x.shape[1]
    p = [np.array([bias]), np.zeros(m), rng.normal(0, 0.02, (m, rank))]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(math.ceil(steps / math.ceil(len(y) / 512))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 512):
            rows = order[i : i + 512]
            a = x[rows].astype(np.float64)
            s = a @ p[2]
            z = p[0] + a @ p[1] + 0.5 * ((s * s).sum(axis=1) - a @ (p[2] ** 2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * importance[rows] / len(rows)
            grads = [np.array([g.sum()]), a.T @ g + 1e-5 * p[1], a.T @ (g[:, None] * s) - p[2] * (a.T @ g)[:, None] + 1e-4 * p[2]]
            step += 1
            for q, f, v, d in zip(p, first, second, grads, strict=True):
                f += 0.1 * (d - f)
                v += 0.001 * (d * d - v)
                q -= 0.02 * (f / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(feature, float(p[0][0]), p[1], p[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, features: int = 1024, least_texts: int = 6, least_z: float = 5.0, least_lift: float = 2.0, rank: int = 8, pair_terms: int = 1024) -> Machine:
    """A machine for ``labels.toxic``, from docs (doc_id, text)."""
    chosen, n = sampled_labels(labels, sample)
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    number = np.full(2**BITS, -1, np.int32)
    if not n[0] or not n[1]:
        return Machine(number, prior, np.zeros(0), np.zeros((0, rank)))
    # texts that repeat count once, toxic if any copy is
    copies = _sample_terms(docs, chosen).groupBy(F.xxhash64("terms").alias("copy"), "terms").agg(F.max("toxic").alias("toxic"))
    terms = cut(copies.select("toxic", "terms"))
    size = {r["toxic"]: r["n"] for r in terms.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Machine(number, prior, np.zeros(0), np.zeros((0, rank)))
    seen = terms.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(1 - F.col("toxic")).alias("d0"), F.sum("toxic").alias("d1")).where(F.col("d0") + F.col("d1") >= least_texts).toArrow().sort_by("term")  # at most 2**18 rows
    term, d0, d1 = (seen[c].to_numpy() for c in ("term", "d0", "d1"))
    p0, p1 = d0 / n0, d1 / n1
    z = _lean(p0, p1, n0, n1)
    toxic = np.flatnonzero((d1 >= least_texts) & (z >= least_z) & (p1 >= least_lift * p0))
    clean = np.flatnonzero((z <= -least_z) & (p0 >= least_lift * p1))
    chosen_ = np.concatenate([toxic[np.argsort(-z[toxic], kind="stable")][: features // 2], clean[np.argsort(z[clean], kind="stable")][: features // 4]])
    usual = np.argsort(-(d0 + d1), kind="stable")[:pair_terms]
    some = np.unique(np.concatenate([chosen_, usual]))
    number[term[some]] = np.arange(len(some))
    rows = _picked(terms, number).toArrow()  # at most 2 * sample rows, of at most pair_terms + features numbers
    every = rows.column("features").combine_chunks()
    every = every.chunk(0) if isinstance(every, pa.ChunkedArray) else every
    x = np.zeros((rows.num_rows, len(some)), np.uint8)
    x[np.repeat(np.arange(rows.num_rows), np.diff(every.offsets.to_numpy())), every.flatten().to_numpy()] = 1
    y = rows.column("toxic").to_numpy().astype(np.float64)
    packed = np.packbits(x, axis=1)
    order = sorted(range(len(y)), key=lambda i: (y[i], packed[i].tobytes()))  # in whatever order they came
    x, y = x[order], y[order]
    at = np.searchsorted(some, usual)
    pairs = usual[_paired(x[:, at], y, z[usual], least_texts, least_z, least_lift, features // 8)] if len(usual) else usual
    kept = np.unique(np.concatenate([chosen_, pairs]))
    number[:] = -1
    number[term[kept]] = np.arange(len(kept))
    importance = np.where(y == 1, n[1] / n1, n[0] / n0) * (n0 + n1) / (n[0] + n[1])
    return train_machine(np.ascontiguousarray(x[:, np.searchsorted(some, kept)]), y, importance, number, prior, rank)


def _lean(p0: np.ndarray, p1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How many standard errors the share among toxic texts is above that among others."""
    p = (p0 * n0 + p1 * n1) / (n0 + n1)
    return (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))


def _paired(x: np.ndarray, y: np.ndarray, z: np.ndarray, least_texts: int, least_z: float, least_lift: float, most: int) -> np.ndarray:
    """Columns of x whose joint presence with another column leans toxic clearly more than either does alone, of the most such pairs."""
    both = np.zeros((2, x.shape[1], x.shape[1]), np.float32)
    for i in range(0, len(x), 2000):
        for label in (0, 1):
            a = x[i : i + 2000][y[i : i + 2000] == label].astype(np.float32)
            both[label] += a.T @ a
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    gain = _lean(both[0] / n0, both[1] / n1, n0, n1) - np.maximum(z[:, None], z[None, :])
    ok = (both[1] >= least_texts) & (both[1] / n1 >= least_lift * both[0] / n0) & (gain >= least_z)
    a, b = np.nonzero(np.triu(ok, 1))
    best = np.argsort(-gain[a, b], kind="stable")[:most]
    return np.unique(np.concatenate([a[best], b[best]]))


def _picked(terms: DataFrame, number: np.ndarray) -> DataFrame:
    """The features among each text's terms."""
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            f = number[col.flatten().to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(b.num_rows), np.diff(col.offsets.to_numpy()))
            row, f = row[f >= 0], f[f >= 0]
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f, pa.int32()))], schema=schema)

    return terms.mapInArrow(run, "toxic int, features array<int>")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in chunks(b):
                doc, bucket = term_buckets(buf, off)
                f = machine.feature[bucket]
                both = np.unique((doc[f >= 0] << BITS) | f[f >= 0])
                p = machine.score(both >> BITS, both & (2**BITS - 1), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per text: held_out, score and predicted, with a machine learned from the labels outside the held-out fold."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    machine = fit(texts, labels, **settings)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(texts, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with all their columns; nothing is joined or shuffled for it."""
    machine = fit(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in chunks(b):
                doc, bucket = term_buckets(buf, off)
                f = machine.feature[bucket]
                both = np.unique((doc[f >= 0] << BITS) | f[f >= 0])
                p = machine.score(both >> BITS, both & (2**BITS - 1), part.num_rows)
                yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
