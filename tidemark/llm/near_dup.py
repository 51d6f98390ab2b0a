"""Near duplicates among documents: SetSketch registers, banded, then verified.

A document's set is its distinct ``k``-word shingles. Its sketch is ``REGISTERS``
truncated minima on an exponential scale (``floor(1 - log_b(min))``): the sketch
of a union is the element-wise maximum, and equal sets have equal sketches.
Bands of ``ROWS`` register values are bucket keys. Within a bucket the joint
likelihood of two sketches (how many registers are larger, smaller, equal)
estimates the Jaccard similarity; documents whose estimate is no more than
``MARGIN`` (over four standard errors) below the threshold form candidate
clusters. Within a cluster links are confirmed on the full sets.

Scale. Equal sets are one class before anything is compared, so copies never
meet each other. A bucket is compared in parts of ``BUCKET`` rows, dealt out
anew for every band. A part compares whatever isn't in its largest cluster with
all of the part, so a group of near copies costs one comparison a row. One row
of each of its clusters goes on: to a bucket of those, or, where these are too
many (texts of one template that aren't near each other), to ``DEEPER`` buckets
by further registers, until all fit. So texts below the threshold part company
rather than pile up. Clusters are compared in blocks of bounded size: first each block
within itself and with the cluster's centre; then only what is not yet in the
cluster's largest component is compared with the other blocks. No pairs of a
group are listed; what each block returns is at most a link per document.
Components are found by joins.

Null and empty texts have no shingles and are linked with nothing. Rows with a
null id keep a null component and are kept. Rows that repeat an id each give a
row and count as one document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.textkit import LOWER, chunks, cut, grouped, mix, shingle_sets, word_hashes, words

REGISTERS = 256
#: Base of the exponential scale; register values fit a byte for 32-bit minima.
BASE = 1.1
ROWS = 6
BANDS = 40
#: Sketches whose estimate is at most so far below the threshold are in one cluster.
MARGIN = 0.12
#: Most documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Rows of a bucket that are compared together, and the buckets by further registers that a row of a fuller one goes to.
BUCKET, DEEPER = 512, 8

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
#: Each band's registers.
_DEALT = _RNG.permutation(REGISTERS)[: BANDS * ROWS].reshape(BANDS, ROWS)


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    x = (items >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = _A * x[None, i : i + 2048] + _B
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=1), out=least)
    waited = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(waited) / np.log(BASE)), 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    """How likely one register is to be larger, for a surplus of x of the union's weight."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 41)


def similarity(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows), given the sets' sizes."""
    more = (a > b).sum(axis=-1)[..., None]
    less = (a < b).sum(axis=-1)[..., None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[..., None].astype(np.float64)
    v = 1 - u
    j = _GRID * np.minimum(u / v, v / u)
    plus, minus = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
    score = more * np.log(plus) + less * np.log(minus) + same * np.log(np.maximum(1 - plus - minus, 1e-12))
    return np.take_along_axis(j, score.argmax(axis=-1)[..., None], axis=-1)[..., 0]


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary())])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Of each row: id, set size, a 128-bit fingerprint of the set, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in chunks(b):
                low = LOWER[buf]
                starts, ends, first = words(low, off)
                n, s1, s2, regs = [], [], [], []
                for x in shingle_sets(word_hashes(low, starts, ends), first, k):
                    n.append(len(x))
                    s1.append(int(x.sum().astype(np.int64)))
                    s2.append(int(mix(x).sum().astype(np.int64)))
                    regs.append(sketch(x).tobytes() if len(x) else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t.type) for x, t in zip((n, s1, s2, regs), list(_SIGNED)[1:], strict=True))], schema=_SIGNED)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary")


def _packed(regs: np.ndarray, columns: np.ndarray) -> np.ndarray:
    packed = np.zeros(len(regs), np.uint64)
    for c in columns:
        packed = (packed << np.uint64(8)) | regs[:, c].astype(np.uint64)
    return packed


_KEYED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])


def _band_keys(classes: DataFrame) -> DataFrame:
    """key, doc_id for each band of each class."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for i, cols in enumerate(_DEALT):
                    yield pa.RecordBatch.from_arrays([pa.array(mix(_packed(regs, cols) ^ salt[i]).view(np.int64)), b.column(0)], schema=_KEYED)

    return classes.select("doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def _next_keys(rows: DataFrame, depth: int) -> DataFrame:
    """rows: key, many, doc_id, regs. One bucket for the rows of a key that fit in one, else ``DEEPER`` by further registers."""
    rng = np.random.default_rng(1000 + depth)
    columns = [rng.permutation(REGISTERS)[:ROWS] for _ in range(DEEPER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, many = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            one = pa.array(~many)
            yield pa.RecordBatch.from_arrays([pa.array(mix(key[~many] + np.uint64(depth)).view(np.int64)), b.column(2).filter(one)], schema=_KEYED)
            docs = b.column(2).filter(pa.array(many))
            for i, cols in enumerate(columns):
                deep = mix(mix(key[many] + np.uint64(i + 1)) ^ _packed(regs[many], cols))
                yield pa.RecordBatch.from_arrays([pa.array(deep.view(np.int64)), docs], schema=_KEYED)

    return rows.select("key", "many", "doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def _near(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs have an estimate of least or more; only those with nearly as many equal registers are estimated."""
    ok = (a == b).sum(axis=-1) >= (least - 0.06) * REGISTERS
    if ok.any():
        of = lambda x: np.broadcast_to(x, (len(ok), *np.shape(x)[1:]) if np.ndim(x) == 2 else (len(ok),))[ok]
        ok[ok] = similarity(of(a), of(n_a), of(b), of(n_b)) >= least
    return ok


def _compare_bucket(docs: np.ndarray, n: np.ndarray, regs: np.ndarray, first: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join whatever may be similar among rows, and one row of each cluster. first: whether each row may be similar to row 0."""
    links = [(int(docs[i]), int(docs[0])) for i in np.flatnonzero(first) if i]
    of = np.where(first, 0, np.arange(len(docs)))
    of[0] = 0
    asked = np.zeros(len(docs), bool)
    asked[0] = True
    while True:
        # pairs within the largest cluster need no answer; of all others one side is asked
        todo = np.flatnonzero(~asked & (of != np.bincount(of).argmax()))
        if not len(todo):
            break
        c = int(todo[0])
        asked[c] = True
        near = np.flatnonzero(_near(regs[c][None], n[c : c + 1], regs, n, least))
        for other in np.unique(of[near]).tolist():
            if other != of[c]:
                links.append((int(docs[near[of[near] == other][0]]), int(docs[c])))
                of[of == other] = of[c]
    return links, docs[np.unique(of)].tolist()


def _bucket_pass(rows: DataFrame, least: float) -> DataFrame:
    """rows: key, salt, n_salts, doc_id, n, regs. Returns u, v of links (key null), and of buckets in several parts a row u of each cluster (with key)."""
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "salt"]):
            key, salt, parts, docs, n = (t.column(c).to_numpy() for c in ("key", "salt", "n_salts", "doc_id", "n"))
            regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.append(at[1:], len(key))
            head = np.repeat(at, ends - at)
            first = np.concatenate([_near(regs[i : i + 4096], n[i : i + 4096], regs[head[i : i + 4096]], n[head[i : i + 4096]], least) for i in range(0, len(key), 4096)])
            first[at] = True
            simple = np.logical_and.reduceat(first, at)  # groups that are near their first row
            whole = np.repeat(simple, ends - at) & (head != np.arange(len(key)))
            keys: list[int | None] = [None] * int(whole.sum())
            us, vs = docs[whole].tolist(), docs[head[whole]].tolist()
            some = at[simple & (parts[at] > 1)]
            keys += key[some].tolist()
            us += docs[some].tolist()
            vs += docs[some].tolist()
            for g in np.flatnonzero(~simple).tolist():
                i, j = at[g], ends[g]
                links, go_on = _compare_bucket(docs[i:j], n[i:j], regs[i:j], first[i:j], least)
                keys += [None] * len(links)
                us += [x[0] for x in links]
                vs += [x[1] for x in links]
                if parts[i] > 1:
                    keys += [int(key[i])] * len(go_on)
                    us += go_on
                    vs += go_on
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id").mapInArrow(run, "key long, u long, v long")


def candidate_links(classes: DataFrame, least: float) -> DataFrame:
    """u, v: links that put classes whose estimate is least or more into one cluster. classes: doc_id, n, regs."""
    keys = _band_keys(classes)
    links = None
    depth = 0
    while True:
        size = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("n_salts", F.ceil(F.col("size") / BUCKET).cast("int"))
        # the members of buckets with company, then their sketches
        rows = keys.join(size, "key").withColumn("salt", F.when(F.col("n_salts") > 1, F.pmod(F.xxhash64("doc_id", "key"), "n_salts").cast("int")).otherwise(0)).join(classes, "doc_id")
        found = cut(_bucket_pass(rows.select("key", "salt", "n_salts", "doc_id", "n", "regs"), least))
        new = found.where("key is null").select("u", "v")
        links = new if links is None else links.unionByName(new)
        on = found.where("key is not null").select("key", F.col("u").alias("doc_id")).distinct()
        if on.isEmpty():
            return links.distinct()
        # each bucket has fewer rows than before, and in the end all fit: rows that no further register tells apart are one cluster
        depth += 1
        many = on.groupBy("key").agg((F.count("*") > BUCKET).alias("many"))
        keys = cut(_next_keys(on.join(many, "key").join(classes, "doc_id"), depth))


class _Sets:
    """The sets of a block, by shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have a Jaccard similarity of percent / 100 or more with s."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return 100 * common >= percent * (self.sizes + len(s) - common)


def _shingled(docs: DataFrame, k: int) -> DataFrame:
    """docs: rows with text and others; the set of each text as bytes, in its place."""
    rest = [c for c in docs.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, buf, off in chunks(b):
                low = LOWER[buf]
                starts, ends, first = words(low, off)
                sets = [x.tobytes() for x in shingle_sets(word_hashes(low, starts, ends), first, k)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(sets, pa.binary())], names=[*rest, "items"])

    return docs.select(*rest, "text").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in rest), "items binary"]))


def _blocks_pass(rows: DataFrame, percent: int) -> DataFrame:
    """rows: cluster, block, part, doc_id, comp, asks, items. Within each (cluster, block, part) the rows that ask are compared with all others. Returns links u, v between rows of different components, at most one a row and component."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["cluster", "block", "part"]):
            cluster, block, part = (t.column(c).to_numpy() for c in ("cluster", "block", "part"))
            docs, comp, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp", "asks"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            at = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])]))
            us: list[int] = []
            vs: list[int] = []
            for i, j in zip(at.tolist(), np.append(at[1:], len(docs)).tolist(), strict=True):
                own = _Sets(sets[i:j])
                c, d = comp[i:j].copy(), docs[i:j]
                ask = np.flatnonzero(asks[i:j])
                for q in ask.tolist():
                    if (c == c[q]).all():
                        continue
                    near = own.linked(sets[i + q], percent) & (c != c[q])
                    for other in np.unique(c[near]).tolist():
                        v = int(np.argmax(near & (c == other)))
                        us.append(int(d[q]))
                        vs.append(int(d[v]))
                        c[c == other] = c[q]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return rows.repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", F.desc("first"), "doc_id").drop("first").mapInArrow(run, "u long, v long")


def links(docs: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: confirmed links that join all linked documents. docs: doc_id, text; clusters: doc_id, n, cluster."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    size = size.withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK_DOCS, F.col("weight") / BLOCK_SHINGLES)).cast("int"))
    members = clusters.join(size, "cluster").select("doc_id", "cluster", "blocks", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).otherwise(0).alias("block"))
    texts = docs.join(members, "doc_id")
    sets = cut(_shingled(texts.select("doc_id", "cluster", "blocks", "block", "text"), k))
    centre = F.col("doc_id") == F.col("cluster")  # a cluster's name is its smallest member
    every = sets.select("cluster", "block", F.lit(0).alias("part"), "doc_id", F.col("doc_id").alias("comp"), F.lit(True).alias("asks"), centre.alias("first"), "items")
    spread = sets.where(centre & (F.col("blocks") > 1)).select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "block", "doc_id", "items").where("to <> block")
    spread = spread.select("cluster", F.col("to").alias("block"), F.lit(0).alias("part"), "doc_id", F.col("doc_id").alias("comp"), F.lit(True).alias("asks"), F.lit(True).alias("first"), "items")
    found = cut(_blocks_pass(every.unionByName(spread), percent))
    if sets.where("blocks > 1").isEmpty():
        return found
    # clusters of several blocks: what is outside the largest component meets the other blocks
    comp = components(found)
    large = sets.where("blocks > 1").join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    large = cut(large)
    main = large.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
    placed = large.join(main, "cluster")
    asking = placed.where("comp <> main")
    ways = asking.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.octet_length("items")) / (8 * BLOCK_SHINGLES))).cast("int").alias("parts"))
    sides = lambda df, asks: df.select("cluster", "block", "part", "doc_id", "comp", F.lit(asks).alias("asks"), F.lit(False).alias("first"), "items")
    there = placed.join(ways, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    coming = asking.join(ways, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return found.unionByName(_blocks_pass(sides(there, False).unionByName(sides(coming, True)), percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (the smallest itself) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(signatures(docs, k))
    sets = signed.where("n > 0 and doc_id is not null")
    equal = sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    members = sets.join(equal, ["s1", "s2", "n"])
    classes = cut(members.where("doc_id = rep").groupBy("doc_id", "s1", "s2", "n").agg(F.first("regs").alias("regs")))  # equal sets have equal registers
    weights = classes.groupBy("doc_id").agg(F.sum("n").alias("n"))
    clusters = components(candidate_links(classes, percent / 100 - MARGIN)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(weights, "doc_id")
    near = links(docs, clusters, k, percent)
    edges = near.unionByName(members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    comp = components(edges).select(F.col("node").alias("doc_id"), "component")
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(comp, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def oracle_sql(k: int, percent: int) -> str:
    """DuckDB SQL for near_duplicates over documents: all pairs that share a shingle, then reachability."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
    u AS (SELECT doc_id, unnest(sh) AS x FROM s), n AS (SELECT doc_id, len(sh) AS n FROM s),
    p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT i, j FROM p JOIN n na ON na.doc_id = i JOIN n nb ON nb.doc_id = j WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
    r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT e.j, r.comp FROM r JOIN e ON e.i = r.node)
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT node AS doc_id, min(comp) AS component_id FROM r GROUP BY 1) JOIN n USING (doc_id)"""
