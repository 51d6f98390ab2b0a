"""Phrases whose words occur together far more often than apart, per language.

Only the longest window at each word is counted: the word and the four that
follow it in its piece, as columns, padded with nulls. One ``ROLLUP`` over the
counted windows then sums them by shorter and shorter prefixes, which gives the
count of every phrase of one to five words, and the number of words, without a
pass for each length.

A phrase that is frequent enough consists of pairs and triples of neighbours that
are, so a window ends (is padded) before the first pair or triple that can't be.
Which can't is told by two sieves: pairs, then triples of pairs that pass, are
hashed into buckets, the buckets counted, and what is in a bucket under the
threshold is rare for certain. A sieve has a bucket for 8 words, 2^``MOST_BITS``
at most; where it is too small, more windows stay long, and nothing else changes.

Null texts have no words, a null language is ``und``, a text may be of any
length; extra columns are ignored; without words there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.textkit import LOWER, U64, chunks, cut, mix, word_hashes, words

#: Words of the longest window.
LONGEST = 5
#: Buckets of a sieve: 2^16 at least, 2^28 (a bitmap of 32 MB, broadcast) at most. Their counts are shuffled in 2^10 parts, so that rows grow with the text alone.
LEAST_BITS, MOST_BITS, PARTS = 16, 28, 10
#: Languages whose totals are broadcast at most.
BROADCAST = 10_000
#: Bytes of text that are counted together before they are shuffled.
AT_ONCE = 2 << 20
#: What ends a piece, besides line ends.
STOPS = b".,;:!?\n\x0b\x0c\r"
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[list(STOPS)] = True
_IS_WORD = ~_SEPARATES
_IS_WORD[[32, 9]] = False
W = [f"w{i + 1}" for i in range(LONGEST)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Runs of documents: lower-cased bytes, start, end and hash of each word, languages, the number of each word's language and, negated, whether the next word continues its piece."""
    for b in batches:
        for rows, buf, off in chunks(b, limit=AT_ONCE):
            low = LOWER[buf]
            starts, ends, first = words(low, off, _IS_WORD)
            if len(starts) == 0:
                continue
            lang = pc.dictionary_encode(rows.column(rows.schema.get_field_index("lang")))
            of = np.repeat(lang.indices.to_numpy(), np.diff(first)).astype(np.int64)
            before = np.cumsum(_SEPARATES[low], dtype=np.int32)  # a word holds none
            joined = np.zeros(len(starts), dtype=bool)
            joined[:-1] = before[starts[1:]] == before[starts[:-1]]
            joined[first[1:][first[1:] > 0] - 1] = False
            yield low, starts, ends, of, lang.dictionary.to_pylist(), joined


Sieves = list[tuple[int, np.ndarray]]


def _after(x: np.ndarray, k: int) -> np.ndarray:
    """What stands k places on, 0 beyond the end."""
    return np.append(x[k:], np.zeros(min(k, len(x)), x.dtype))


def _lasting(hashes: np.ndarray, of: np.ndarray, langs: list[str], joined: np.ndarray, sieves: Sieves, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Whether the phrase of 2, 3, ... longest words that begins at each word stays in its piece and passes the sieves of its length and of all phrases within it; and hashes of the longest one."""
    seed = np.array([int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") ^ (len(x) << 56) for x in langs], dtype=np.uint64)
    key, out = mix(hashes ^ mix(seed)[of]), []
    for k in range(2, longest + 1):
        alive = joined.copy() if k == 2 else out[-1] & _after(out[-1], 1)
        if k - 2 <= len(sieves):
            key = mix(key * U64(0x9E3779B97F4A7C15) + _after(hashes, k - 1))
        if k - 2 < len(sieves):
            bits, passed = sieves[k - 2]
            at = np.flatnonzero(alive)
            bucket = (key[at] >> U64(64 - bits)).astype(np.int64)
            alive[at] = passed[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1
        out.append(alive)
    return out, key


def _counted(bits: int, least: int, held: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the buckets of phrases of k words: for each of 2^PARTS parts of all buckets a row with those that occur, their place in the part (3 bytes) and count (1 byte, ``least`` at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, inner = min(least, 255), U64(bits - PARTS)
        for low, starts, ends, of, langs, joined in _runs(batches):
            alive, key = _lasting(word_hashes(low, starts, ends), of, langs, joined, held.value, k)
            got, n = np.unique(key[alive[-1]] >> U64(64 - bits), return_counts=True)
            packed = ((got & ((U64(1) << inner) - U64(1))) << U64(8) | np.minimum(n, most).astype(np.uint64)).astype("<u4")
            part = (got >> inner).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            off = np.append(cuts, len(got)).astype(np.int32) * 4
            blob = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(off), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), blob], names=["part", "counts"])

    return run


def _passed(bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The buckets of each part that reach the threshold, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= min(least, 255), bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, total = part, np.zeros(1 << bits - PARTS, np.int64)
                x = np.frombuffer(blob.as_buffer(), "<u4")
                total[x >> 8] += x & 255
        if now is not None:
            yield done()

    return run


def sieve(docs: DataFrame, least: int, bits: int, held: Broadcast, k: int) -> np.ndarray:
    """A bitmap of 2^bits buckets of phrases of k words: those in which ``least`` of them or more fall, of phrases that pass the sieves before."""
    counts = docs.mapInArrow(_counted(bits, least, held, k), "part long, counts binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passed = counts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_passed(bits, least), "part long, bits binary")
    out = np.zeros((1 << PARTS, 1 << bits - PARTS - 3), np.uint8)
    for part, got in passed.collect():
        out[part] = np.frombuffer(got, np.uint8)
    return out.ravel()


def _dense(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word among the distinct ones, and where each of these first stands. By hash, and then byte by byte, so that no two words share a number."""
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first][ids]
    if same.all():
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = low[np.repeat(starts, size) + place] == low[np.repeat(starts[first][ids], size) + place]
    if not same.all():
        seen: dict[bytes, int] = {}
        raw = low.tobytes()
        ids = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(ids, return_index=True)[1]
    return ids.astype(np.int64), first


def _windows(held: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, w1 to w5, n: the longest windows of each run of documents, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, starts, ends, of, langs, joined in _runs(batches):
            hashes = word_hashes(low, starts, ends)
            ids, first = _dense(low, starts, ends, hashes)
            alive, _ = _lasting(hashes, of, langs, joined, held.value, LONGEST)
            cols = [ids + 1, *(np.where(a, _after(ids + 1, k + 1), 0) for k, a in enumerate(alive))]
            # single words, most of all, are counted by their numbers; longer windows by theirs, of 21 bits each
            single = cols[1] == 0
            n = np.bincount(of[single] * (len(first) + 1) + cols[0][single], minlength=1)
            at = np.flatnonzero(n)
            out = [np.stack([at // (len(first) + 1), at % (len(first) + 1), *[np.zeros_like(at)] * (LONGEST - 1), n[at]])]
            rows = np.stack([of, *cols])[:, ~single]
            if rows.shape[1]:
                order = np.lexsort(rows[::-1])
                rows = rows[:, order]
                new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))
                at = np.flatnonzero(new)
                out.append(np.vstack([rows[:, at], np.diff(np.append(at, rows.shape[1]))]))
            got = np.concatenate(out, axis=1)
            raw = low.tobytes()
            names = pa.array([None, *(raw[a:z].decode() for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True))], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(got[0])), *[names.take(pa.array(got[1 + k])) for k in range(LONGEST)], pa.array(got[-1])], names=["lang", *W, "n"])

    return run


def phrase_counts(docs: DataFrame, least: int, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, size, phrase, f: counts of the phrases of 1 to 5 words that occur ``least`` times or more, and, as size 0, of all words of a language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(min(max(int(size // 48).bit_length(), LEAST_BITS), most_bits), PARTS + 3)  # a word is six bytes or so
    share = docs.sparkSession.sparkContext.broadcast
    pairs = [(bits, sieve(texts, least, bits, share([]), 2))]
    sieves = [*pairs, (bits, sieve(texts, least, bits, share(pairs), 3))]
    windows = texts.mapInArrow(_windows(share(sieves)), "lang string, " + "".join(f"{w} string, " for w in W) + "n long").groupBy("lang", *W).agg(F.sum("n").alias("n"))
    summed = windows.rollup("lang", *W).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # at each level the last word that is still there must be one: else its windows had ended, and belong to shorter phrases
    levels = {(1 << LONGEST - k) - 1: k for k in range(LONGEST + 1)}
    size_ = reduce(lambda c, x: c.when(F.col("g") == x[0], x[1]), levels.items(), F.when(F.lit(False), 0))
    real = reduce(lambda c, k: c.when(F.col("size") == k, F.col(W[k - 1]).isNotNull()), range(1, LONGEST + 1), F.when(F.col("size") == 0, True))
    rows = summed.withColumn("size", size_).where(F.col("size").isNotNull() & real & ((F.col("f") >= least) | (F.col("size") == 0)))
    inner = F.slice(F.array(*W), F.lit(1), F.col("size"))
    return rows.select("lang", "size", F.array_join(inner, " ").alias("phrase"), "f")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of two to five words.

    A phrase that occurs a times, ``least`` or more, is cut in two parts (l and r
    times) where a * n / (l * r) is lowest; its score is a thousand times that,
    rounded down. Phrases within a longer one that has ``percent`` of their count
    are left out.
    """
    f = cut(phrase_counts(docs, least, most_bits))
    total = f.where("size = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    part = lambda what: f.where("size between 1 and 4").select(F.col("lang").alias(f"{what}_lang"), F.col("phrase").alias(f"{what}_phrase"), F.col("f").alias(what))
    phrases = f.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    said = lambda i, k: F.array_join(F.slice(w, i, k), " ")
    # a longer phrase tells all within it how frequent it is
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: said(i, k))))
    covered = phrases.where("size > 2").select(F.col("lang").alias("_in"), F.explode(F.array_distinct(within)).alias("_phrase"), "a").groupBy("_in", "_phrase").agg(F.max("a").alias("longer"))
    left = phrases.join(covered, (F.col("lang") == F.col("_in")) & (F.col("phrase") == F.col("_phrase")), "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size").withColumns({"head": said(F.lit(1), F.col("k")), "tail": said(F.col("k") + 1, F.col("size") - F.col("k"))})
    both = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("head") == F.col("l_phrase"))).join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_phrase")))
    both = both.join(F.broadcast(total) if total.count() <= BROADCAST else total, F.col("lang") == F.col("_lang")).withColumns({"over": _wide("a") * _wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": _wide("l") * _wide("r")})
    scored = both.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    out = scored.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first among hashed shares of a language, so that no task sorts a whole one
    some = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
  t AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
  i AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
  x AS (SELECT lang, w AS w1, {", ".join(f"lead(w, {k}) OVER q AS w{k + 1}" for k in range(1, LONGEST))} FROM i WINDOW q AS (PARTITION BY p ORDER BY i)),
  total AS (SELECT lang, count(*) AS n FROM i GROUP BY 1),
  f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lang, {k} AS k, concat_ws(' ', {', '.join(W[:k])}) AS phrase, count(*) AS f FROM x WHERE w{k} IS NOT NULL GROUP BY lang, {', '.join(W[:k])} HAVING count(*) >= 100" for k in range(1, LONGEST + 1))}),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  j AS (SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
  cuts AS (SELECT j.lang, j.phrase, a, j, l.f AS l, r.f AS r, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, n
    FROM j JOIN total USING (lang) JOIN f l ON l.lang = j.lang AND l.phrase = head JOIN f r ON r.lang = j.lang AND r.phrase = tail),
  s AS (SELECT lang, phrase, any_value(a) AS a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, any_value(n) AS n, min(score) AS score FROM cuts GROUP BY 1, 2),
  v AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
  kept AS (SELECT s.* FROM s LEFT JOIN v USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000"""
