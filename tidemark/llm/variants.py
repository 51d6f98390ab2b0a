"""Words that differ by one inserted, deleted or replaced code point, and the usual form of each.

The words are put in order, and the nodes of their trie are numbered in that
order; so are those of the trie of the reversed words. A word of length L whose
i-th code point is skipped is the pair (node of its first i, node of its last
L - i - 1), and the word whole is, for each i, the pair (node of its first i,
node of its last L - i). Two words differ by a replaced code point if they skip
into the same pair, and by an inserted one if one skips into a pair that the
other has whole. As pairs are integers, a key's size doesn't depend on the
words' lengths, and a word makes 2 L + 1 of them at most. A node that only one
word passes through can't be in a pair of two, so only pairs of shared nodes are
made. The words of one pair differ at one place, so they are as many as there are
letters, at most.

Null texts have no words; a null id counts as empty text; a word or text may be
of any length; extra columns are ignored; with no words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import cut

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def spoiled(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run, or without one code point where the checksum of id and run is a multiple of ``one_in``: typos whose right form is known."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def corpus_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = None) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, that are long and frequent enough; with ``one_in``, spoiled before they are counted."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOW), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    each = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.explode(runs).alias("run"))
    word = F.col("run") if one_in is None else spoiled(F.col("run"), F.col("id"), one_in)
    return each.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    return sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a, b)))


_LOCAL = "word string, n long, part int, first boolean, last boolean, reach int, leaf long, nodes array<long>, made long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of one partition's ordered keys from 0.

    reach: depth of the deepest node that a neighbour in order shares. nodes: of
    the depths 0 to reach, or all for the partition's first and last word, whose
    neighbours are in other partitions. made: nodes made up to here.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    path: list[int] = []
    made, held, before = 0, None, ""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        names = [x.split()[0] for x in _LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for word, n, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            same = _common(key, before) if path else -1
            if held:
                held[5] = max(held[5], same)
                held[7] = held[7] if held[3] else held[7][: held[5] + 1]
                out.append(tuple(held))
                if len(out) >= 5000:
                    yield batch()
                    out.clear()
            del path[same + 1 :]
            new = len(key) - same
            path.extend(range(made, made + new))
            made, before = made + new, key
            held = [word, n, part, held is None, False, max(same, 0), path[-1], path.copy(), made]
    if held:
        held[4] = True
        out.append(tuple(held))
        yield batch()


def numbered(words: DataFrame, backwards: bool = False) -> DataFrame:
    """word, n, leaf, nodes: the number of each word's last trie node, and of those of its nodes, from the root, that other words share; backwards, in the trie of reversed words.

    The words (distinct) are ranged over partitions, each numbers its own nodes,
    and its first and last word tell how many nodes are before it and which of
    them it shares. Numbers of leaves have the order of the words.
    """
    spark = words.sparkSession
    key = F.reverse("word") if backwards else F.col("word")
    ranged = words.select("word", "n", key.alias("key")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    local = cut(ranged.mapInArrow(_number, _LOCAL))
    base, before, last, path, facts = 0, None, None, [], {}
    for row in local.where("first or last").select("part", "first", "last", "made", "nodes", "word").orderBy("part", "made").collect():  # two rows a partition
        word = row["word"][::-1] if backwards else row["word"]
        if row["first"]:
            shared = _common(word, before) if before is not None else -1
            if last is not None:
                facts[last][3] = shared
            facts[row["part"]] = [base, path[: shared + 1], shared, -1]
        if row["last"]:
            at, cross, shared, _ = facts[row["part"]]
            path = [cross[x] if x <= shared else at + x for x in row["nodes"]]
            before, last, base = word, row["part"], at + row["made"]
    table = spark.createDataFrame([(p, *x) for p, x in facts.items()], "part int, base long, cross array<long>, before int, after int")
    j = local.join(F.broadcast(table), "part")  # a row a partition
    real = lambda x: F.when(x <= F.col("before"), F.get("cross", x.cast("int"))).otherwise(F.col("base") + x)
    reach = F.greatest("reach", F.when(F.col("first"), F.col("before")), F.when(F.col("last"), F.col("after")))
    return j.select("word", "n", real(F.col("leaf")).alias("leaf"), F.transform(F.slice("nodes", 1, reach + 1), real).alias("nodes"))


def _pairs(nodes: DataFrame) -> DataFrame:
    """p, s, leaf, n, kind of each word and place: 0 whole, 1 skipped, 2 skipped where the code point isn't that before it (deleting any of a run of equals gives the same word)."""
    size, i_at = F.char_length("word"), lambda a, i: F.get(a, i.cast("int"))
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    skips = places(F.greatest(size - F.size("back"), F.lit(0)), F.least(size, F.size("nodes")) - 1)
    wholes = places(F.greatest(size - F.size("back") + 1, F.lit(0)), F.least(size + 1, F.size("nodes")) - 1)
    pair = lambda i, j, kind: F.struct(i_at("nodes", i).alias("p"), i_at("back", j).alias("s"), kind.alias("kind"))
    fresh = lambda i: F.when((i == 0) | (i_at("chars", i) != i_at("chars", i - 1)), 2).otherwise(1)
    rows = nodes.withColumn("chars", F.split("word", ""))
    both = F.concat(F.transform(skips, lambda i: pair(i, size - 1 - i, fresh(i))), F.transform(wholes, lambda i: pair(i, size - i, F.lit(0))))
    return rows.select("leaf", "n", F.explode(both).alias("x")).select("x.p", "x.s", "leaf", "n", "x.kind")


def near(nodes: DataFrame) -> DataFrame:
    """leaf, n_near, best (n and negative leaf): of each word that has near words, how many and the most frequent, the first in order of those."""
    groups = _pairs(nodes).groupBy("p", "s").agg(F.collect_list(F.struct("leaf", "n", "kind")).alias("m")).where(F.size("m") > 1)  # as many as letters, at most
    linked = lambda x, y: (x["leaf"] != y["leaf"]) & ((x["kind"] > 0) & (y["kind"] > 0) | (x["kind"] == 2) & (y["kind"] == 0) | (x["kind"] == 0) & (y["kind"] == 2))
    mine = F.transform("m", lambda x: F.struct(x["leaf"].alias("leaf"), F.filter("m", lambda y: linked(x, y)).alias("others")))
    each = groups.select(F.explode(mine).alias("x")).select("x.leaf", F.size("x.others").alias("k"), F.array_max(F.transform("x.others", lambda y: F.struct(y["n"].alias("n"), (-y["leaf"]).alias("minus")))).alias("best"))
    return each.where("k > 0").groupBy("leaf").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """leaf, root: where each chain of forms (leaf, form; no cycles) ends, by joining pointers to pointers, so that rounds are the logarithm of the longest chain."""
    now = cut(forms.select("leaf", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("leaf").alias("_at"), F.col("root").alias("_up"))
        now = cut(now.join(up, F.col("root") == F.col("_at"), "left").select("leaf", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("leaf", "root")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct). A word's form is the most frequent of its near words (ties: the first by code points), if that is at least ``ratio`` times as frequent; its root is where forms of forms end."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    forward = numbered(words)
    back = numbered(words, backwards=True).select("word", F.col("nodes").alias("back"))
    found = cut(near(forward.join(back, "word")))
    base = forward.select("leaf", "word", "n")
    with_near = base.join(found, "leaf", "left")
    formed = F.col("best.n") >= F.col("n") * ratio
    forms = with_near.where(formed).select("leaf", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n"))
    name = lambda what: base.select(F.col("leaf").alias(f"_{what}"), F.col("word").alias(f"{what}_word"))
    chained = forms.join(roots(forms), "leaf").join(name("form"), F.col("form") == F.col("_form")).join(name("root"), F.col("root") == F.col("_root"))
    told = chained.select("leaf", "form_word", "root_word", "form_n")
    return with_near.join(told, "leaf", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _crc_sql(points: str) -> str:
    """The CRC-32 of a list of bytes, in SQL: a byte's table entry is the exclusive or of those of its bits."""
    bits = [0xEDB88320]
    for _ in range(7):
        bits.append(bits[-1] >> 1 ^ (0xEDB88320 if bits[-1] & 1 else 0))
    entry = "0"
    for k in range(8):
        entry = f"xor({entry}, ((xor(c, b) >> {k}) & 1) * {bits[7 - k]})"
    return f"xor(list_reduce({points}, lambda c, b: xor(c >> 8, {entry}), 4294967295::BIGINT), 4294967295)"


def oracle_sql(one_in: int = 199, ratio: int = 5, least_length: int = 6, least_count: int = 5) -> str:
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOW}'), '[{LETTERS}]{{{least_length},}}')) AS run FROM documents),
  u AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
  h AS (SELECT run, c, {_crc_sql("flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))")} AS h FROM u),
  s AS (SELECT CASE WHEN h % {one_in} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
  w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= {least_length} GROUP BY 1 HAVING sum(c) >= {least_count}),
  k AS (SELECT word, n, i, substr(word, 1, i) || '_' || substr(word, i + 2) AS masked, substr(word, 1, i) || substr(word, i + 2) AS shorter FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
  near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.masked = b.masked AND a.word <> b.word
    UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.shorter UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.shorter),
  f AS (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY 1),
  g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {ratio} * n THEN best END AS form, CASE WHEN top >= {ratio} * n THEN top END AS form_n FROM w LEFT JOIN f USING (word)),
  up AS (SELECT word, word AS root, form FROM g UNION ALL SELECT up.word, g.word, g.form FROM up JOIN g ON g.word = up.form)
SELECT g.word, g.form, up.root, g.n, g.n_near, g.form_n FROM g JOIN up ON up.word = g.word AND up.form IS NULL"""
