"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: names (capitalised words, but for usual words that begin
sentences), numbers (digits and number words) and units after digits turn into
typed placeholders, the rest is lower-cased and loses its punctuation. Windows
of ``WINDOW`` template words are hash-joined between texts and benchmark items,
so a question asked again with other names and numbers still meets its original.
Slot consistency is then checked: within each window equal slots of the item
must be equal slots of the text and the other way round, and along an alignment
every item value must stand for one value of the text throughout.

A text holds an item when at least ``NEEDED`` of the item's windows (all, if it
has fewer) are found in consistent alignments. Only windows with ``LITERAL`` or
more words that are no placeholders count; in an item that has none of those,
windows with two such words do, and all must be found. Each item is looked for
twice, with its names as placeholders and with its names as lower-case words, so
that copies without capitals meet it too.

An item of fewer than ``WINDOW`` words is one window by itself: with ``LITERAL``
words or more that are no placeholders it is found anywhere in a text, with
fewer only where it is the whole text.

Texts pass a bitmap of the items' windows before the shuffle. Its size follows
the number of windows up to ``2**MOST_BITS`` bits; it only spares rows of the
join, so results don't depend on it.

Null and empty texts and items match nothing, nor do items that have no window
that counts (bare numbers). Each (doc_id, item_id) found gives one row, however
often rows repeat; rows without an id are never found.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
NEEDED = 6
LITERAL = 5
#: Sizes of the bitmap, as powers of two.
LEAST_BITS, MOST_BITS = 18, 22
#: A list of our own: units that may follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|h|hours?|min|minutes?|s|seconds?|days?|weeks?|months?|years?|miles?|feet|inches|pounds?|dollars?|euros?|cents?|percent|degrees?"
#: A list of our own: words that are numbers ("one" is more often none).
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half twice".split()
#: A list of our own: words that begin sentences and are no names.
STARTS = (
    "a an the this that these those there here it its he she they we you i his her their our your my one if when while after before since because as so but and or nor yet then than how what which who whom whose where why is are was were do does did has have had can could will would shall should may might must "
    "in on at by for from to of off up out with without into over under about between among during per each every all both some any no not now let find calculate compute determine given suppose assume explain write solve show prove choose select answer question problem total also only just"
).split()
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"


def _marked(text: Column) -> Column:
    """The text in lower case, without punctuation, a mark before each capitalised word, number and unit. Words stay words, one for one."""
    t = F.regexp_replace(text, "(^|[^\\p{L}\\p{N}])(\\p{Lu}\\p{Ll}+)", f"$1{NAME}$2")
    t = F.regexp_replace(t, "([0-9]+(?:[.,:/-][0-9]+)*)", f"{NUMBER}$1")
    t = F.regexp_replace(F.lower(t), f"({NUMBER}[0-9.,:/-]+ ?)({UNITS})([^a-z0-9]|$)", f"$1{UNIT}$2$3")
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"[^\\p{{L}}\\p{{N}}{NAME}{NUMBER}{UNIT}\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+", " "))


def _settled(word: Column) -> Column:
    """A marked word, without the mark where it only begins a sentence, with one where it is a number word."""
    plain = F.when(word.isin([NAME + w for w in STARTS]), F.substring(word, 2, 30)).when(word.isin(NUMBER_WORDS), F.concat(F.lit(NUMBER), word))
    return plain.when(word.isin([NAME + w for w in NUMBER_WORDS]), F.concat(F.lit(NUMBER), F.substring(word, 2, 30))).otherwise(word)


def _words(text: Column) -> Column:
    """An array of one struct, v the words with their marks and w those of the template, or of none for a text without words. A row's struct is made once, whatever is read from it."""
    marked = F.filter(F.transform(F.array(_marked(text)), lambda m: F.struct(m.alias("m"))), lambda t: t["m"] != "")
    settled = F.transform(marked, lambda t: F.struct(F.transform(F.split(t["m"], " "), _settled).alias("v")))
    template = lambda v: F.split(F.regexp_replace(F.array_join(v, " "), f"([{NAME}{NUMBER}{UNIT}])[\\p{{L}}\\p{{N}}]+", "$1"), " ")
    return F.transform(settled, lambda t: F.struct(t["v"].alias("v"), template(t["v"]).alias("w")))


def _has_mark(word: Column) -> Column:
    return word.rlike(f"[{NAME}{NUMBER}{UNIT}]")


def windows(text: Column, keep=None, lengths: tuple[int, ...] = ()) -> Column:
    """An array of (pos, key, slots, n_literal) for a text's windows of ``WINDOW`` words (or all, if it has fewer) and of the other lengths; keep: a condition on the key, checked before slots are read."""
    hashed = F.transform(_words(text), lambda t: F.struct(t["v"].alias("v"), t["w"].alias("w"), F.transform(t["w"], lambda x: F.xxhash64(x)).alias("h")))

    def of(t: Column) -> Column:
        n = F.size(t["w"])

        def each(k: int, starts: Column) -> Column:
            return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.xxhash64(F.slice(t["h"], i + 1, k)).alias("key")))

        found = each(WINDOW, F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))))
        for k in lengths:
            found = F.concat(found, each(k, F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))))
        if keep is not None:
            found = F.filter(found, lambda x: keep(x["key"]))
        slots = lambda x: F.filter(F.slice(t["v"], x["pos"] + 1, x["k"]), _has_mark)
        literal = lambda x: F.size(F.filter(F.slice(t["w"], x["pos"] + 1, x["k"]), lambda w: ~_has_mark(w)))
        return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["key"].alias("key"), slots(x).alias("slots"), literal(x).alias("n_literal"), n.alias("n_words")))

    return F.flatten(F.transform(hashed, of))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, variant (1: names as words), ipos, key, islots, n_words, any_good, n_item, needed of the windows that count."""
    w = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    both = F.explode(F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("t")), F.struct(F.lit(1).alias("variant"), F.lower("text").alias("t")))).alias("y")
    rows = w.select("item_id", both).select("item_id", "y.variant", F.explode(windows(F.col("y.t"))).alias("x"))
    few = F.least(F.lit(LITERAL), F.col("x.n_words"))
    rows = rows.select("item_id", "variant", F.col("x.pos").alias("ipos"), F.col("x.key").alias("key"), F.col("x.slots").alias("islots"), F.col("x.n_words").alias("n_words"), (F.col("x.n_literal") >= few).alias("good"), (F.col("x.n_literal") >= 2).alias("fair"))
    of = rows.groupBy("item_id", "variant").agg(F.bool_or("good").alias("any_good"))
    rows = rows.join(of, ["item_id", "variant"]).where("good or not any_good and fair")
    n = rows.groupBy("item_id", "variant").agg(F.countDistinct("ipos").alias("n_item"))
    return rows.join(n, ["item_id", "variant"]).withColumn("needed", F.when(F.col("any_good"), F.least(F.lit(NEEDED), F.col("n_item"))).otherwise(F.col("n_item"))).drop("good", "fair")


def _bitmap(keys: DataFrame, n: int):
    """A condition on keys that holds for all of these; two bits a key."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, n)))))
    cells = lambda k: (F.shiftrightunsigned(k, 64 - bits), F.shiftrightunsigned(k, 64 - 2 * bits).bitwiseAND((1 << bits) - 1))
    set_ = keys.select(F.explode(F.array(*cells(F.col("key")))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    cell = [0] * (1 << (bits - 6))
    for r in set_.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("x")).collect():  # at most 2**(MOST_BITS - 6) numbers
        cell[r["at"]] = r["x"]
    table = F.split(F.lit(",".join(map(str, cell))), ",").cast("array<bigint>")
    on = lambda b: F.getbit(F.get(table, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1
    return lambda key: on(cells(key)[0]) & on(cells(key)[1])


def _pattern(slots: Column) -> Column:
    return F.transform(slots, lambda s: F.array_position(slots, s))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found), n_item (all that count), share; of the item's two readings the one with more windows found."""
    there = item_windows(items)
    shape = there.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("any_good") & F.col("n_words").between(LITERAL, WINDOW - 1), F.col("n_words"))).alias("lengths")).first()
    texts = docs.where("text is not null and doc_id is not null")
    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(windows(F.col("text").cast("string"), _bitmap(there, shape["n"]), tuple(sorted(shape["lengths"])))).alias("x"))
    found = found.select("doc_id", F.col("x.pos").alias("pos"), F.col("x.key").alias("key"), F.col("x.slots").alias("slots"))
    both = found.join(there, "key").where((F.size("slots") == F.size("islots")) & (_pattern(F.col("slots")) == _pattern(F.col("islots"))))
    # along an alignment, an item's value stands for one value of the text, and the other way round
    line = both.groupBy("doc_id", "item_id", "variant", "n_item", "needed", (F.col("pos") - F.col("ipos")).alias("shift")).agg(
        F.collect_set("ipos").alias("ipos"), F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("slots", "islots")))).alias("pairs")
    )
    even = line.where((F.size("pairs") == F.size(F.array_distinct("pairs.slots"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.islots"))))
    out = even.select("doc_id", "item_id", "variant", "n_item", "needed", F.explode("ipos").alias("ipos")).groupBy("doc_id", "item_id", "variant", "n_item", "needed").agg(F.countDistinct("ipos").alias("n_windows"))
    out = out.where("n_windows >= needed").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_item")).alias("x"))
    return out.select("doc_id", "item_id", "x.n_windows", "x.n_item", F.round(F.col("x.n_windows") / F.col("x.n_item"), 6).alias("share"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Rows without an id stay."""
    hit = contaminated(docs, items).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long") == hit["_held"], "left_anti")


def _sql() -> str:
    listed = lambda words, mark=0: ", ".join(f"chr({mark}) || '{w}'" if mark else f"'{w}'" for w in words)
    marked = lambda col: (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({col}, '(^|[^\\p{{L}}\\p{{N}}])(\\p{{Lu}}\\p{{Ll}}+)', '\\1' || chr(1) || '\\2', 'g'), '([0-9]+(?:[.,:/-][0-9]+)*)', chr(2) || '\\1', 'g')), "
        f"'(\\x02[0-9.,:/-]+ ?)({UNITS})([^a-z0-9]|$)', '\\1' || chr(3) || '\\2\\3', 'g'), '[^\\p{{L}}\\p{{N}}\\x01\\x02\\x03\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
    )
    settled = f"CASE WHEN x IN ({listed(STARTS, 1)}) THEN substr(x, 2) WHEN x IN ({listed(NUMBER_WORDS)}) THEN chr(2) || x WHEN x IN ({listed(NUMBER_WORDS, 1)}) THEN chr(2) || substr(x, 2) ELSE x END"
    words = lambda keys, source: f"""SELECT {keys}, v, list_transform(v, lambda x: regexp_replace(x, '([\\x01\\x02\\x03])[\\p{{L}}\\p{{N}}]+', '\\1', 'g')) AS w
      FROM (SELECT {keys}, list_transform(string_split(m, ' '), lambda x: {settled}) AS v FROM (SELECT DISTINCT {keys}, {marked('text')} AS m FROM {source}) WHERE m <> '')"""  # noqa: E731
    slots = "list_filter(v[{p} + 1:{p} + {k}], lambda x: regexp_matches(x, '[\\x01\\x02\\x03]'))"
    return f"""
    WITH iw AS ({words('item_id, variant', "(SELECT item_id, 0 AS variant, text FROM benchmark UNION ALL SELECT item_id, 1, lower(text) FROM benchmark) WHERE text IS NOT NULL AND item_id IS NOT NULL")}),
    i0 AS (SELECT item_id, variant, ipos, array_to_string(w[ipos + 1:ipos + {WINDOW}], ' ') AS win, {slots.format(p='ipos', k=WINDOW)} AS islots, len(w) AS n_words,
           len(list_filter(w[ipos + 1:ipos + {WINDOW}], lambda x: NOT regexp_matches(x, '[\\x01\\x02\\x03]'))) AS n_literal
           FROM (SELECT *, unnest(range(0, greatest(len(v) - {WINDOW}, 0) + 1)) AS ipos FROM iw)),
    i1 AS (SELECT *, n_literal >= least({LITERAL}, n_words) AS good, bool_or(n_literal >= least({LITERAL}, n_words)) OVER (PARTITION BY item_id, variant) AS any_good FROM i0),
    i2 AS (SELECT * FROM i1 WHERE good OR (NOT any_good AND n_literal >= 2)),
    i AS (SELECT i2.*, n_item, CASE WHEN any_good THEN least({NEEDED}, n_item) ELSE n_item END AS needed FROM i2 JOIN (SELECT item_id, variant, count(DISTINCT ipos) AS n_item FROM i2 GROUP BY ALL) USING (item_id, variant)),
    k AS (SELECT {WINDOW} AS k UNION SELECT DISTINCT n_words FROM i WHERE any_good AND n_words BETWEEN {LITERAL} AND {WINDOW - 1}),
    d AS (SELECT doc_id, pos, k, array_to_string(w[pos + 1:pos + k], ' ') AS win, {slots.format(p='pos', k='k')} AS slots
          FROM (SELECT *, unnest(range(0, CASE WHEN k = {WINDOW} THEN greatest(len(v) - k, 0) + 1 ELSE greatest(len(v) - k + 1, 0) END)) AS pos FROM ({words('doc_id', 'documents WHERE text IS NOT NULL AND doc_id IS NOT NULL')}), k)),
    m AS (SELECT doc_id, item_id, variant, n_item, needed, pos - ipos AS shift, ipos, slots, islots FROM d JOIN i USING (win)
          WHERE len(slots) = len(islots) AND list_transform(slots, lambda s: list_position(slots, s)) = list_transform(islots, lambda s: list_position(islots, s))),
    p AS (SELECT doc_id, item_id, variant, shift, unnest(slots) AS a, unnest(islots) AS b FROM m),
    bad AS (SELECT doc_id, item_id, variant, shift FROM p GROUP BY ALL HAVING count(DISTINCT (a, b)) <> count(DISTINCT a) OR count(DISTINCT (a, b)) <> count(DISTINCT b)),
    ok AS (SELECT m.* FROM m ANTI JOIN bad USING (doc_id, item_id, variant, shift)),
    o AS (SELECT doc_id, item_id, variant, n_item, count(DISTINCT ipos) AS n_windows FROM ok GROUP BY doc_id, item_id, variant, n_item, needed HAVING count(DISTINCT ipos) >= needed)
    SELECT doc_id, item_id, x.n_windows AS n_windows, x.n_item AS n_item, round(x.n_windows / x.n_item, 6) AS share
    FROM (SELECT doc_id, item_id, max({{'n_windows': n_windows, 'n_item': n_item}}) AS x FROM o GROUP BY doc_id, item_id)"""


ORACLE_SQL = _sql()
