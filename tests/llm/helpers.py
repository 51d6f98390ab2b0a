"""Small documents with awkward rows: nulls, empty, repeated, long, extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "ou", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs(spark, texts, start=0):
    """texts: strings or None, ids from start; or pairs (id, text)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(df):
    """The same rows with further columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("n", "key", "row", "doc", "cluster", "comp", "component_id", "host", "tree", "rep", "item_id", "kept", "score", "toxic", "ids", "u", "v")})


AWKWARD = [None, "", " \t\n", "one", "one two", "one", "Ünïcödé ßtraße 日本語 😀", "a" * 5000, "x " * 3000, "x " * 3000]
