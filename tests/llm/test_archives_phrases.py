"""Archives, collocations and spelling variants against plain Python."""

import base64
import gzip
import hashlib
import io
import json
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, clashing, docs, words
from tidemark.llm import collocations as L
from tidemark.llm import queries, variants, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def fetched(spark, rows, folder, extra=lambda d: d, **more):
    made = warc.write(extra(pages(spark, rows)), f"{folder}/w", **more)
    return made, warc.read(spark, made)


def expected(rows, least=0):
    best = {}
    for pid, _, html in rows:
        if pid is not None and len((html or "").encode()) >= least:
            best[html or ""] = max(best.get(html or "", pid), pid)
    out = []
    for pid, _, html in rows:
        raw = (html or "").encode()
        top = best.get(html or "") if len(raw) >= least else None
        revisit = top is not None and (pid is None or pid < top)
        out.append((pid, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def awkward_pages():
    r = random.Random(1)
    rows = [(i, f"http://h{i % 5}.example/p?q={i}", f"<p>{words(r.randint(1, 60), i % 40)}</p>") for i in range(300)]
    rows += [(1000 + i, "http://hot.example/", "<p>always the same</p>") for i in range(150)]
    return rows + [(2000, None, None), (2001, "http://x/\r\nInjected: y", ""), (2002, "u", "ü" * 70_000), (2003, "http://a.b:80/#f", "WARC/1.1\r\n\r\n"), (None, None, "<p>always the same</p>"), (None, "z", "only here, without id"), (-5, "n", "PK\x05\x06"), (2004, "n", "\r\n\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 30])
def test_pages_come_back_from_archives(spark, tmp_path, least):
    rows = awkward_pages()
    made, back = fetched(spark, rows, tmp_path, clashing, least=least)
    assert sorted((tuple(r) for r in warc.pages_of(back).collect()), key=str) == expected(rows, least)
    assert made.agg(F.sum("n_records")).first()[0] == len(rows)
    got = {r.record_id: r for r in back.collect()}
    for pid, _, html in rows:
        if pid is not None:
            r = got[f"urn:page:{pid}"]
            assert bytes(r.payload).decode() == ((html or "") if r.record_type == "response" else "")
    assert got["urn:page:2001"].url == "http://x/%0D%0AInjected:%20y" and got["urn:page:2000"].url is None


def test_shared_digests_joined_by_shuffle_and_many_packages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 0)
    rows = awkward_pages()
    made, _ = fetched(spark, rows, tmp_path, package=2000)
    assert made.count() > 20
    assert sorted((tuple(r) for r in warc.pages_of(warc.read(spark, made, payload=False, block=500)).collect()), key=str) == expected(rows)


def test_no_pages(spark, tmp_path):
    made, back = fetched(spark, [], tmp_path)
    assert made.count() == 0 and back.count() == 0


def test_packages_are_plain_zip_and_warc(spark, tmp_path):
    made, _ = fetched(spark, awkward_pages()[:40], tmp_path)
    with zipfile.ZipFile(made.first().path.removeprefix("file:")) as z:
        assert z.testzip() is None
        assert {i.compress_type for i in z.infolist()} == {0}
        data = z.read("archive/data.warc.gz")
        index = [json.loads(x[x.index("{") :]) for x in z.read("indexes/index.cdxj").decode().splitlines()]
    for x in index:
        raw = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and x["digest"].encode() in raw


def foreign(at, rows, index=True, packed=False, before=b""):
    """A package by other hands: ZIP64 fields, comment, a gzipped index or none."""
    out, lines, where = io.BytesIO(), [], 0
    data = b""
    for rid, payload in rows:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        raw = gzip.compress(warc.record("response", rid, "2020-01-01T00:00:00Z", digest, len(payload), payload, "http://x/"))
        lines.append("x 2020 " + json.dumps({"offset": str(where), "length": str(len(raw)), "filename": "a.warc.gz"}))
        data, where = data + raw, where + len(raw)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a.warc.gz", data)
        if index:
            text = gzip.compress("\n".join(lines[:2]).encode()) + gzip.compress(("\n" + "\n".join(lines[2:])).encode())
            z.writestr("indexes/index.cdx.gz", text, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
        z.comment = b"with PK\x05\x06 inside"
    with open(at, "wb") as f:
        f.write(before + out.getvalue())


@pytest.mark.parametrize(("index", "packed", "before"), [(True, False, b""), (True, True, b"prefix"), (False, False, b"")])
@pytest.mark.parametrize("zip64", [False, True])
def test_packages_by_others(tmp_path, monkeypatch, index, packed, before, zip64):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    rows = [(f"urn:page:{i}", words(i, i).encode()) for i in range(30)]
    at = f"{tmp_path}/f.wacz"
    foreign(at, rows, index, packed, before)
    raw = open(at, "rb").read()
    assert (b"PK\x06\x07" in raw) == zip64
    got = [warc.parse(x) for r in warc.ranges(at, 300) for x in warc._fetched(*r)]
    assert [(x["record_id"], x["payload"]) for x in got] == rows


def test_broken_archives_are_told(tmp_path):
    at = f"{tmp_path}/f.wacz"
    foreign(at, [("urn:page:1", b"some text"), ("urn:page:2", b"more")])
    raw = open(at, "rb").read()
    for bad in (raw[:-30], b"", raw[:40]):
        open(at, "wb").write(bad)
        with pytest.raises(ValueError):
            list(warc.ranges(at))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record("response", "r", "d", "A" * 32, 3, b"abc"))
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(warc.record("response", "r", "d", "A" * 32, 3, b"abc")[:-6])


def test_base32(spark):
    got = spark.range(200).select(F.col("id").cast("string").alias("s")).select("s", warc.base32(F.sha1("s")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.s.encode()).digest()).decode() for r in got)


# --- collocations


def plain_collocations(rows, least, percent=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    by = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= percent * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in by.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))  # noqa: E741


def phrase_rows():
    r = random.Random(3)
    vocabulary = ["the", "of", "new", "york", "times", "É", "éa", "日本", "|", "a" * 300, "x", "X"]
    rows = []
    for i in range(250):
        text = "".join(r.choice(["the new york times of", "of the", "New York Times", "york times the of x"]) + r.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " | "]) if r.random() < 0.5 else r.choice(vocabulary) + " " for _ in range(r.randint(0, 60)))
        rows.append((r.choice(["en", "de", None, ""]), text))
    return rows + [("en", None), ("en", ""), ("en", " \t\n"), (None, "one"), ("fr", "x " * 5000), ("en", "no" * 200_000)]


@pytest.mark.parametrize(("least", "percent", "bits", "together"), [(20, 100, 28, 1 << 23), (3, 60, 16, 5000), (300, 100, 12, 5000), (1, 100, 13, 5000)])
def test_collocations(spark, monkeypatch, least, percent, bits, together):
    monkeypatch.setattr(L, "AT_ONCE", together)
    monkeypatch.setattr(L, "LEAST_BITS", min(bits, 16))
    rows = phrase_rows()
    d = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for extra in (lambda x: x, lambda x: clashing(x).withColumns({c: F.lit("y") for c in ("w1", "f", "size", "phrase", "rank", "a", "l", "r")})):
        got = L.collocations(extra(d), least, 50, percent, bits)
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, percent, 50)
        if least != 20:
            break
    assert L.collocations(d.limit(0)).count() == 0


def test_words_with_equal_hashes_stay_apart(spark, monkeypatch):
    import numpy as np

    low = np.frombuffer(b"ab cd ab ee ab", np.uint8)
    starts, ends, _ = L.words(low, np.array([0, len(low)]))
    for same in (np.zeros(5, np.uint64), np.array([1, 1, 1, 2, 2], np.uint64)):
        ids, first = L._dense(low, starts, ends, same)
        assert ids.tolist() == [0, 1, 0, 2, 0] and first.tolist() == [0, 1, 3]


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 4 * 10**15
    rows = [("en", 0, "", big * 3), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    monkeypatch.setattr(L, "phrase_counts", lambda *a: spark.createDataFrame(rows, "lang string, size int, phrase string, f long"))
    got = L.collocations(spark.range(1)).first()
    assert got.score == 1000 * (big - 1) * (big * 3) // (big * (big + 7))


# --- spelling variants


def plain_words(rows, one_in, least_length=6, least_count=5):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if v != w and differ_by_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_variants_of_random_words(spark, letters):
    r = random.Random(len(letters))
    seeds = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(40)]
    counts = {}
    for s in seeds:
        w = list(s)
        for _ in range(6):
            counts["".join(w)] = 5 ** r.randint(0, 6)
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
    counts.pop("", None)
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert sorted(tuple(x) for x in got.collect()) == plain_variants(counts)


def test_variants_of_long_words_ties_and_chains(spark):
    long = "ab" * 20_000
    counts = {long: 5, long[:777] + long[778:]: 25, long[:777] + "z" + long[778:]: 25, "aaaaaa": 1, "aaaaaaa": 5, "aaaaaaaa": 25, "baaaaaaa": 25, "aaaaaaaaa": 125, "alone": 9, "a": 1, "b": 5}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(tuple(x) for x in got.collect()) == plain_variants(counts)


@pytest.mark.parametrize("one_in", [None, 3, 199])
def test_words_of_texts_and_their_variants(spark, one_in):
    texts = AWKWARD + [f"{words(80, i % 7)} Straße×Élan naïveté Naïveté don't A1B2C3 абвгдеж {'Q' * 50}" for i in range(40)]
    rows = list(enumerate(texts)) + [(None, "without identifier " * 6), (3, "repeated identifier " * 6)]
    found = variants.corpus_words(clashing(docs(spark, rows)), one_in=one_in)
    assert {r.word: r.n for r in found.collect()} == plain_words(rows, one_in)
    assert sorted(tuple(x) for x in variants.variants(found).collect()) == plain_variants(plain_words(rows, one_in))
    assert variants.variants(variants.corpus_words(docs(spark, [None, "few"]))).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op12_warc", "op13_collocations"])
def test_queries_equal_their_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small)
    at = [want.columns.index(k) for k in got.columns]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert want.shape[0] or name == "op13_collocations"
