"""Operators over the whole corpus against brute force."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, SCHEMA, clashing, docs, words
from tidemark.llm import ann, decontaminate, lm, near_dup, repeats, toxicity
from tidemark.llm.components import components


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def tokens(x):
    return [w for w in re.split("[\x20\x09-\x0d]+", low(x)) if w]


def shingles(x, k):
    w = tokens(x)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(rows, k, percent):
    """Smallest id reachable over links, all pairs compared."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, k))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for a, (i, s) in enumerate(flat):
        for j, z in flat[:a]:
            both = len(s & z)
            if 100 * both >= percent * (len(s) + len(z) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (8, 7), (5, 5), (3, 1), (20, 7), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def edited(text, n, seed):
    w = text.split()
    r = np.random.default_rng(seed)
    for i in r.choice(len(w), n, replace=False):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(near_dup, "BLOCK_DOCS", 6)
        monkeypatch.setattr(near_dup, "BUCKET", 4)
    base = [words(150, s) for s in range(6)]
    texts = [*AWKWARD, *base, *[base[0]] * 5, *[edited(base[1], n, 10 + n) for n in range(1, 12)], *[edited(base[2], n % 7, 40 + n) for n in range(14)], base[3].upper(), "one two three", "ONE two\nthree"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, base[0]), (None, base[4]), (None, None)]
    d = docs(spark, rows)
    got = near_dup.near_duplicates(clashing(d), k=3, percent=85).collect()
    want = plain_components(rows, 3, 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert {r.doc_id: r.n_shingles for r in got}[8] == len(shingles(texts[8], 3))


def test_near_duplicates_of_a_template(spark):
    """Thousands of texts that share three quarters of their words, and a few links among them: none is lost, and texts part company."""
    r = np.random.default_rng(9)
    same = [f"t{i}" for i in range(150)]
    own = lambda i: [f"o{i}x{j}" for j in range(50)]
    texts = [" ".join(same + own(i)) for i in range(4000)]
    texts += [" ".join([*texts[i].split()[:-6], *[f"z{i}y{j}" for j in range(6)]]) for i in range(0, 4000, 40)]
    order = r.permutation(len(texts))
    d = docs(spark, [(int(i), texts[j]) for i, j in enumerate(order)])
    signed = near_dup.signatures(d.select("doc_id", "text"), 3)
    found = near_dup.candidate_links(signed.select("doc_id", "n", "regs"), 0.85 - near_dup.MARGIN).count()
    assert found < 2 * len(texts)
    place = np.argsort(order)
    want = {(min(a, b), max(a, b)) for i in range(100) for a, b in [(int(place[40 * i]), int(place[4000 + i]))]}
    got = {(r.component_id, r.doc_id) for r in near_dup.near_duplicates(d, k=3, percent=85).where("not kept").collect()}
    assert got == want


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.component_id for r in near_dup.near_duplicates(docs(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_sketches_estimate():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:1600], a[:400] + np.uint64(12345)])
    sa, sb = near_dup.sketch(a), near_dup.sketch(b)
    assert (np.maximum(sa, sb) == near_dup.sketch(np.union1d(a, b))).all()
    assert abs(near_dup.similarity(sa[None], np.array([2000]), sb[None], np.array([2000]))[0] - 1600 / 2400) < 0.2


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    p = words(60, 1)
    texts = [*AWKWARD, p, words(30, 2) + p + words(30, 3), p[:200] + "é" + p[100:], p[50:] + p[:150], "ab" * 400, words(300, 9), words(300, 9)[7:], "z" * 99, "z" * 99, "z" * 100, p[:99], p[1:100]]
    rows = list(enumerate(texts))
    got = repeats.repeats(clashing(docs(spark, rows))).collect()
    want = plain_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeats_in_blocks(spark, monkeypatch):
    """Seeds of a text don't depend on where its blocks are cut."""
    p = words(60, 1)
    text = words(400, 1) + "ab" * 700 + p + "z" * 900 + words(300, 2) + p + "é" * 300 + words(200, 3)[50:]
    for block in (211, 500):
        monkeypatch.setattr(repeats, "BLOCK", block)
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
        whole = pieces = None
        for part, buf, off in repeats.chunks(batch):
            whole = sorted(repeats.seeds(buf, off)[0].tolist())
            pieces = sorted(x + shift for _, b, o, shift, own, end in repeats.blocks(part, buf, off) for x in repeats.seeds(b, o)[0].tolist() if own <= x < end)
        assert pieces == whole


def test_repeats_of_long_and_monotone_texts(spark):
    r = np.random.default_rng(2)
    long = bytes(r.integers(97, 123, 5_000_000, dtype=np.uint8)).decode()
    texts = [long[:2_500_000] + long[1_000_000:1_000_400] + long[2_500_000:], "q" * 2_000_000, "xyz" * 400_000, long[3_000_000:3_000_150] + "!", "q" * 120]
    got = {r.doc_id: r for r in repeats.repeats(docs(spark, list(enumerate(texts)))).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(5)] == [(400, 1), (2_000_000 - 1, 1), (1_200_000 - 3, 1), (150, 1), (120, 1)]
    assert got[1].kept_sha256 == hashlib.sha256(b"q").hexdigest() and got[2].kept_sha256 == hashlib.sha256(b"xyz").hexdigest()


def test_repeats_of_repeated_and_missing_ids(spark):
    p = words(60, 1)
    got = repeats.repeats(docs(spark, [(1, p), (1, p), (None, p), (2, p)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(p))]
    assert repeats.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_of_columns():
    r = np.random.default_rng(3)
    m = r.integers(0, 2, (40, repeats.REACH + repeats.WINDOW)).astype(np.int16)
    m[20:] = m[:20]
    m[25, 90] += 1
    group = np.repeat([1, 2], 20)
    group[:] = np.sort(np.tile([1, 2], 20))
    got = repeats.order_columns(group, m)
    for i in range(40):
        for c in range(got.shape[1]):
            assert got[i, c] == any(group[j] == group[i] and (m[j, c : c + 100] == m[i, c : c + 100]).all() for j in range(i))


def test_contamination(spark, small):
    q = "If Anna has 12 apples and gives Bob 5 km of them, how many apples does Anna keep now?"
    asked = ["So if Carl has 77 apples and gives Dora 9 km of them, how many apples does Carl keep now?", "if Carl has 77 apples and gives Dora 9 km of them, how many apples does Eve keep now?", "apples and gives", *AWKWARD, q, q]
    d = docs(spark, asked)
    items = spark.createDataFrame([(1, q), (1, q), (2, None), (3, ""), (4, "tiny one")], "item_id long, text string")
    got = decontaminate.contaminated(clashing(d), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (len(asked) - 2, 1), (len(asked) - 1, 1)]
    assert decontaminate.remove(d, items).count() == len(asked) - 3
    assert decontaminate.contaminated(d.limit(0), items).count() == 0 and decontaminate.contaminated(d, items.limit(0)).count() == 0
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{small}/{n}.parquet'")
    rows = decontaminate.contaminated(*(spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in c.sql(decontaminate.ORACLE_SQL).fetchall()}


def test_contamination_by_other_names_and_numbers(spark):
    """Items asked again with other names, numbers and units, inside other text: nearly all are found, other questions aren't."""
    names = ["Anna", "Émile", "Ben", "Carla", "Zoë", "Tom", "Maria", "Ольга", "Jürgen", "Peter", "Lena", "Omar"]
    forms = [
        "{a} has {x} apples and gives {b} {y} of them at noon. How many apples does {a} keep at the end of the day?",
        "\"{a}\" drives {x} km to the lake while {b} ({c}'s friend) walks {y} km. Who goes farther, and by how much?",
        "{a} {c} buys {z} pencils for {x} euros each. {b} pays half of the price. What does {a} {c} pay in total?",
        "In a class of {x} pupils, {y} play chess and {z} sing. How many pupils do neither if nobody does both?",
        "{a} reads {x} pages on Monday, {y} pages later, and {z} books a year. {b} reads twice as much. How many pages is that?",
        "What is {x} + {y} - {x}, and is it more than {y}?",
    ]
    low = ["two", "three", "seven", "eleven"]

    def asked(form, seed):
        g = np.random.default_rng(seed)
        a, b, c = g.choice(names, 3, replace=False)
        x, y = g.choice(np.arange(11, 900), 2, replace=False)
        return form.format(a=a, b=b, c=c, x=x, y=y, z=low[seed % 4])

    items = spark.createDataFrame([(i, asked(f, i)) for i, f in enumerate(forms)] + [(90, "Name all big rivers of Asia"), (91, "1 2 3")], "item_id long, text string")
    texts = [f"{words(20, 500 + i)} {asked(forms[i % 6], 100 + i)} {words(20, 900 + i)}" for i in range(120)]
    texts += [asked(forms[i % 6], 300 + i).lower() for i in range(6)] + [f"{words(9, 1)} name all big rivers of asia {words(9, 2)}", "1 2 3", f"{words(30, 3)} has 12 apples and gives"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    want = {(i, i % 6) for i in range(120)}
    assert len(got & want) >= 0.95 * len(want)
    assert not {(d, i) for d, i in got if d < 120} - want
    assert (126, 90) in got, got - want
    assert {d for d, _ in got} <= set(range(127))
    print("found", len(got & want) / len(want), [i for i in range(120, 126) if any(d == i for d, _ in got)])


def test_nearest(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    p = v.toPandas()
    x = np.array(p.embedding.tolist(), np.float64)
    rows = ann.search(v, v.where("vec_id % 20 = 0")).collect()
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    ids, hits, total = p.vec_id.to_numpy(), 0, 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        got = found[ids[q]]
        assert [y for _, y in got] == sorted((y for _, y in got), reverse=True) and len(got) == 20
        assert all(abs(y - x[np.flatnonzero(ids == i)[0]] @ x[q]) < 1e-9 for i, y in got)
        hits, total = hits + len({i for i, _ in got} & set(best)), total + 20
    assert hits / total >= 0.9


def test_nearest_of_few_and_awkward(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 0.0]), (40, None), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 2), (20, 2, 0), (20, 3, 1)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
    one = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ann.search(one, one.where("vec_id = 20")).orderBy("rank").collect()] == list(range(20))


def plain_nearest(x, ids, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return list(ids[np.lexsort((ids, -s))[:k]])


def test_nearest_beyond_the_probes(spark, small, monkeypatch):
    """Queries that would need more buckets than may be probed are compared with all vectors; extra columns don't clash."""
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    v = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(300)
    p = v.toPandas()
    x, ids = np.array(p.embedding.tolist(), np.float64), p.vec_id.to_numpy()
    rows = ann.search(clashing(v), clashing(v).where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {ids[q]: plain_nearest(x, ids, q, 20) for q in np.flatnonzero(ids % 20 == 0)}


def test_probes_of_many_vectors_stay_small(spark, monkeypatch):
    """Three functions a table, as over a million vectors have: the driver's sample takes bounded memory."""
    monkeypatch.setattr(ann, "SAMPLE", 6)
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:6] + 0.02 * r.normal(size=(6, 64))
    classes = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "rep long, v array<double>")
    shape = ann.Shape(1 << 21, 64, 2.0, False)
    assert shape.functions == 3
    ask = lambda y: spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(y)], "query_id long, v array<double>")
    tracemalloc.start()
    assert ann._probes(classes, ask(x[:6]), shape, 20) is None  # nothing is near: no number of probes helps
    assert 1 <= ann._probes(classes, ask(near), shape, 0) <= 64  # each has one that is
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_toxicity(spark):
    """Held-out texts: most toxic ones found, hardly a false one."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in toxicity.classify(clashing(d), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    found = [i for i in held if got[i].predicted]
    right = sum(truth[i] for i in found)
    assert right >= 0.85 * sum(truth[i] for i in held) and right >= 0.95 * len(found)


@pytest.mark.parametrize("rank", [0, 8])
def test_toxicity_of_neutral_parts(spark, rank):
    """Two words that are as common in clean texts make toxic ones together (or when both lack): a machine without factors can't tell."""
    texts = [" ".join(np.random.default_rng(i).permutation([*words(8, i).split(), *["blarg"] * (i & 1), *["quimly"] * (i >> 1 & 1)])) for i in range(3000)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int((i & 1) == (i >> 1 & 1))) for i in range(3000)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.classify(d, labels, rank=rank).collect() if r.held_out]
    right = sum(r.predicted == ((r.doc_id & 1) == (r.doc_id >> 1 & 1)) for r in held) / len(held)
    assert right > 0.95 if rank else right < 0.8


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(spark, AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs(spark, AWKWARD), some).count() == len(AWKWARD)
    assert toxicity.reject(docs(spark, AWKWARD).limit(0), some).count() == 0


def test_pairs_count():
    """A pair of terms is toxic that neither term is alone: the machine's factors must tell."""
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (4000, 6)).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]).astype(float)
    m = toxicity.train_machine(x, y, np.ones(len(y)), np.zeros(1, np.int32), 0.0, steps=500)
    row, feature = np.nonzero(x)
    assert ((m.score(row, feature, len(x)) >= 0.5) == (y == 1)).mean() > 0.98


def test_language_model(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, AWKWARD, 10**6).select("doc_id", "text"))
    texts = {r.doc_id: tokens(r.text) for r in d.collect()}
    train = {i: w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 10}
    c = collections.Counter(x for w in train.values() for x in [*w, None])
    n, v = sum(c.values()), len(c)
    got = lm.score(clashing(d)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [*texts[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_little(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(docs(spark, [(held, "a b"), (held, "a b")])).collect()
    assert len(r) == 2 and r[0].train_tokens == 0 and r[0].n_known == 0 and r[0].base_score == 0.0


def test_language_model_counts_rare_bigrams(spark):
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    names = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(names[j % 3000] for j in range(n, n + 40))) for n, i in zip(range(0, 12_000, 20), ids, strict=False)] + [(ids[-1], "zebra quokka"), (ids[-2], "zebra quokka")]
    rows += [(held[0], "zebra quokka"), (held[1], "quokka zebra"), (held[2], "zebra new w1 w2 w2")]
    train = [(i, [*t.split(), None]) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    main, every, out = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in train:
        for pair in zip([None, *w], w, strict=False):
            every[pair] += 1
            (out if zlib.crc32(str(i).encode()) % 10 == 1 else main)[pair] += 1

    def word(c, side):
        got = collections.Counter()
        for pair, n in c.items():
            got[pair[side]] += n
        return got

    v = len(word(every, 1)) + 1

    def estimates(c, a, b):
        return np.array([c[0][a, b] / max(1, c[1][a]), c[2][b] / sum(c[2].values()), 1 / v])

    of = lambda c: (c, word(c, 0), word(c, 1))
    m, e = of(main), of(every)
    pairs = list(out)
    weights = lm._weights(lm.buckets(np.array([m[1][a] for a, _ in pairs])), np.array([out[p] for p in pairs], float), np.array([estimates(m, *p) for p in pairs]))
    for parts in (0, 1):
        got = {r.doc_id: r.score for r in lm.score(docs(spark, rows), parts).collect()}
        for i, t in rows[:50] + rows[-5:]:
            w = [*t.split(), None]
            want = sum(math.log10(weights[lm.buckets(np.array([e[1][a]]))[0]] @ estimates(e, a, b)) for a, b in zip([None, *w], w, strict=False))
            assert math.isclose(got[i], want, rel_tol=2e-3), (i, t)
        assert got[held[0]] > got[held[1]]


def test_interpolation_is_a_distribution():
    r = np.random.default_rng(0)
    main, held = r.poisson(0.3, (50, 50)), r.poisson(0.1, (50, 50))
    w = lm.interpolation_weights(main, held)
    assert np.allclose(w.sum(axis=1), 1)
    assert np.allclose((10.0 ** lm.log_table(main + held, w).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_pipeline_stages_bear_awkward_rows(spark, small):
    """Null, empty, repeated and long texts, further columns, empty tables: each stage keeps what it has no reason to drop."""
    import corpus_pipeline as cp

    p = words(60, 77)
    long = words(40_000, 78)
    rows = [*enumerate(AWKWARD), (50, p), (51, p), (52, p + " token = \"k3yVal88xZq7\""), (53, long), (54, long), (55, long[:-20]), (None, p), (56, "plain"), (56, "plain")]
    d = docs(spark, rows).withColumns({c: F.lit("x") for c in ("n", "key", "cluster", "_gone", "_held", "host", "kept", "score", "toxic", "u", "v")})
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    at = d
    for name, stage in cp.STAGES:
        assert stage(spark, d.limit(0), small).count() == 0, name
        at = stage(spark, at, small).persist()
        if name != "pieces":
            assert at.columns == d.columns
        if name == "toxicity":
            assert ids(at) == sorted(-1 if i is None else i for i, _ in rows)
        if name == "near_duplicates":
            assert ids(at) == sorted([-1, 0, 1, 2, 3, 4, 6, 7, 8, 50, 53, 56, 56])  # "one" again, and a copy of the long line, go
    assert all(r.exact for r in at.collect())


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    start = spark.read.parquet(f"{small}/documents.parquet")
    rows = start.count()
    at = start
    for name, stage in cp.STAGES:
        before = at
        at = stage(spark, before, small).persist()
        if name == "near_duplicates":
            kept = before.toPandas()
            want = plain_components(list(zip(kept.doc_id, kept.text, strict=True)), 5, 80)
            assert sorted(r.doc_id for r in at.collect()) == sorted(i for i, c in want.items() if i == c)
        if name == "secrets":
            assert at.count() == before.count() and at.where(F.length("text") != F.col("n_chars")).count() == 0
        if name != "pieces":
            assert at.columns == start.columns
        assert 0.5 * rows < at.count() <= before.count()
    assert cp.run(spark, small).count() == at.count()


def test_places_and_packed_pairs_hold_every_value():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 3000):
        values = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        asked = np.concatenate([values, rng.integers(-(2**63), 2**63 - 1, 500), np.arange(-3, 4)])
        where = {v: i for i, v in enumerate(values.tolist())}
        assert lm.Places(values).of(asked).tolist() == [where.get(v, -1) for v in asked.tolist()]
    codes = np.concatenate([np.arange(40), rng.integers(0, 2**62, 40) | lm.RARE])
    p = np.stack([*rng.choice(codes, (2, 20_000)), *rng.integers(0, 2, (2, 20_000))])
    for parts in (1, 7, 2**30):
        rows = [r for b in lm._rows(lm.PAIRS, lm._home(p[0], p[1]), p, parts, True) for r in b.to_pylist()]
        assert len({r["bucket"] for r in rows}) == len(rows)
        q, at = lm._distinct(np.concatenate([lm._unpack(r["data"]) for r in rows], axis=1))
        sums = np.add.reduceat(q[2:], at, axis=1)
        want: dict = {}
        for a, b, x, y in p.T.tolist():
            u, v = want.get((a, b), (0, 0))
            want[a, b] = (u + x, v + y)
        assert {(a, b): (x, y) for a, b, x, y in np.concatenate([q[:2, at], sums]).T.tolist()} == want
