"""The M-tree, the classifier and string tiling against brute force."""

import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priorframe.llm import decontaminate, mtree, quality

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    ok = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("page_rows", [4096, 100])
def test_top_k(spark, monkeypatch, page_rows):
    monkeypatch.setattr(mtree, "PAGE_ROWS", page_rows)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert {tuple(r) for r in mtree.top_k(spark, vectors).collect()} == brute(rows, 10, 100)


def test_top_k_odd(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 40)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 3)
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for i in range(150)] + [(1000 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(160)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {tuple(r) for r in mtree.top_k(spark, df, 10, 10).collect()} == brute(exact, 10, 10)
    assert mtree.top_k(spark, df.filter("vec_id is null")).count() == 0
    few = df.filter("vec_id in (0, 1, 1000)")
    assert {tuple(r) for r in mtree.top_k(spark, few, 10, 10).collect()} == brute([(r.vec_id, r.embedding) for r in few.collect()], 10, 10)


@pytest.mark.parametrize("size", [1e6, 1e9])
def test_top_k_of_large_components(spark, monkeypatch, size):
    """Beyond 32 bits, and products beyond 64 bits: ranks are exact, scores are held at the ends of the range."""
    monkeypatch.setattr(mtree, "PAGE_ROWS", 40)
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(6)]) for i in range(200)] + [(900, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0])] * (size > 1e8)
    got = {tuple(r) for r in mtree.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, 10).collect()}
    held = [(i, [max(-(2**55), min(2**55, math.floor(c * 1024))) for c in v]) for i, v in rows]
    want = set()
    for q, v in held:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)[:10]
            want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
    assert got == want


def test_shards_that_cannot_help_are_not_visited(spark, monkeypatch):
    """Clustered vectors: a query is sent to a small part of the shards."""
    monkeypatch.setattr(mtree, "PAGE_ROWS", 50)
    share = []
    for n in (20, 60):
        rng = np.random.default_rng(n)
        centres = rng.normal(0, 1, (n, 8))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        v = (centres[:, None] + rng.normal(0, 0.002, (n, 60, 8))).reshape(-1, 8)
        order = rng.permutation(len(v))
        df = spark.createDataFrame([(i, v[j].tolist()) for i, j in enumerate(order.tolist())], "vec_id long, embedding array<double>")
        kept = {}
        keep = mtree.Workspace.keep
        monkeypatch.setattr(mtree.Workspace, "keep", lambda self, d, step, kept=kept: kept.setdefault(step, keep(self, d, step)) if step != "met" else keep(self, d, step))
        got = {tuple(r) for r in mtree.top_k(spark, df, 10, 50).collect()}
        monkeypatch.setattr(mtree.Workspace, "keep", keep)
        assert got == brute([(i, v[j].tolist()) for i, j in enumerate(order.tolist())], 10, 50)
        shards = kept["pages"].filter("page = 0").count()
        share.append(kept["sent"].count() / kept["asked"].count() / shards)
    assert max(share) < 0.15


def test_top_k_repeated_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    got = sorted(tuple(r) for r in mtree.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, 100).collect())
    assert [r[:2] for r in got] == [(0, 1), (0, 2), (0, 3)] and [r[2] for r in got][:2] == [1, 1]


def test_tree_skips_products():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c, 5, (500, 8)) for c in rng.normal(0, 900, (8, 8))]).astype(np.int64)
    m = float((v**2).sum(1).max())
    tree = mtree.Tree(np.arange(len(v)), v, np.sqrt(m - (v**2).sum(1)))
    pages = {x["page"]: x | {"ids": np.array(x["ids"], np.int64), "to_centre": np.array(x["to_centre"]), "centre": np.array(x["centre"]), "vectors": np.frombuffer(x["vectors"], np.int64).reshape(-1, 8)} for x in tree.pages()}
    top, computed = mtree.best_first(pages, v[0], 0.0, 0, 10, m)
    want = sorted((-int(v[0] @ w), i) for i, w in enumerate(v) if i)[:10]
    assert sorted((-s, -i) for s, i in top) == want and computed < len(v) / 2


def test_queries_go_down_together(monkeypatch):
    """As one by one, with few, repeated and equally good vectors, and in seconds where one by one takes a minute."""
    rng = np.random.default_rng(7)
    for n, width, values in ((0, 3, 9), (5, 3, 9), (700, 3, 4), (3000, 8, 200)):
        v = rng.integers(-values, values, (max(n, 1), width))
        m = float((v**2).sum(1).max()) + 1
        ids = rng.permutation(n) if n != 700 else rng.integers(0, 500, n)
        tree = mtree.Tree(ids, v[:n], mtree.lifted(v[:n], m))
        if not n:
            assert not list(tree.pages())
            continue
        pages = {x["page"]: x | {c: np.array(x[c]) for c in ("centre", "ids", "to_centre")} | {"vectors": np.frombuffer(x["vectors"], np.int64).reshape(-1, width)} for x in tree.pages()}
        own = np.arange(n)[:60]
        alone = [mtree.best_first(pages, v[i], 0.0, i, 10, m)[0] for i in own]
        known = np.array([t[0][0] if i % 2 and len(t := sorted(alone[i])) == 10 else -np.inf for i in own])
        row, found, score = mtree.best_together(pages, v[own], own, 10, m, known)
        got = [sorted(zip(score[row == i].tolist(), (-found[row == i]).tolist())) for i in own]
        assert got == [sorted(t) for t in alone]
    v = rng.integers(-1000, 1000, (4096, 64))
    m = float((v**2).sum(1).max()) + 1
    pages = {x["page"]: x | {c: np.array(x[c]) for c in ("centre", "ids", "to_centre")} | {"vectors": np.frombuffer(x["vectors"], np.int64).reshape(-1, 64)} for x in mtree.Tree(np.arange(4096), v, mtree.lifted(v, m)).pages()}
    began = time.process_time()
    row, found, score = mtree.best_together(pages, v, np.arange(4096), 10, m, np.full(4096, -np.inf))
    assert time.process_time() - began < 30 and len(row) == 40960
    best = v[:20] @ v.T
    best[np.arange(20), np.arange(20)] = -(2**62)
    assert score.reshape(-1, 10)[:20].tolist() == (-np.sort(-best, axis=1)[:, :10]).tolist()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(spark, docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert sum(a > b for a in ones for b in zeros) / len(ones) / len(zeros) > 0.97
    assert sum(x >= 0.7 for x in ones) / len(ones) > 0.97 and sum(x < 0.7 for x in zeros) / len(zeros) > 0.8


def test_votes_against_brute_force(spark):
    """Scores of the query's own model against cosines and votes one by one, in double precision."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(spark, docs, labels)
    rows = docs.limit(150).collect()
    got = {r.doc_id: r.score for r in quality.scored(spark, docs.select("doc_id", "text"), model).filter(F.col("doc_id").isin([r.doc_id for r in rows])).collect()}
    labelled, project, off = model.vectors.astype(float), model.project.astype(float), 0
    for r in rows:
        (_, table), = quality.counts(pa.array([r.text or ""]))
        x = np.log1p(table[0].astype(float)) * model.weights
        parts = [x[a:b] for a, b in ((0, quality.TERMS), (quality.TERMS, quality.TERMS + quality.SHAPES), (quality.TERMS + quality.SHAPES, quality.WIDTH))]
        v = np.concatenate([p / (np.sqrt((p * p).sum()) or 1) for p in parts]) @ project
        cosines = [float(v @ w) / (float(np.sqrt(v @ v)) or 1) for w in labelled]
        best = sorted(range(len(cosines)), key=lambda n: (-cosines[n], n))[: quality.NEIGHBOURS]
        like = [max(0.0, cosines[n]) ** quality.POWER * float(model.votes[n]) for n in best]
        want = sum(w for w, n in zip(like, best) if model.labels[n]) / sum(like) if table.any() and sum(like) else model.prior
        off += abs(got[r.doc_id] - want) > 1e-3
    assert off <= 1  # a tie for the last place may fall otherwise in single precision


def test_quality_sample(spark):
    """Labels without a document don't use up the sample; of an id's texts one is learnt; equal texts score alike wherever they stand; a column score is replaced."""
    good, bad = [f"fine words number {i} of a calm text" for i in range(40)], [f"$$$ {i} !!! buy @@@" for i in range(40)]
    rows = [(i, t, 0.5) for i, t in enumerate(good + bad)] + [(0, "another text of the same id", 0.5)] * 50 + [(1000 + i, good[7], 0.1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(5000 + i, 0) for i in range(5000)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels)
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80))
    assert len(model.labels) == 80 - held and 0.3 < model.prior < 0.7
    got = quality.scored(spark, docs, model)
    assert got.columns == ["doc_id", "text", "score"] and len({r.score for r in got.filter(F.col("text") == good[7]).collect()}) == 1


def test_quality_odd(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, " ", 0.2), (None, "fine words", 0.3), (4, "x" * 300000, 0.1), (4, "x" * 300000, 0.1)], "doc_id long, text string, score double").drop("score")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (4, 1)], "doc_id long, quality int")
    rows = quality.classify(spark, docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert all(r.score == 1.0 for r in quality.classify(spark, docs, labels.filter("false")).collect())
    assert quality.classify(spark, docs.filter("false"), labels).count() == 0


def plain_tiles(p, t, least):
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best = 0
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and fp[i + k] and ft[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if best < least:
            return out
        i, j = at
        for k in range(best):
            fp[i + k] = ft[j + k] = False
        out.append((i, j, best))


def test_tiles_are_greedy():
    rng = random.Random(5)
    for _ in range(60):
        p, t = [rng.randrange(3) for _ in range(rng.randrange(1, 30))], [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        got = decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 3)
        want = plain_tiles(p, t, 3)
        assert [x[2] for x in got] == [x[2] for x in want] or sum(x[2] for x in got) == sum(x[2] for x in want)


def test_leaks(spark):
    item = "One, two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
    w = item.split()
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "Short item"), (11, " ".join(f"u{i}" for i in range(40)))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "x " + item.upper() + " y"), (2, " ".join(w[8:] + ["gap"] + w[:8])), (3, " ".join(w[:6])), (4, None), (5, ""), (6, "a short, ITEM!"), (7, "short of item"),
        (8, " ".join(w[:5] + ["z"] + w[10:15])), (8, " ".join(w[:5] + ["z"] + w[10:15])), (None, item), (12, "word " * 50000 + item),
    ], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.coverage, 3), r.n_tiles) for r in decontaminate.find_leaks(spark, docs, items).collect()), key=str)
    want = sorted([(1, 7, 1.0, 1), (2, 7, 1.0, 2), (6, 10, 1.0, 1), (8, 7, 0.625, 2), (8, 7, 0.625, 2), (None, 7, 1.0, 1), (12, 7, 1.0, 1)], key=str)
    assert got == want
    assert sorted(r.doc_id for r in decontaminate.clean(spark, docs, items).collect()) == [3, 4, 5, 7]
    assert decontaminate.find_leaks(spark, docs, items.filter("false")).count() == 0 and decontaminate.find_leaks(spark, docs.filter("false"), items).count() == 0


def folded(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split()


def greedy(p, t, least):
    """Lengths of the longest unmarked common runs, marked one after another."""
    fp, ft, out = [True] * len(p), [True] * len(t), []
    for k in range(min(len(p), len(t)), least - 1, -1):
        at = {}
        for j in range(len(t) - k + 1):
            at.setdefault(tuple(t[j : j + k]), []).append(j)
        for i in range(len(p) - k + 1):
            for j in at.get(tuple(p[i : i + k]), ()):
                if all(fp[i : i + k]) and all(ft[j : j + k]):
                    fp[i : i + k], ft[j : j + k] = [False] * k, [False] * k
                    out.append(k)
    return out


def brute_leaks(docs, items, cover=0.5):
    """(doc_id, item_id, coverage, tiles) of all pairs of rows, those without a common run of five words (or of the whole item) left out at once."""
    out = []
    texts = [(i, folded(x)) for i, x in items if x is not None]
    sets = [(i, p, min(5, len(p)), {tuple(p[a : a + min(5, len(p))]) for a in range(len(p) - min(5, len(p)) + 1)}) for i, p in texts if p]
    for d, x in docs:
        t = folded(x)
        grams = {k: {tuple(t[a : a + k]) for a in range(len(t) - k + 1)} for k in {s[2] for s in sets}}
        for i, p, least, seeds in sets:
            if seeds & grams[least]:
                got = greedy(p, t, least)
                if sum(got) >= cover * len(p):
                    out.append((d, i, round(sum(got) / len(p), 9), len(got)))
    return sorted(out, key=str)


def told_leaks(spark, docs, items):
    return sorted(((r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles) for r in decontaminate.find_leaks(spark, docs, items).collect()), key=str)


def test_leaks_against_all_pairs(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and told_leaks(spark, docs, items) == want


@pytest.mark.parametrize("bits", [27, 16])
def test_leaks_of_mixed_up_items(spark, monkeypatch, bits):
    """Cut, moved and changed items of a small vocabulary, so runs repeat; string and int ids; with a table so full that most runs may be seeds."""
    if bits == 16:
        monkeypatch.setattr(decontaminate, "BITS_LEAST", 6)
        monkeypatch.setattr(decontaminate, "BITS_MOST", 10)
    rng = random.Random(bits)
    items = [(f"i{n}", " ".join(f"v{rng.randrange(12)}" for _ in range(rng.randrange(1, 40)))) for n in range(25)] + [("i0", "again the same")] * 2 + [(None, "v1 v2 v3"), ("x", "word " * 30)]
    docs = []
    for n in range(120):
        w = [f"v{rng.randrange(12)}" for _ in range(rng.randrange(60))]
        p = items[rng.randrange(25)][1].split()
        cut = rng.randrange(len(p) + 1)
        docs.append((n % 100 if n % 7 else None, " ".join(w + p[cut:] + (["zz"] if n % 3 else []) + p[:cut] + w[: n % 11])))
    docs += [(500, "word " * 200), (501, "again, THE same"), (502, None), (503, "")]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = brute_leaks(docs, items)
    assert told_leaks(spark, d, i) == want and len(want) > 40
    bad = {x for x, _, _, _ in want}
    texts = {t for (n, t) in docs if (n in bad and any(t == u and n == m for m, u in docs))}
    kept = decontaminate.clean(spark, d.withColumn("item", F.lit(1)).withColumn("doc", F.lit("x")), i).collect()
    whole = {t for t, in {(t,) for n, t in docs if brute_leaks([(n, t)], items)}}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(n), str(t)) for n, t in docs if t not in whole) and texts >= whole


def test_leaks_of_int_items(spark):
    docs = spark.createDataFrame([("a", "one two three four five six")], "doc_id string, text string")
    items = spark.createDataFrame([(3, "one two three four five six")], "item_id int, text string")
    assert [tuple(r) for r in decontaminate.find_leaks(spark, docs, items).collect()] == [("a", 3, 1.0, 1)]
