"""Order MinHash classes against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priorframe.llm import neardup

SF = "/root/testdata/sf0.01"


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def partition(labels):
    by = defaultdict(set)
    for i, c in labels:
        by[c].add(i)
    return sorted(map(sorted, by.values()))


def edit_distance(a, b):
    """Of two lists of words, by the whole table."""
    code = {w: n for n, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = [code[w] for w in a], np.array([code[w] for w in b])
    step, row = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(best - step) + step
    return int(row[-1])


def similar(a, b, shared, sa, sb):
    """Jaccard of five-word shingles, or edit similarity, of at least 0.8."""
    if shared >= 0.8 * (len(sa) + len(sb) - shared):
        return True
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9


def brute(rows, known=None):
    """Classes of (id, text): equal word sequences and similar ones; all pairs that share a shingle, whose links go to `known`."""
    seqs = [tuple((t or "").encode().split()) for _, t in rows]
    sets = [{s[a : a + 5] for a in range(len(s) - 4)} for s in seqs]
    links, first, at = [], {}, defaultdict(list)
    for i, s in enumerate(seqs):
        if s in first:
            links.append((first[s], i))
            continue
        first[s] = i
        near = defaultdict(int)
        for g in sets[i]:
            for j in at[g]:
                near[j] += 1
            at[g].append(i)
        found = [(j, i) for j, n in near.items() if similar(seqs[j], s, n, sets[j], sets[i])]
        links += found
        if known is not None:
            known += found
    return union(len(rows), links)


def refines(fine, coarse):
    """Whether each class of the first lies in one of the second."""
    where = {i: n for n, c in enumerate(coarse) for i in c}
    return all(len({where[i] for i in c}) == 1 for c in fine)


def test_all_pairs(spark):
    """No two texts in a class that brute force doesn't put into one, and at least 0.9 of the links between different texts found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = neardup.classes(spark, docs).collect()
    links = []
    want = partition(zip((i for i, _ in rows), brute(rows, links)))
    assert refines(partition((r.doc_id, r.class_id) for r in got), want)
    by = {r.doc_id: r.class_id for r in got}
    found = sum(by[rows[i][0]] == by[rows[j][0]] for i, j in links)
    assert len(links) > 50 and found >= 0.9 * len(links), (found, len(links))
    sizes = {r.class_id: r.class_size for r in got}
    assert sum(sizes.values()) == len(rows) and all(r.class_id <= r.doc_id for r in got)
    kept = neardup.keep_one(spark, docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got}) and kept.columns == docs.columns


def test_recall_by_edits(spark):
    """Pairs of texts of 100 words, so many of them changed, dropped or added, and the part of such pairs that must be found."""
    rng, rows, least = random.Random(3), [], {3: 1.0, 6: 0.99, 10: 0.8, 15: 0.4}
    for pair in range(800):
        text = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        other = list(text)
        for n in range(list(least)[pair % 4]):
            at = rng.randrange(len(other))
            other[at : at + 1] = [[f"x{rng.randrange(10**9)}"], [], [other[at], f"x{n}"]][rng.randrange(3)]
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for n, (edits, part) in enumerate(least.items()):
        assert sum(got[2 * p] == got[2 * p + 1] for p in range(n, 800, 4)) >= part * 200, edits
    assert len(set(got.values())) >= 800


def test_links_of_many_edits(spark):
    """Links that five-word shingles hardly show: 15 to 20 edits in 100 words, at random and in every fifth word."""
    rng, rows = random.Random(5), []
    for pair in range(300):
        text = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        other = list(text)
        where = range(pair // 3 % 5, 100, 5) if pair % 3 == 2 else rng.sample(range(100), (15, 20)[pair % 3])
        for n in where:
            other[n] = f"x{rng.randrange(10**9)}"
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = [sum(got[2 * p] == got[2 * p + 1] for p in range(n, 300, 3)) for n in range(3)]
    assert found[0] >= 95 and found[1] >= 75 and found[2] >= 40, found
    assert len(set(got.values())) >= 300


def test_blocks_align():
    """Both sides' links by edits alone, and by Jaccard, leave a block."""
    rng = random.Random(8)
    base = [[rng.getrandbits(63) for _ in range(60)] for _ in range(6)]
    far = [[rng.getrandbits(63) if n % 6 == 3 else w for n, w in enumerate(b)] for b in base]
    texts = [np.array(x, np.uint64) for x in base + far]
    assert not any(neardup.overlapping(neardup.distinct(texts[i]), neardup.distinct(texts[i + 6])) for i in range(6))
    block = pa.table({"left": [True] * 6 + [False] * 6, "node": list(range(12)), "comp": list(range(12)), "s": [x.tobytes() for x in texts]})
    assert sorted(map(tuple, neardup.compare(block).to_pandas().to_numpy().tolist())) == [(i, i + 6) for i in range(6)]


def test_alignment_is_exact():
    rng = random.Random(12)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(5, 90))]
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6) for _ in range(rng.randrange(2))]
        d = edit_distance(a, b)
        assert neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)
        assert neardup.apart(a, b, 1000) == d and neardup.apart(a, b, 7) == min(d, 8)


def test_alignment_never_overrates():
    """Against the whole table of edits, over texts of few words, where runs repeat, and of many."""
    rng, seen = random.Random(9), [0, 0, 0]
    for n in range(600):
        words = [10**6, 30, 4][n % 3]
        a = [rng.randrange(words) for _ in range(rng.randrange(5, 120))]
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(words) for _ in range(rng.randrange(2))]
        truth = edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
        got = neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert truth or not got
        seen[0] += truth
        seen[1] += got
    assert seen[1] > 0.97 * seen[0] > 100
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 60))] for _ in range(2))
        d = edit_distance(a, b)
        assert neardup.edits(np.array(a), np.array(b), 1000) == d and (neardup.edits(np.array(a), np.array(b), 7) == d or d > 7 < neardup.edits(np.array(a), np.array(b), 7))


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (2, "a b c d e f", 2, "y"), (3, "g", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _mark string").withColumn("_n", F.lit(0)).withColumn("comp", F.lit(1)).withColumn("node", F.lit(1))
    kept = neardup.keep_one(spark, docs)
    assert sorted((r.doc_id, r._id) for r in kept.collect()) == [(1, 1), (3, 3)] and kept.columns == docs.columns
    twice = docs.filter("doc_id = 2")
    assert neardup.keep_one(spark, twice).collect() == twice.limit(1).collect()


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9, 14))):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert partition((r.doc_id, r.class_id) for r in got) == partition(enumerate(brute(rows)))


def test_odd(spark):
    words = [f"w{i}" for i in range(60)]
    swapped = words[30:] + words[:30]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two three"), (None, " ".join(words)), (7, " ".join(words)), (7, " ".join(words)),
            (8, " ".join(words[:-1])), (9, " ".join(reversed(words))), (10, "again " * 40000), (11, "again " * 39000), (12, " ".join(swapped)), (None, "lonely words of no other text at all")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, node int, comp string")
    got = neardup.classes(spark, docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == {4} and by[6] == {6} and by[7] == by[8] == {7} and by[9] == {9}
    assert by[10] == by[11] == {10} and by[None] == {None, 7} and by[12] == {7}
    kept = neardup.keep_one(spark, docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 4, 6, 7, 9, 10, None], key=str)
    assert neardup.classes(spark, docs.filter("false")).count() == 0 and neardup.keep_one(spark, docs.filter("false")).count() == 0


def test_sketches_feel_order():
    rng = random.Random(4)
    s = np.array([rng.getrandbits(63) for _ in range(200)], np.uint64)
    agree = lambda a, b: (neardup.sketch(a) == neardup.sketch(b)).mean()
    assert agree(s, s) == 1 and agree(s, np.concatenate([s[:190], s[:10] + np.uint64(1)])) > 0.6
    assert agree(s, s[::-1].copy()) < 0.3
    assert neardup.chain([0, 4, 1, 2, 3]) == [0, 2, 3, 4] and neardup.chain([]) == []


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(9)]
    got = neardup.overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 7)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    test_a_large_group_of_near_copies(spark)
