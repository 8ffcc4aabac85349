"""Substring deduplication against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from priorframe.llm import substrings

SF = "/root/testdata/sf0.01"


def brute(rows):
    seqs = [(i if i is not None else 2**63 - 1, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in seqs:
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (own, _) in zip(seqs, rows):
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs):
    return sorted(map(tuple, substrings.dedup(spark, docs, texts=False).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"GROUP_WORDS": 20000, "BUCKET": 3000, "HEAVY": 5}])
def test_all_windows(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(substrings, k, v)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(spark, docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("heavy", [2, 256])
def test_odd(spark, monkeypatch, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "GROUP_WORDS", 500)
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, "\n \t"), (4, "short one"), (5, "short one"), (6, "again " * 3000), (7, "again " * 2000), (8, "x " + "again " * 20 + "y"), (8, "x " + "again " * 20 + "y"),
            (None, passage), (None, passage), (9, "a b c " * 15), (10, "q " + "a b c " * 14), (11, "again\n" * 3000), (12, " ".join(f"p{i}" for i in range(13))), (13, " ".join(f"p{i}" for i in range(12)))]
    for i in range(100, 160):
        rows.append((i, " ".join(f"r{rng.randrange(40)}" for _ in range(rng.randrange(30))) + f" {passage} " + " ".join(f"r{rng.randrange(40)}" for _ in range(30))))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, grp int, mark string").repartition(3)
    assert got(spark, docs) == brute(rows)
    assert got(spark, docs.filter("false")) == []


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 6, 800), 0)
    index = substrings.FMIndex(text, 6)
    for _ in range(200):
        a = int(rng.integers(0, 780))
        p = text[a : a + int(rng.integers(1, 14))]
        lo, hi = np.array([0]), np.array([len(text)])
        for c in p[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        want = sorted(i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all())
        assert sorted(index.places[lo[0] : hi[0]].tolist()) == want


@pytest.mark.parametrize("letters", [2, 4, 40])
def test_matching_statistics(letters):
    rng = np.random.default_rng(letters)
    text = np.append(rng.integers(1, letters + 1, 400), 0)
    text[100:130] = text[300:330]
    index = substrings.FMIndex(text, letters + 1)
    ends = rng.permutation(np.arange(12, 400))
    length, who, group, lo, hi = index.matching(text, ends, 13)

    def places(run):
        return [i for i in range(len(text) - len(run) + 1) if (text[i : i + len(run)] == run).all()]

    for e, n in zip(ends.tolist(), length.tolist()):
        assert n == max([k for k in range(1, 14) if len(places(text[e - k + 1 : e + 1])) > 1], default=0)
    assert sorted(who.tolist()) == np.flatnonzero(length == 13).tolist()
    for w, g in zip(who.tolist(), group.tolist()):
        assert sorted(index.places[lo[g] : hi[g]].tolist()) == places(text[ends[w] - 12 : ends[w] + 1])
    assert [len(x) for x in index.matching(text, ends[:0], 13)[:3]] == [0, 0, 0]


def test_kept_words(spark):
    w = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "new\n" + "  ".join(w[:14]) + " end")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substrings.dedup(spark, docs).collect()} == {1: " ".join(w), 2: "new end"}
