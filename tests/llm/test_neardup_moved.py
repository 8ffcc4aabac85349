"""Texts whose blocks are moved are near-duplicates too, if they share enough shingles."""

import random

import numpy as np

from priorframe.llm import neardup
from tests.llm.test_neardup import brute, partition


def moved(words, parts):
    step = len(words) // parts
    blocks = [words[a : a + step] for a in range(0, step * parts - step, step)] + [words[step * parts - step :]]
    return [w for b in reversed(blocks) for w in b]


def test_moved_blocks_are_linked(spark):
    rng = random.Random(6)
    rows = []
    for pair in range(300):
        size, parts = ((60, 2), (200, 2), (200, 3), (200, 4))[pair % 4]
        text = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(moved(text, parts)))]
    got = neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = partition(enumerate(brute(rows)))
    assert len(want) == 300 and partition((r.doc_id, r.class_id) for r in got) == want
    assert neardup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).count() == 300


def test_unordered_keys():
    rng = np.random.default_rng(5)
    s = rng.integers(1, 2**63, 200, dtype=np.uint64)
    assert (neardup.unordered(s) == neardup.unordered(np.concatenate([s[::-1], s[:50]]))).all() and not len(neardup.unordered(s[:0]))
    assert len(set(neardup.unordered(s).tolist()) | set(neardup.sketch(s).tolist())) == neardup.SETS + neardup.SKETCHES
