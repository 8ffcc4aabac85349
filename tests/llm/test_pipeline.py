"""Each stage of the pipeline on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from priorframe.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, before, docs))
    assert all(d.columns == columns for _, _, d in seen[:-1])
    (_, raw, good), (_, _, single), (_, _, clean), (_, _, mix), (_, _, shards) = seen

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    ones = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in ones) >= 0.95 * len(ones) and kept < {r.doc_id for r in raw.collect()}

    from tests.llm.test_neardup import brute

    rows = [(r.doc_id, r.text) for r in good.collect()]
    groups = defaultdict(list)
    for (i, _), c in zip(rows, brute(rows)):
        groups[c].append(i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups.values())

    tests = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    for r in single.collect():
        leaked = any(t in r.text for t in tests)
        assert not leaked or r.doc_id not in left
    assert len(left) >= 0.8 * single.count()

    words = lambda t: len((t or "").encode().split())
    plan = {r.doc_id: r for r in mixing.mix(spark, clean).collect()}
    got = Counter()
    for r in mix.collect():
        got[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text) and (r.text in left[r.doc_id])
    assert got == Counter({i: r.taken for i, r in plan.items() if r.taken})

    by = defaultdict(list)
    for r in shards.collect():
        by[r._shard].append(r._slot)
    assert sum(map(len, by.values())) == mix.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert Counter((r.doc_id, r.text) for r in shards.collect()) == Counter((r.doc_id, r.text) for r in mix.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert quality.ACCEPT == 0.7


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
