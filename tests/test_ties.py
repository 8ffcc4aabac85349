"""Numbers on, or next to, the middle between two roundings."""

import math
import random

from priorframe import queries
from priorframe.functions.text import general


def test_general_format_near_ties(spark):
    """Numbers that print as, or are nearest to, ten digits and a five round as they are, not as they print; true ties go to the even digit."""
    rng, values = random.Random(4), [0.5, 1234567890.5, 1234567891.5, 12345678905.0, 12345678915.0, 0.00012207031255, 999999999.95, 9999999999.5, 99999999995.0, 9999999999.4999999, 1.7976931348623157e308, -0.0]
    for _ in range(3000):
        tie = float(f"{rng.randrange(10**9, 10**10)}5e{rng.randrange(-29, 27)}")
        values += [tie, -tie, math.nextafter(tie, 0), math.nextafter(tie, math.inf)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", general("v").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{v:.10g}" for v in values]


def test_ranks_of_p_as_c_computes_it(spark, tmp_path):
    """Pairs of events whose p differ by the last bit of a power, in the order that C's powers give."""
    ids = [6939, 35590, 36745, 57752, 60578, 64391, *range(-50, 50), *range(0, 100000, 7)]
    ids = sorted(set(ids))
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    p = {i: math.fmod(i * 7919, 10007) / 10007.0 * (math.fmod(i, 100) / 100.0) ** 4 for i in ids}
    want = {i: n for n, i in enumerate(sorted(ids, key=lambda i: (p[i], i)), 1)}
    got = {r.event_id: r["rank"] for r in queries.bh_fdr(spark, str(tmp_path)).collect()}
    assert got == want
