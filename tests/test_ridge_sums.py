"""Ridge ratings from sums by cell against the rows themselves."""

import datetime
import random

import numpy as np
import pandas as pd

from priorframe.operators import ridge


def test_cells_give_what_rows_give(spark):
    """Rows with missing and infinite values; a task is given cells, not a row for each pair of row and boundary."""
    rng, start = random.Random(7), datetime.datetime(2020, 1, 1)
    rows = []
    for _ in range(900):
        a, b = rng.sample("abcd", 2)
        rows.append((a, b, rng.randrange(2), start + datetime.timedelta(hours=rng.randrange(24 * 700)), rng.choice([rng.gauss(0, 1)] * 8 + [None, float("nan"), float("inf")])))
    ends = [(2020 + n // 4, n % 4 + 1, start + datetime.timedelta(days=90 * n)) for n in range(1, 8)]
    df = spark.createDataFrame(rows, "team string, opponent string, is_home int, kickoff timestamp, off_m double")
    got = ridge.adjusted(df, spark.createDataFrame(ends, "season int, week int, asof timestamp"), ("m",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("FlatMapGroupsInPandas") : plan.index("Join")]
    got = got.toPandas().set_index(["season", "week", "team"])
    count = 0
    for season, week, asof in ends:
        some = pd.DataFrame([r for r in rows if r[3] < asof and r[4] is not None and np.isfinite(r[4])], columns=["t", "o", "h", "k", "y"])
        x = np.column_stack([*(some.t == n for n in "abcd"), *(some.o == n for n in "abcd"), some.h]).astype(float)
        w = 0.5 ** ((asof - some.k).dt.total_seconds().to_numpy() / 86400 / 400)
        b = ridge.weighted_ridge(x, some.y.to_numpy(), w, 12.0)
        for n, team in enumerate("abcd"):
            at = got.loc[(season, week, team)]
            assert np.allclose([at["m_off"], at["m_def"]], [b[n], b[4 + n]], atol=1e-9)
            count += 1
    assert count == len(got)
