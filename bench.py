"""Seconds of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

from priorframe import queries
from priorframe.session import session

HEADLINE = [
    "prior_form", "prior_form_linear", "prior_std_sum_margin", "games_this_season", "climatology", "asof_prior_order", "box_two_sides", "star_left", "pivot_diff_sum_matchup", "half_max", "modal_impute",
    "venue_cascade_lookup", "geo_travel", "rest_flags", "weather_climatology", "upsert_log", "fold_range_join", "mine_cells", "bh_fdr", "residual_cells", "vacated_share", "negbinom_over",
    "elo_pre", "ridge_adjusted", "wf_home", "wf_ols", "wf_linear", "binary_metrics", "calib_table", "ats_record", "by_season_sets", "log_hash_verify",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["scan_filter_band"](spark, d).count()  # starts the JVM's and the readers' machinery
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d}))
    spark.stop()


if __name__ == "__main__":
    main()
