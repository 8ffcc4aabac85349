"""The append-only prediction log: each (model, game) once, hashed, and checked before it is scored."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from priorframe.functions.calendar import EASTERN, instant, stamp, to_utc
from priorframe.functions.text import row_hash
from priorframe.metrics import TARGETS, Target, prediction_columns, summarize
from priorframe.operators.relational import anti_by, first_by, upsert

KEY = ["model", "game_id"]
# What a row's hash covers when it is written, in this order. The list is stored with the row, so later columns don't break old hashes.
FIELDS = ["logged_at", "vintage", "model", "game_id", "season", "week", "kickoff", "home_team", "away_team", *prediction_columns(list(TARGETS)), "vegas_spread", "vegas_total"]
TYPES = {t: "double" for t in (*prediction_columns(list(TARGETS)), "vegas_spread", "vegas_total")} | {"season": "int", "week": "int"}


def with_fields(preds: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """preds with every field of the log; a missing one is null."""
    return preds.select(*(c for c in preds.columns if c not in fields), *((F.col(f) if f in preds.columns else F.lit(None)).cast(TYPES.get(f, "string")).alias(f) for f in fields))


def signed(preds: DataFrame, vintage: str, now: Column | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """Rows as the log holds them; the hash covers the time they are written at and the vintage, so neither can be changed later."""
    stamped = preds.withColumn("logged_at", stamp(now if now is not None else F.current_timestamp())).withColumn("vintage", F.lit(vintage))
    types = {f: TYPES.get(f, "string") for f in fields}
    return with_fields(stamped, fields).select(*fields, row_hash(fields, types).alias("row_hash"), F.lit(",".join(fields)).alias("hash_fields"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def append(spark: SparkSession, preds: DataFrame, path: str, vintage: str, now: Column | None = None) -> int:
    """Add the rows whose (model, game) isn't logged yet; returns how many. Nothing is ever rewritten.

    Of several rows of one key in preds the first in order of its fields is logged. Writers at the same time may both log
    a key, as a folder of files has no lock; readers take the entry that counts (entries).
    """
    new = first_by(signed(preds, vintage, now), KEY, [F.col(f).asc_nulls_last() for f in FIELDS])
    if exists(spark, path):
        new = anti_by(new, read(spark, path), KEY)
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def entries(log: DataFrame) -> DataFrame:
    """One row for each (model, game): the one written first; of equal times the one with the least hash."""
    return first_by(log, KEY, [F.col("logged_at").asc_nulls_last(), F.col("row_hash").asc_nulls_last()])


def verify(log: DataFrame) -> DataFrame:
    """log with status: ok, tampered, or unverifiable.

    A row is checked against the list of fields it was written with. A row without one is older than the lists: it is ok
    if its hash is that of today's fields, or of those of them that it has; else it is unverifiable, not tampered with,
    as is a row without a hash or whose fields the log no longer has.
    """
    if "row_hash" not in log.columns:
        return log.withColumn("status", F.lit("unverifiable"))
    kinds = dict(log.dtypes)
    tagged = "hash_fields" in log.columns
    lists = [r[0] for r in log.select("hash_fields").distinct().collect()] if tagged else []  # one entry for each version of the format
    again = F.lit(None).cast("string")
    for names in lists:
        fields = [f for f in (names or "").split(",") if f]
        if fields and all(f in kinds for f in fields):
            again = F.when(F.col("hash_fields") == names, row_hash(fields, kinds)).otherwise(again)
    untagged = (F.coalesce(F.col("hash_fields"), F.lit("")) == "") if tagged else F.lit(True)
    have = [f for f in FIELDS if f in kinds]
    old = with_fields(log, [f for f in FIELDS if f not in kinds]) if len(have) < len(FIELDS) else log
    now_kinds = dict(old.dtypes)
    legacy = (row_hash(FIELDS, now_kinds) == F.col("row_hash")) | (row_hash(have, kinds, known_only=True) == F.col("row_hash"))
    status = (
        F.when(F.col("row_hash").isNull(), "unverifiable").when(untagged, F.when(legacy, "ok").otherwise("unverifiable"))
        .when(again.isNull(), "unverifiable").when(again == F.col("row_hash"), "ok").otherwise("tampered")
    )
    return old.withColumn("status", status).select(*log.columns, "status")


def before_kickoff(log: DataFrame, zone: str = EASTERN) -> DataFrame:
    """log with whether each row was written before its game began; false where either time is unknown.

    Kickoffs are wall clocks of the zone; one that the clock change skips or repeats is unknown. The session's zone plays no part.
    """
    start = to_utc(F.replace(F.col("kickoff").cast("string"), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"), zone)
    return log.withColumn("before_kickoff", F.coalesce(instant(F.col("logged_at")) < start, F.lit(False)))


def score(log: DataFrame, actuals: DataFrame, targets: list[Target] | None = None) -> DataFrame:
    """Metrics by model, season and week of honest rows whose games are played; the market line is the one logged."""
    honest = before_kickoff(entries(log)).filter("before_kickoff")
    outcome = actuals.select("game_id", *(t.column for t in TARGETS if t.column in actuals.columns))
    return summarize(honest.join(outcome, "game_id"), targets, ["model", "season", "week"]).filter("n_games > 0")


def _states(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the states that were written whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [(int(m[1]), f"{path}/{m[0]}") for n in names if (m := re.fullmatch(r"state-(\d+)-[0-9a-f]+", n))]
    return sorted(x for x in found if exists(spark, f"{x[1]}/_SUCCESS"))


def update_performance(spark: SparkSession, path: str, new: DataFrame) -> str:
    """Put new scores in place of those with the same (model, season, week, target); returns the folder that now holds them.

    A folder can't be overwritten while it is read, so each state is a numbered folder of its own and the last one that was
    written whole counts: a job that dies in between leaves the old state as it was.
    """
    old = current(spark, path)
    number = max([n for n, _ in _states(spark, path)], default=0) + 1
    state = f"{path}/state-{number:06d}-{uuid.uuid4().hex}"
    (upsert(old, new, ["model", "season", "week", "target"]) if old is not None else new).write.parquet(state)
    return state


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = _states(spark, path)
    return spark.read.parquet(found[-1][1]) if found else None
