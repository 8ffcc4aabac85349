"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds one row
for each (blob, rule version) pair ever scanned, with what was found. A scan
reads only blobs that the ledger lacks under the current rules, each once
however many paths carry it, appends them, and joins the findings to all paths.

Only Spark expressions run. Spans come from ``split`` and
``regexp_extract_all`` of the same pattern: pieces and matches alternate, so
their lengths add up to the offsets, in code points.

Defined cases: a null text is the empty text; null paths are paths like any
other; repeated rows give repeated results; an empty table gives an empty
result; further columns are ignored. Work on one text grows with the square of
its number of matches (array appends), with a small constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace

RULE_VERSION = "2"
#: kind, pattern, group measured, least length, literal that a match must contain ("" if any text may match).
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ""),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, ""),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, "eyJ"),
    ("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, "PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,rule:int,end:bigint>>"


def _spans(rule: int, text: Column, whole: Column, measured: Column) -> Column:
    _, pattern, _, least, _ = RULES[rule]
    gaps = F.split(text, pattern, -1)
    n = F.size(whole)
    starts = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<bigint>").alias("at")),
        lambda acc, i: F.struct(
            (acc["pos"] + F.length(F.get(gaps, i)) + F.length(F.get(whole, i))).alias("pos"),
            F.array_append(acc["at"], acc["pos"] + F.length(F.get(gaps, i))).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    found = F.transform(
        F.arrays_zip(starts.alias("start"), whole.alias("whole"), measured.alias("measured")),
        lambda x: F.struct(x["start"].alias("start"), F.lit(rule).alias("rule"), (x["start"] + F.length(x["whole"])).alias("end"), (F.length(x["measured"]) >= least).alias("ok")),
    )
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))
    return F.when(n > 0, kept).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame) -> DataFrame:
    """blobs (blob, text) to blob and its spans by start, then rule."""
    text = F.col("text")
    matches = {}
    for k, (_, pattern, group, _, literal) in enumerate(RULES):
        for g in {0, group}:
            got = F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
            matches[f"m{k}_{g}"] = F.when(text.contains(literal), got).otherwise(F.array().cast("array<string>")) if literal else got
    found = blobs.select("blob", "text", *(c.alias(n) for n, c in matches.items()))
    each = [_spans(k, text, F.col(f"m{k}_0"), F.col(f"m{k}_{r[2]}")) for k, r in enumerate(RULES)]
    return found.select("blob", F.array_sort(F.concat(*each)).alias("spans"))


def empty_ledger(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], f"blob binary, rules string, spans {SPAN}").coalesce(1).write.mode("ignore").parquet(path)


def update(spark: SparkSession, versions: DataFrame, ledger: str | None, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Bring a ledger up to date with versions (path, text).

    ledger: a Parquet folder in shared storage, partitioned by nothing and only
    appended to (empty_ledger starts one), or None for a scan without. Scans at
    the same time may both append a blob; its spans are the same, and it counts
    once. Returns (path, blob) of every version and the ledger's rows (blob,
    spans) under the current rules.
    """
    whole = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = ws.keep(whole.select("path", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min("path").alias("rep"))
    known = None
    if ledger is not None:
        known = spark.read.parquet(ledger).filter(F.col("rules") == RULE_VERSION).groupBy("blob").agg(F.first("spans").alias("spans"))
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    unseen = ws.keep(unseen, "unseen")
    one = unseen.withColumnRenamed("blob", "_blob").hint("shuffle_hash")  # grows with the versions: never broadcast
    fresh = whole.join(one, F.col("path").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("_blob"))).select("blob", "text")
    found = ws.keep(scan(fresh).groupBy("blob").agg(F.first("spans").alias("spans")), "found")
    if ledger is not None:
        found.select("blob", F.lit(RULE_VERSION).alias("rules"), "spans").write.mode("append").parquet(ledger)
    return paths, found if known is None else known.unionByName(found)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    names = F.array(*(F.lit(r[0]) for r in RULES))
    wanted = F.filter(spans, lambda x: F.get(names, x["rule"]).isin(*kinds))
    text = F.transform(wanted, lambda x: F.concat_ws(":", F.get(names, x["rule"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(text, ",")


def scan_documents(spark: SparkSession, docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob."""
    ws = Workspace(spark, "secrets")
    paths, found = update(spark, docs.select(F.col("doc_id").alias("path"), "text"), ledger, ws)
    hits = found.filter(F.size("spans") > 0)
    rows = paths.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    number = lambda k: F.size(F.filter("spans", lambda x: x["rule"] == k)).cast("long")
    return rows.select(
        F.col("path").alias("doc_id"), *(number(k).alias(f"n_{BASE[k]}") for k in range(3)),
        F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"),
        joined(F.col("spans"), tuple(r[0] for r in RULES)).alias("spans"), F.lower(F.hex("blob")).alias("blob"),
    )
