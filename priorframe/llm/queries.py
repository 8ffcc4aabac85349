"""The thin opN_ queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm import chat, decontaminate, mixing, mtree, neardup, oracles, quality, secrets, sharding, substrings, urlfilter
from priorframe.llm.store import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans through a ledger: of the documents that an earlier state held, then of all; the second scans only what the first hasn't."""
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "ledger")
    ledger = f"{ws.base}/ledger"
    secrets.empty_ledger(spark, ledger)
    secrets.update(spark, docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).select(F.col("doc_id").alias("path"), "text"), ledger, ws)
    return secrets.scan_documents(spark, docs, ledger)


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"))


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(spark, table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


PROBE = oracles.PROBE


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.digest(chat.format_chats(said.unionByName(probe)))


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark, table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Days of the list's log, from this date; captures are spread over the same days.
FIRST_DAY, DAYS = "2024-01-01", 360


def op10_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no list and no fetch times, so both are derived from hashes of hosts and URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")

    def day(c, place: int):
        return F.conv(F.substring(F.md5(c), place, 4), 16, 10).cast("int") % DAYS

    def on(days):
        return F.date_add(F.lit(FIRST_DAY).cast("date"), days).cast("date")

    captures = pages.withColumn("fetched_at", on(day(F.col("url"), 1)))
    hosts = pages.select(urlfilter.host(F.col("url")).alias("h"), urlfilter.segment(F.col("url")).alias("s")).filter("h <> ''").distinct()
    domain = F.regexp_replace("h", r"^(m|blog|www)\.", "")
    pick = F.substring(F.md5("value"), 9, 1)
    hosts_listed = hosts.select(F.lit("host").alias("kind"), domain.alias("value")).distinct().filter(pick.isin("0", "1", "2", "3", "4"))
    paths_listed = hosts.filter("s <> ''").select(F.lit("path").alias("kind"), F.concat("h", F.lit("/"), "s").alias("value")).distinct().filter(pick.isin("5", "6"))
    listed = hosts_listed.unionByName(paths_listed)
    added = listed.select("kind", "value", F.lit("add").alias("action"), on(day(F.col("value"), 17)).alias("at"))
    removed = listed.filter(F.substring(F.md5("value"), 10, 1) < "8").select("kind", "value", F.lit("remove").alias("action"), on(day(F.col("value"), 21)).alias("at"))
    return urlfilter.evaluate(spark, captures, added.unionByName(removed))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
