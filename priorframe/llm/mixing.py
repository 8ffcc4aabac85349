"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source gets a target number of words (weights, a ceiling of ``CEILING``
times its size, the excess reshared). The mix is a number of equal blocks of
words; Sainte-Lague's highest quotients give every source, and then every lane
of a source, an integer number of blocks. A lane is a seeded random share of a
source's documents in seeded order; its words form a line cut into blocks. A
lane that gets more blocks than it has takes each block once or twice and the
rest from a seeded block on, around the line. What a document gives is the
overlap of its stretch of the line with the blocks taken, so no block is ever
materialised. No lane takes a block more than twice; seats that a lane can't
use go to the lanes of the source that have room. A lane of very many words is
laid out in stretches, ranges of its order, so no task holds a whole lane.

The quotients ranked are only those that can decide: with n claimants a
claimant's seats differ from its share by less than its part of n/2, plus one
half, so the candidates are about five per claimant.

Defined cases: a null text has size 0; null is a source of its own, the last;
a source without words gets nothing; rows that agree in id, source and size
are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
#: Words of a block: the smallest target makes this many blocks at least, down to blocks of one word.
BLOCKS_IN_LEAST = 256
LARGEST_BLOCK = 2048
#: Words of a lane, and the most lanes of a source before lanes grow.
LANE_WORDS = 1 << 16
LANES = 1024
#: Words of a stretch of a lane that is laid out by one task.
STRETCH_WORDS = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """sizes (source, words) with weight, cap and target: the water level under which all uncapped sources stand."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    fill = Window.orderBy("ratio", "place")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole)
    return (
        sizes.withColumn("place", order).withColumn("weight", w)
        .withColumn("cap", F.col("words") * ceiling).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("words").over(whole) * share - before) / rest)
        .withColumn("target", F.least("cap", level * F.col("weight")))
        .select("source", "place", "words", "target")
    )


def sainte_lague(claims: DataFrame, over: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """claims with quota: integer seats by highest quotients votes / (2k + 1) within each group of `over`.

    Equal quotients go to the smaller name. The seats to give are in column `seats`, the same in a group.
    """
    group = Window.partitionBy(*over)
    total = F.sum(votes).over(group)
    part = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    ideal = part * F.col(seats)
    slack = part * F.count(F.lit(1)).over(group) / 2
    least = F.greatest(F.lit(0).cast("long"), F.floor(ideal - slack).cast("long") - 1)
    most = F.ceil(ideal + slack).cast("long") + 1
    sure = claims.withColumn("_least", least).withColumn("_most", F.when(F.col(votes) > 0, most).otherwise(F.lit(0).cast("long")))
    sure = sure.withColumn("_open", F.col(seats) - F.sum("_least").over(group))
    claim = sure.filter("_most > _least").withColumn("_k", F.explode(F.expr("sequence(_least, _most - 1)")))
    claim = claim.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    won = F.row_number().over(Window.partitionBy(*over).orderBy(F.col("_q").desc(), name, "_k")) <= F.col("_open")
    got = claim.withColumn("_won", won).filter("_won").groupBy(*over, name).agg(F.count(F.lit(1)).alias("_more"))
    on = [*over, name]
    return sure.join(got, on, "left").withColumn("quota", F.col("_least") + F.coalesce("_more", F.lit(0))).drop("_least", "_most", "_open", "_more")


def mix(spark: SparkSession, docs: DataFrame, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and the part of it taken once more.

    Columns: copies (times the whole text is taken), cut_from and cut_words (a
    further stretch of its words, counted from 0), again_words (a second
    stretch, from its first word, where the blocks go around the lane's end);
    with carry also _doc, the document's own columns.
    """
    ws = Workspace(spark, "mixing")
    whole_docs = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    base = ws.keep(whole_docs.drop("_doc"), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("words"))
    aimed = targets(sizes)
    whole = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    block = F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(1), F.floor(least / BLOCKS_IN_LEAST))).cast("long")
    aimed = aimed.withColumn("block", F.coalesce(block, F.lit(1).cast("long")))
    aimed = aimed.withColumn("seats", F.round(F.sum("target").over(whole) / F.col("block")).cast("long")).withColumn("_all", F.lit(0))
    lanes = F.least(F.lit(LANES), F.greatest(F.lit(1), F.ceil(F.col("words") / LANE_WORDS))).cast("int")
    sources = ws.keep(sainte_lague(aimed, ["_all"], "place", "target", "seats").withColumn("lanes", lanes).drop("_all", "seats").withColumnRenamed("quota", "source_quota"), "sources")

    by_source = ws.sized(sources).withColumnRenamed("source", "_source")
    laned = (whole_docs if carry else base).join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "size")
    laned = laned.withColumn("_h", order).withColumn("lane", F.pmod(F.shiftright("_h", 20), F.col("lanes").cast("long")).cast("int"))
    lane_sizes = laned.groupBy("place", "lane").agg(F.sum("size").alias("lane_words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    quotas = sainte_lague(lane_sizes, ["place"], "lane", "lane_words", "source_quota")
    blocks = F.ceil(F.col("lane_words") / F.col("block")).cast("long")
    # seats beyond twice a lane's blocks go to lanes with room, the roomiest first
    source = Window.partitionBy("place")
    quotas = quotas.withColumn("blocks", blocks).withColumn("_room", F.greatest(F.lit(0).cast("long"), 2 * F.col("blocks") - F.col("quota")))
    quotas = quotas.withColumn("_spare", F.sum(F.greatest(F.lit(0).cast("long"), F.col("quota") - 2 * F.col("blocks"))).over(source))
    filled = F.sum("_room").over(source.orderBy(F.desc("_room"), "lane").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_room")
    gained = F.greatest(F.lit(0).cast("long"), F.least(F.col("_room"), F.col("_spare") - filled))
    quotas = quotas.withColumn("quota", F.least(F.col("quota"), 2 * F.col("blocks")) + gained)
    quotas = (
        quotas
        .withColumn("copies", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.col("quota") - F.col("copies") * F.col("blocks"))
        .withColumn("first", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "place", "lane"), F.col("blocks"))).otherwise(F.lit(0)).cast("long"))
        .select("place", "lane", "copies", F.least("lane_words", F.col("first") * F.col("block")).alias("lo"),
                F.least("lane_words", (F.col("first") + F.col("extra")) * F.col("block")).alias("hi"),
                F.greatest(F.lit(0), F.col("first") + F.col("extra") - F.col("blocks")).alias("around"), "block")
        .withColumn("around", F.col("around") * F.col("block")).drop("block")
    )
    quotas = ws.keep(quotas, "quotas")
    # lanes of many words are laid out in ranges of their order, which start where the ranges before them end
    ranges = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / F.col("lanes") / STRETCH_WORDS))
    at = F.shiftright("_h", 32) + F.lit(1 << 31)  # 0 to 2^32 - 1, in the order of _h
    laned = laned.withColumn("_range", F.shiftright(at * ranges, 32).cast("int"))
    line = Window.partitionBy("place", "lane", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = laned.withColumn("_to", F.sum("size").over(line))
    if sources.filter(ranges > 1).limit(1).count():
        sums = laned.groupBy("place", "lane", "_range").agg(F.sum("size").alias("_words"))
        before = F.sum("_words").over(Window.partitionBy("place", "lane").orderBy("_range")) - F.col("_words")
        starts = ws.keep(sums.select("place", "lane", "_range", before.alias("_before")), "starts")
        placed = placed.join(ws.sized(starts), ["place", "lane", "_range"]).withColumn("_to", F.col("_to") + F.col("_before"))
    placed = placed.withColumn("_from", F.col("_to") - F.col("size"))
    placed = placed.join(ws.sized(quotas), ["place", "lane"])

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least("_to", hi) - F.greatest("_from", lo))

    placed = (
        placed.withColumn("cut_words", overlap(F.col("lo"), F.col("hi")))
        .withColumn("cut_from", F.when(F.col("cut_words") > 0, F.greatest(F.lit(0), F.col("lo") - F.col("_from"))).otherwise(F.lit(0)))
        .withColumn("again_words", overlap(F.lit(0), F.col("around")))
    )
    taken = F.col("copies") * F.col("size") + F.col("cut_words") + F.col("again_words")
    return placed.select(
        "doc_id", "source", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "copies", "cut_from", "cut_words", "again_words", *(["_doc"] if carry else [])
    )


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself, in the columns of docs: whole texts once for each time they are taken, and the stretches cut from others.

    A stretch keeps the white space after its words; n_chars, if there is such a column, follows the text.
    """
    text = F.coalesce(F.col("_doc.text"), F.lit(""))

    def stretch(start, n):
        parts = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        cut = F.array_join(F.slice(parts, start.cast("int") + 1, n.cast("int")), "")
        return F.when(n == 0, F.array().cast("array<string>")).when(n == F.col("size"), F.array(text)).otherwise(F.array(cut))

    texts = F.concat(F.array_repeat(text, F.col("copies").cast("int")), stretch(F.col("cut_from"), F.col("cut_words")), stretch(F.lit(0), F.col("again_words")))
    out = mix(spark, docs, seed, carry=True).filter("taken > 0").withColumn("_text", F.explode(texts))
    own = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(own.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))

