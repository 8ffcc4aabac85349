"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to one of ``CELLS`` equal cells of the ring. The virtual nodes of a
shard own the cells up to their own position, clockwise. A shard takes its own
keys up to its capacity; the rest continue clockwise to the next shards with
room. Capacities add up to exactly the row count, so shard sizes differ by at
most one row. What the driver plans from is the number of rows in each cell: a
table whose size is the parameter, not the data. Rows then find their shard by
their rank in their cell. A cell of more than ``CELL_ROWS`` rows, be it of a
large table or of one key that very many rows repeat, is ranked in parts, by a
hash of the whole row, which are laid end to end; so no task ranks a whole cell.

Defined cases: a null text has size 1 and CRC 0; rows with a null id are placed
by their text's CRC and size; rows that are equal in all columns are told apart
only by their slot, and ranked by one task; an empty table gives an empty
result; further columns are ignored, and _shard and _slot replaced.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace, local_rows

SHARDS = 16
VNODES = 64
CELL_BITS = 14
CELLS = 1 << CELL_BITS
CELL_ROWS = 1 << 18


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    def token(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big")

    nodes = sorted((token(s, v), s) for s in range(n_shards) for v in range(vnodes))
    return [(t >> (64 - CELL_BITS), s) for t, s in nodes]


def plan(counts: dict[int, int], n_shards: int, vnodes: int = VNODES) -> list[dict]:
    """Pieces (cell, lo, hi, shard, slot, home): ranks lo..hi-1 of a cell go to a shard, from that slot on."""
    nodes = ring(n_shards, vnodes)
    at = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot = [0] * n_shards
    pieces, left = [], []

    def take(cell: int, lo: int, n: int, shard: int, home: int) -> None:
        if n:
            pieces.append({"cell": cell, "lo": lo, "hi": lo + n, "shard": shard, "base": slot[shard], "home": home})
            slot[shard] += n
            room[shard] -= n

    for cell in sorted(counts):
        k = bisect.bisect_left(at, cell) % len(nodes)
        home = nodes[k][1]
        n = min(counts[cell], room[home])
        take(cell, 0, n, home, home)
        if n < counts[cell]:
            left.append((cell, n, counts[cell], k, home))
    for cell, lo, hi, k, home in left:
        while lo < hi:
            shard = nodes[k % len(nodes)][1]
            n = min(hi - lo, room[shard])
            take(cell, lo, n, shard, home)
            lo, k = lo + n, k + 1
    return pieces


def assign(spark: SparkSession, rows: DataFrame, key: str, n_shards: int = SHARDS) -> DataFrame:
    """rows (key, size, text_crc32, _salt, and _doc if there is one) with home (the shard that owns the key), shard and slot."""
    ws = Workspace(spark, "sharding")
    h = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(F.xxhash64("text_crc32", "size"))
    placed = rows.withColumn("_h", h).withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int"))
    base = ws.keep(placed.drop("_doc"), "rows")
    counts = {r[0]: r[1] for r in base.groupBy("_cell").count().collect()}  # at most CELLS rows
    pieces = local_rows(spark, plan(counts, n_shards), "cell int, lo long, hi long, shard int, base long, home int")
    ranked = placed if "_doc" in rows.columns else base
    large = [{"_large": c, "_parts": -(-n // CELL_ROWS)} for c, n in counts.items() if n > CELL_ROWS]
    if large:
        parts = F.broadcast(local_rows(spark, large, "_large int, _parts long"))  # at most CELLS rows
        split = lambda df: df.join(parts, F.col("_cell") == F.col("_large"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_h", "_salt"), F.col("_parts")), F.lit(0)).cast("int")).drop("_large", "_parts")
        sizes = split(base).groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_part")) - F.col("_n")
        starts = ws.keep(sizes.select(F.col("_cell").alias("_c"), F.col("_part").alias("_p"), before.alias("_before")), "starts")
        ranked = split(ranked).join(ws.sized(starts), (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p"))).drop("_c", "_p")
    else:
        ranked = ranked.withColumn("_part", F.lit(0)).withColumn("_before", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_h", key, "text_crc32", "size", "_salt")) - 1 + F.col("_before")
    ranked = ranked.withColumn("_rank", rank.cast("long"))
    hit = (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    return ranked.join(F.broadcast(pieces), hit).select(
        *rows.columns, "home", "shard", (F.col("base") + F.col("_rank") - F.col("lo")).alias("slot")
    )


def described(docs: DataFrame, *more) -> DataFrame:
    """doc_id, size in bytes plus one, CRC32 of the text, and a hash of the row."""
    text = F.coalesce("text", F.lit(""))
    others = [F.hash(F.col(f"`{f.name}`")) if "map" not in f.dataType.simpleString() else F.lit(0) for f in docs.schema if f.name != "text"]
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    return docs.select(*more, "doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(size, crc, *others).alias("_salt"))


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, home."""
    return assign(spark, described(docs), "doc_id", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )


def sharded(spark: SparkSession, docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The documents themselves, in their columns, with _shard and _slot."""
    docs = docs.drop("_shard", "_slot")
    placed = assign(spark, described(docs, F.struct(*docs.columns).alias("_doc")), "doc_id", n_shards)
    return placed.select("_doc.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
