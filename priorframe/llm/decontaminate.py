"""Benchmark decontamination by greedy string tiling.

Words are folded to lower case without punctuation. Runs of ``LEAST`` words
that a document shares with a test item are seeds. For each (document, item)
whose seeds could cover enough of the item, the longest matches that overlap no
earlier one are marked, again and again, down to ``LEAST`` words; windows are
compared by Karp-Rabin hashes rolled from prefix sums, and word by word before
they are marked. The item is leaked if its marked words make up ``COVER`` of
it, in whatever order the document has them.

Documents are read once, however many items there are: a bit table of the
items' seeds, of bounded size, is broadcast, and of each document only what it
says may be a seed goes on, as hashes. These are joined with the seeds of all
items; the (document, item) pairs with enough of them are tiled from the
document's seeded stretches. Equal texts, of items and of documents, are one
text, found by their SHA-256, so copies cost nothing; ids are joined back last.
A passage that very many items share is joined as any other; Spark splits its
part of the join.

Defined cases: null or empty texts leak nothing and are never leaked; an item
of fewer than ``LEAST`` words is leaked if all its words occur together;
repeated items and documents give repeated rows; ids may be of any type and
null; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace, small_batches
from priorframe.llm.words import FOLDED, U, grams, inside_rows, mix, slices, words

LEAST = 5
COVER = 0.5
#: Bits of the table of seeds: so many for each seed, within these powers of two (16 MB at most); probes of each.
BITS_EACH, BITS_LEAST, BITS_MOST, PROBES = 32, 16, 27, 3
_BASE = 0xD6E8FEB86659FD93


def bits_of(seeds: np.ndarray, power: int) -> np.ndarray:
    """The places of seeds in a table of 2**power bits: probes x seeds."""
    return np.stack([mix(seeds + U(k + 1) * U(0x9E3779B97F4A7C15)) >> U(64 - power) for k in range(PROBES)]).astype(np.int64)


class Table:
    """Which hashes may be seeds, for each length of run that items have."""

    def __init__(self, power: int, at: np.ndarray, value: np.ndarray, lengths: list[int]):
        self.power, self.lengths = power, lengths
        self.bits = np.zeros(1 << (power - 6), np.uint64)
        self.bits[at] = value.view(np.uint64)

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        left = np.arange(len(seeds))
        for k in range(PROBES):
            at = (mix(seeds[left] + U(k + 1) * U(0x9E3779B97F4A7C15)) >> U(64 - self.power)).astype(np.int64)
            left = left[(self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) > 0]
        out = np.zeros(len(seeds), bool)
        out[left] = True
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, those of different lengths apart."""
    return mix(grams(h, k) ^ U(k))


def tiles(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in p, start in t, length), the longest first; of equal ones the first in p, then in t."""
    free_p, free_t = np.ones(len(p), bool), np.ones(len(t), bool)
    base = np.full(max(len(p), len(t)), _BASE, np.uint64)
    base[0] = 1
    base = np.cumprod(base, dtype=np.uint64)

    def rolled(h: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * base[: len(h)], dtype=np.uint64)])
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[k:] == taken[:n])
        return (sums[at + k] - sums[at]) * base[len(base) - 1 - at], at

    def common(k: int) -> list[tuple[int, int]]:
        hp, ip = rolled(p, free_p, k)
        ht, it = rolled(t, free_t, k)
        at = defaultdict(list)
        hit = np.isin(ht, hp)
        for x, j in zip(ht[hit].tolist(), it[hit].tolist()):
            at[x].append(j)
        return [(int(i), j) for x, i in zip(hp.tolist(), ip.tolist()) for j in at.get(x, ()) if np.array_equal(p[i : i + k], t[j : j + k])]

    out, most = [], min(len(p), len(t))
    while most >= least:
        lo, hi, best = least, most, []
        while lo <= hi:  # the longest length at which something unmarked matches
            k = (lo + hi) // 2
            if found := common(k):
                best, lo = found, k + 1
            else:
                hi = k - 1
        if not best:
            break
        k = hi
        for i, j in best:
            if free_p[i : i + k].all() and free_t[j : j + k].all():
                free_p[i : i + k] = free_t[j : j + k] = False
                out.append((i, j, k))
        most = k
    return out


def item_seeds(texts: DataFrame) -> DataFrame:
    """item, its words' hashes, how many seeds it needs, and its distinct seeds; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, length, seeds = [], [], [], []
            for row, data, offsets in slices(b.column("text")):
                h, first, _, _ = words(data, offsets, FOLDED)
                for r in range(len(offsets) - 1):
                    own = h[first[r] : first[r + 1]]
                    if len(own):
                        rows.append(row + r)
                        held.append(own.tobytes())
                        length.append(min(LEAST, len(own)))
                        seeds.append(np.unique(runs(own, length[-1])).view(np.int64))
            columns = [b.column("item").take(pa.array(rows, pa.int64())), pa.array(held, pa.binary()), pa.array(length, pa.int32()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "words", "length", "seeds"])

    return texts.mapInArrow(run, "item binary, words binary, length int, seeds array<long>")


def table_of(seeds: DataFrame, n: int, lengths: list[int]) -> Table:
    """The bit table of all seeds, put together where they lie; what the driver gathers is bounded by the largest table."""
    power = int(min(BITS_MOST, max(BITS_LEAST, (n * BITS_EACH).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, int] = defaultdict(int)
        for b in batches:
            for at in bits_of(b.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), power).ravel().tolist():
                own[at >> 6] |= 1 << (at & 63)
        signed = [v - 2**64 if v >= 2**63 else v for v in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(signed, pa.int64())], ["at", "value"])

    rows = seeds.select("seed").mapInArrow(run, "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()
    return Table(power, *(rows.column(c).to_numpy() for c in ("at", "value")), lengths)


def stretches(table: Table, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes of the stretches that may be seeded, their distinct hashes) of texts that have any.

    Only such stretches can hold tiles; each is followed by a word that no item has.
    """
    for row, data, offsets in slices(texts):
        h, first, _, _ = words(data, offsets, FOLDED)
        near, found, owner = np.zeros(len(h) + LEAST, bool), [], []
        for k in table.lengths:
            g = runs(h, k)
            at = np.flatnonzero(table.may_hold(g) & inside_rows(first, k)) if len(g) else np.zeros(0, np.int64)
            for j in range(k):
                near[at + j] = True
            found.append(g[at])
            owner.append(np.searchsorted(first, at, "right") - 1)
        hits, of = np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(owner) if owner else np.zeros(0, np.int64)
        for r in np.unique(of).tolist():
            picked = np.flatnonzero(near[first[r] : first[r + 1]])
            gaps = np.flatnonzero(np.diff(picked) > 1) + 1
            yield row + r, np.insert(h[first[r] + picked], gaps, np.arange(1, len(gaps) + 1, dtype=np.uint64)), np.unique(hits[of == r])


def tiled(pairs: DataFrame, cover: float) -> DataFrame:
    """doc, item, coverage and n_tiles of those pairs (doc, item, stretch, words) that are leaked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, share, many = [], [], []
            for n, (t, p) in enumerate(zip(b.column("stretch"), b.column("words"))):
                p = np.frombuffer(p.as_py(), np.uint64)
                got = tiles(p, np.frombuffer(t.as_py(), np.uint64), min(LEAST, len(p)))
                covered = sum(k for _, _, k in got) / len(p)
                if covered >= cover:
                    rows.append(n)
                    share.append(covered)
                    many.append(len(got))
            columns = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("doc", "item")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(share, pa.float64()), pa.array(many, pa.int64())], ["doc", "item", "coverage", "n_tiles"])

    return pairs.select("doc", "item", "stretch", "words").mapInArrow(run, "doc binary, item binary, coverage double, n_tiles long")


def address(text: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def leaked(spark: SparkSession, docs: DataFrame, items: DataFrame, cover: float, ws: Workspace) -> DataFrame | None:
    """doc, item (addresses of their texts), coverage, n_tiles of every leak, written; None if there are no items with words."""
    small_batches(spark)
    texts = items.filter("text is not null").select(address().alias("item"), "text").groupBy("item").agg(F.first("text").alias("text"))
    known = ws.keep(item_seeds(texts), "items")
    seeds = ws.keep(known.select("item", F.explode("seeds").alias("seed")), "seeds")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # 1 to LEAST
    if not lengths:
        return None
    sent = spark.sparkContext.broadcast(table_of(seeds, seeds.count(), lengths))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, hits = [], [], []
            for row, t, s in stretches(sent.value, b.column("text")):
                rows.append(row)
                held.append(t.tobytes())
                hits.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("text").take(pa.array(rows, pa.int64())), pa.array(held, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], ["text", "stretch", "seeds"])

    # only texts with a hit are addressed and told apart
    hit = docs.select("text").mapInArrow(scan, "text string, stretch binary, seeds array<long>").select(address().alias("doc"), "stretch", "seeds")
    hit = ws.keep(hit.groupBy("doc").agg(F.first(F.struct("stretch", "seeds")).alias("x")).select("doc", "x.*"), "hits")
    shared = hit.select("doc", F.explode("seeds").alias("seed")).join(ws.sized(seeds), "seed").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"))
    # distinct seeds of an item are at most as many as its places, so fewer than enough of them can't cover enough of it
    repeats = F.col("distinct") < F.octet_length("words") / 8 - F.col("length") + 1
    facts = known.select("item", "words", "length", F.size("seeds").alias("distinct"))
    enough = repeats | (F.col("n") * F.col("length") >= F.lit(cover) * F.octet_length("words") / 8)
    pairs = ws.keep(shared, "pairs").join(ws.sized(ws.keep(facts, "facts")), "item").filter(enough).select("doc", "item", "words")
    return ws.keep(tiled(pairs.join(hit.select("doc", "stretch").hint("shuffle_hash"), "doc"), cover), "leaks")


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles for every leaked item of every document."""
    ws = Workspace(spark, "tiling")
    found = leaked(spark, docs, items, cover, ws)
    none = F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")
    if found is None:
        return docs.select("doc_id", none, F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_tiles")).filter("false")
    named = items.filter("text is not null").select("item_id", address().alias("item"))
    told = found.join(named, "item").select("doc", "item_id", "coverage", "n_tiles")
    return docs.select("doc_id", address().alias("doc")).join(ws.sized(ws.keep(told, "told")), "doc").select("doc_id", "item_id", "coverage", "n_tiles")


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents in which no item is leaked, unchanged."""
    ws = Workspace(spark, "tiling")
    found = leaked(spark, docs, items, cover, ws)
    if found is None:
        return docs
    bad = ws.sized(ws.keep(found.select(F.col("doc").alias("__leaked")).distinct(), "bad"))
    return docs.join(bad, F.unhex(F.sha2(docs["text"].cast("binary"), 256)) == bad["__leaked"], "left_anti")
