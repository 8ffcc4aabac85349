"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed words, of trigrams of its shape (letters,
digits and white space in classes, other marks as they are) and of how often
its words repeat. A bounded sample of labelled texts gives the term weights, a
truncated SVD and the labelled vectors; these are broadcast. Every document's
vector is compared with all labelled vectors by exact cosine products, block
by block, and its ``NEIGHBOURS`` nearest vote with their similarity.

The sample is the one bound: of each class ``SAMPLE`` labelled ids that have a
document, the first by a hash of the id, with one text each. Only they are
gathered, so the model has the same size at every scale.

Defined cases: a null text is the empty text; a text without words scores the
share of label 1 in the sample's population, as does any text if there are no
labels; equal texts score alike, as products are made in blocks of one shape;
null labels are left out, as are those without a document; of several labels of
one id the lowest counts, of several texts the one with the least hash; a
column score of the documents is replaced; equal neighbours beyond the last place are taken in
sample order; an empty table gives an empty result; further columns pass
through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace, small_batches
from priorframe.llm.words import FOLDED, U, slices, words

SAMPLE = 1500
TERMS, SHAPES, REPEATS = 4096, 2048, 16
WIDTH = TERMS + SHAPES + REPEATS
RANK = 64
NEIGHBOURS = 15
POWER = 4
ACCEPT = 0.7
ROWS = 128

_SHAPE = np.arange(256, dtype=np.uint8)
for _c in range(256):
    _k = chr(_c)
    _SHAPE[_c] = ord("a") if _c >= 128 or _k.islower() else ord("A") if _k.isupper() else ord("0") if _k.isdigit() else ord(" ") if _c <= 32 else _c


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, term counts) of blocks of at most ROWS texts."""
    for row, data, offsets in slices(texts):
        n = len(offsets) - 1
        h, first, _, _ = words(data, offsets, FOLDED)
        s = _SHAPE[data].astype(np.int64)
        tri = ((s[:-2] * 128 + s[1:-1]) * 128 + s[2:]) if len(s) > 2 else np.zeros(0, np.int64)
        inside = np.ones(len(s), bool)
        ends = offsets[1:]
        for back in (1, 2):
            at = ends - back
            inside[at[at >= 0]] = False
        tri = ((tri.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(53)).astype(np.int64)  # 2048 of them
        byte_row = np.repeat(np.arange(n), np.diff(offsets))
        word_row = np.repeat(np.arange(n), np.diff(first))
        term = (h >> U(52)).astype(np.int64)  # 4096 of them
        once = np.unique(h + word_row.astype(np.uint64) * U(0xD6E8FEB86659FD93), return_index=True)[1]
        distinct, all_words = np.bincount(word_row[once], minlength=n), np.diff(first)
        bins = np.where(all_words > 0, np.minimum(REPEATS - 1, (REPEATS * distinct) // np.maximum(1, all_words)), 0)
        ok = inside[: len(tri)]
        for lo in range(0, n, ROWS):
            hi = min(n, lo + ROWS)
            out = np.zeros((hi - lo, WIDTH), np.float32)
            a, b = int(first[lo]), int(first[hi])
            flat = np.bincount((word_row[a:b] - lo) * TERMS + term[a:b], minlength=(hi - lo) * TERMS)
            out[:, :TERMS] = flat.reshape(hi - lo, TERMS)
            a, b = int(offsets[lo]), min(int(offsets[hi]), len(tri))
            keep = ok[a:b]
            flat = np.bincount((byte_row[a:b][keep] - lo) * SHAPES + tri[a:b][keep], minlength=(hi - lo) * SHAPES)
            out[:, TERMS : TERMS + SHAPES] = flat.reshape(hi - lo, SHAPES)
            some = all_words[lo:hi] > 0
            out[np.flatnonzero(some), TERMS + SHAPES + bins[lo:hi][some]] = 1
            yield row + lo, out


class Model:
    """Term weights, projection and labelled vectors. The table is used up: the sample's counts are held once."""

    def __init__(self, table: np.ndarray, labels: np.ndarray, prior: float):
        self.prior = float(prior)
        self.empty = not len(labels)
        if self.empty:
            return
        seen = np.count_nonzero(table, axis=0)
        self.weights = np.log((1 + len(table)) / (1 + seen)).astype(np.float32) + 1
        x = self.weigh(table, own=True)
        rank = min(RANK, *x.shape)
        rng = np.random.default_rng(7)
        q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], rank + 16), dtype=np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
        self.project = np.ascontiguousarray(v[:rank].T)
        self.vectors = unit(x @ self.project)
        self.labels = labels.astype(np.float32)
        # each class votes by its share of the population, not of the sample
        ones = max(1.0, float(self.labels.sum()))
        zeros = max(1.0, len(labels) - ones)
        self.votes = np.where(self.labels > 0, self.prior / ones, (1 - self.prior) / zeros).astype(np.float32)
        self.votes /= self.votes.mean()

    def weigh(self, table: np.ndarray, own: bool = False) -> np.ndarray:
        """Damped counts, weighted; words, shapes and repetition each of length one. In place if the table is its own."""
        x = np.log1p(table, out=table if own else None)
        x *= self.weights
        for lo, hi in ((0, TERMS), (TERMS, TERMS + SHAPES), (TERMS + SHAPES, WIDTH)):
            part = x[:, lo:hi]
            n = np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
            part /= np.where(n > 0, n, 1)
        return x

    def score(self, table: np.ndarray) -> np.ndarray:
        out = np.full(len(table), self.prior)
        some = np.flatnonzero(table.any(1)) if not self.empty else []
        if not len(some):
            return out
        block = np.zeros((max(ROWS, len(some)), WIDTH), np.float32)  # one shape, so that equal rows give equal products
        block[: len(some)] = table[some]
        near = (unit(self.weigh(block) @ self.project) @ self.vectors.T)[: len(some)]
        k = min(NEIGHBOURS, near.shape[1])
        order = np.argsort(-near, axis=1, kind="stable")[:, :k]
        like = np.maximum(np.take_along_axis(near, order, 1), 0).astype(np.float64) ** POWER * self.votes[order]
        total = like.sum(1)
        out[some] = np.where(total > 0, (like * self.labels[order]).sum(1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside the held-out fold."""
    small_batches(spark)
    ws = Workspace(spark, "quality")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("quality"))
    known = ws.keep(known.join(docs.select("doc_id").filter(fold(F.col("doc_id")) != 2), "doc_id", "left_semi"), "labels")
    share = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    picked = known.filter("quality = 0").orderBy(*order).limit(SAMPLE).unionByName(known.filter("quality = 1").orderBy(*order).limit(SAMPLE))
    picked = ws.keep(picked.withColumnRenamed("doc_id", "_id"), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # 2 SAMPLE ids at most
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).getField("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [zlib.compress(np.minimum(r, 65535).astype(np.uint16).tobytes(), 1) for _, t in counts(b.column("text")) for r in t]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "terms"])

    rows = sorted(texts.mapInArrow(pack, "doc_id string, quality int, terms binary").collect(), key=lambda r: r[0])
    table = np.empty((len(rows), WIDTH), np.float32)
    for n, r in enumerate(rows):
        table[n] = np.frombuffer(zlib.decompress(r[2]), np.uint16)
    total = sum(share.values())
    return Model(table, np.array([r[1] for r in rows]), share.get(1, 0) / total if total else 1.0)


def scored(spark: SparkSession, docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """docs with a column score; only rows of at least that score if one is given, then without the column."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs if least is not None else docs.drop("score")
    schema = docs.schema if least is not None else docs.withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.concatenate([sent.value.score(t) for _, t in counts(b.column("text"))] or [np.zeros(0)])
            if least is not None:
                yield b.filter(pa.array(got >= least))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, "score"])

    return docs.mapInArrow(score, schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(spark, docs, labels)
    got = scored(spark, docs.select("doc_id", "text"), model)
    return got.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
