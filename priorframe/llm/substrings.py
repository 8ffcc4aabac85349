"""Substring deduplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window
over it also starts in a document with a smaller id.

To keep the search linear, shards are made by content. Each window has a
minimiser, the five-word run in it with the least hash, and equal windows have
equal minimisers. Documents are dealt into groups; groups report their
minimisers to buckets of hashes, and learn which of theirs other texts have
too. Only stretches around such shared minimisers are indexed:
a stretch goes to the shard of its minimiser, so equal windows meet. Where very
many texts share a minimiser, its windows go one by one, by their own hash, so
no passage makes a shard large.

A shard sorts its stretches' suffixes, to more words than a window has, and
keeps their Burrows-Wheeler transform as a wavelet matrix of packed bits. The
stretches are streamed through backward search, which gives matching statistics:
for the last word of each window the length of the longest run up to it that
occurs elsewhere, counted up to a window's words. Those that reach the window
report its interval, whose least id is the first document that has the window.

Equal word sequences are found first by their SHA-256; only the one with the
least id is searched, and of the others all windows repeat.

Words are compared by 40 bits of a hash, in windows of 13: a false match needs
twelve equal words beside a collision.

Defined cases: a null text has no words; rows with a null id count as later
than all others and don't repeat each other; rows that repeat an id aren't
earlier than each other; ids are whole numbers, others raise a TypeError; a text of fewer words than a window is kept whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace, small_batches
from priorframe.llm.words import U, grams, slices, words

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
#: Words of a group of documents and, about, of a shard; minimisers of a bucket.
GROUP_WORDS = 1 << 20
BUCKET = 1 << 21
#: Texts with a minimiser from which on its windows are dealt one by one.
HEAVY = 256
#: Windows of a stretch at most, where a minimiser repeats on and on.
RUN = 64
BYTES = 5
LAST = 2**63 - 1
STATUS, SHARED, HEAVIES, FOUND = range(4)
INFO = "grp int, kind int, id long, mark long, digest binary, copy boolean, data binary"
INFO_SCHEMA = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("digest", pa.binary()), ("copy", pa.bool_()), ("data", pa.binary())])


class FMIndex:
    """A sequence of symbols below `sigma`; patterns of at most `depth` symbols can be searched."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int = 16):
        n = len(symbols)
        rank = symbols.astype(np.int64)
        have = 1
        while have < depth:
            ahead = np.zeros(n, np.int64)
            if have < n:
                ahead[: n - have] = rank[have:] + 1
            rank = np.unique(rank * (n + sigma + 2) + ahead, return_inverse=True)[1]
            have *= 2
        self.places = np.argsort(rank, kind="stable").astype(np.int32 if n < 2**31 else np.int64)
        last = symbols[self.places - 1]
        self.size, self.sigma = n, sigma
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((last >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Follow places down the levels of the wavelet matrix."""
        for k, level in enumerate(reversed(range(self.levels))):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.sums[k][word] + np.bitwise_count(self.bits[k][word] & ((U(1) << rest) - U(1)))
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.first[symbol] - self.start[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Matching statistics of a text of the index, up to `most` symbols, which each end has behind it.

        (length, who, group, lo, hi): length is that of the longest run up to each end that occurs elsewhere, too; the
        ends `who` reach `most`, and lo[group], hi[group] are the intervals of their runs. Ends whose runs so far are
        equal stand in one interval, so each interval is extended by each symbol once.
        """
        length, who, group = np.zeros(len(ends), np.int64), np.arange(len(ends)), np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size)
        for k in range(most):
            key, group = np.unique(group * self.sigma + text[ends[who] - k], return_inverse=True)
            lo, hi = self.step(key % self.sigma, lo[key // self.sigma], hi[key // self.sigma])
            more = hi - lo > 1
            stay = more[group]
            who, group, lo, hi = who[stay], (np.cumsum(more) - 1)[group[stay]], lo[more], hi[more]
            length[who] = k + 1
        return length, who, group, lo, hi


def first_ids(stretches: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each stretch (words of BYTES bytes), the least id of a stretch that has it."""
    lengths = np.array([len(s) // BYTES for s in stretches])
    raw = np.frombuffer(b"".join(stretches), np.uint8).reshape(-1, BYTES)
    word = np.zeros((len(raw), 8), np.uint8)
    word[:, :BYTES] = raw
    _, symbol = np.unique(word.view(np.uint64).ravel(), return_inverse=True)
    start = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int64)  # symbol 0 follows every stretch
    inside = np.ones(len(text), bool)
    inside[start + lengths] = False
    text[inside] = symbol + 1
    index = FMIndex(text, int(symbol.max()) + 2)
    owner = np.repeat(ids, lengths + 1)

    many = np.maximum(0, lengths - WINDOW + 1)
    window = np.repeat(start, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    least = owner[window]
    _, who, group, lo, hi = index.matching(text, window + WINDOW - 1, WINDOW)
    if len(who):
        order = np.argsort(lo)  # runs of one length: their intervals are apart
        cuts = np.stack([lo[order], hi[order]], axis=1).ravel()
        held = np.append(owner[index.places], LAST)
        first = np.empty(len(lo), np.int64)
        first[order] = np.minimum.reduceat(held, cuts)[::2]
        least[who] = first[group]
    return np.split(least, np.cumsum(many)[:-1])


def minimisers(h: np.ndarray) -> np.ndarray:
    """48 bits of the minimiser of every window, also of those across rows."""
    v = grams(h, GRAM) >> U(16)
    if len(v) < SPAN:
        return np.zeros(0, np.uint64)
    for width in (1, 2, 4):
        v = np.minimum(v[:-width], v[width:])  # least of 2, 4, 8
    return np.minimum(v[:-1], v[1:])  # of SPAN = 9


class Row:
    """A document in a group: its place, its words as bytes and its windows' minimisers."""

    __slots__ = ("at", "words", "least")

    def __init__(self, at: int, words_: bytes, least: np.ndarray):
        self.at, self.words, self.least = at, words_, least


def rows_of(texts: pa.Array) -> Iterator[Row]:
    for row, data, offsets in slices(texts):
        h, first, _, _ = words(data, offsets)
        low = h.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() if len(h) else b""
        v = minimisers(h)
        for r in range(len(offsets) - 1):
            a, b = int(first[r]), int(first[r + 1])
            yield Row(row + r, low[a * BYTES : b * BYTES], v[a : max(a, b - WINDOW + 1)])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array, without sorting it again."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def stretches(row: Row, shared: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(first window, words, routing number) of the stretches around shared minimisers."""
    if not len(row.least) or not len(shared):
        return
    hit = among(row.least, shared)
    if not hit.any():
        return
    cut = np.ones(len(hit) + 1, bool)
    cut[1:-1] = (row.least[1:] != row.least[:-1])
    edges = np.flatnonzero(cut)
    many = among(row.least, heavy)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if not hit[a]:
            continue
        if many[a]:
            for k in range(a, b):
                w = row.words[k * BYTES : (k + WINDOW) * BYTES]
                yield k, w, number(w)
        else:
            for k in range(a, b, RUN):
                yield k, row.words[k * BYTES : (min(b, k + RUN) + WINDOW - 1) * BYTES], int(row.least[a])


def number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def pack6(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() if len(v) else b""


def unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def info_of(info: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, dict]:
    """Of a group: (id, mark) -> (digest, copy); shared and heavy minimisers; stretch number -> first ids."""
    status, shared, heavy, found = {}, [], [], {}
    for kind, i, m, digest, copy, data in zip(*(info.column(c).to_pylist() for c in ("kind", "id", "mark", "digest", "copy", "data"))):
        if kind == STATUS:
            status[i, m] = (digest, copy)
        elif kind == SHARED:
            shared.append(unpack6(data))
        elif kind == HEAVIES:
            heavy.append(unpack6(data))
        else:
            found[i] = np.frombuffer(data, np.int64)
    join = lambda x: np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64)
    return status, join(shared), join(heavy), found


def dedup(spark: SparkSession, docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with texts kept, the kept words joined by one space."""
    small_batches(spark)
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids are compared as whole numbers; doc_id is " + docs.schema["doc_id"].dataType.simpleString())
    ws, with_texts = Workspace(spark, "substrings"), texts
    text = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), F.xxhash64("text").alias("mark"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d = [], []
            for t in b.column("text"):
                w = (t.as_py() or "").encode().split()
                n.append(len(w))
                d.append(hashlib.sha256(b" ".join(w)).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(d, pa.binary())], ["id", "mark", "n", "digest"])

    base = ws.keep(text.drop("doc_id").mapInArrow(digests, "id long, mark long, n long, digest binary"), "digests")
    total = base.agg(F.sum("n")).collect()[0][0] or 0
    groups = max(1, math.ceil(total / GROUP_WORDS))
    buckets = max(1, math.ceil(total / 5 / BUCKET))
    # rows without an id are dealt by a hash of their text alone, as others by id and text
    grp = F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).cast("int").alias("grp")
    # written, so that the join has its own exchange: Spark splits the partition of a very common text
    first = ws.keep(base.groupBy("digest").agg(F.min("id").alias("first")), "first")
    status = base.join(first, "digest").select("id", "mark", "digest", (F.col("id") > F.col("first")).alias("copy"))
    status = ws.keep(status.select(grp, F.lit(STATUS).alias("kind"), "id", "mark", "digest", "copy", F.lit(None).cast("binary").alias("data")), "status")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [pack6(np.unique(r.least)) for r in rows_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), b.column("mark"), pa.array(sets, pa.binary())], ["grp", "id", "mark", "least"])

    seen = text.select(grp, "id", "mark", "text").mapInArrow(fingerprints, "grp int, id long, mark long, least binary").filter(F.length("least") > 0)

    def report(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        known = info_of(info)[0]
        once = {}
        for i, m, least in zip(rows.column("id").to_pylist(), rows.column("mark").to_pylist(), rows.column("least").to_pylist()):
            digest, copy = known[i, m]
            if not copy:
                once[digest] = least
        if not once:
            return BUCKET_SCHEMA.empty_table()
        v, n = np.unique(np.concatenate([unpack6(x) for x in once.values()]), return_counts=True)
        to = v % U(buckets)  # minimisers are small numbers: ranges of them would be uneven
        order = np.argsort(to, kind="stable")
        v, n, to = v[order], n[order], to[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])  # only buckets that occur
        out = [(int(to[lo]), key[0].as_py(), pack6(v[lo:hi]), np.minimum(n[lo:hi], 255).astype(np.uint8).tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:])]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), BUCKET_SCHEMA)], schema=BUCKET_SCHEMA)

    told = seen.groupBy("grp").cogroup(status.groupBy("grp")).applyInArrow(report, "bucket int, grp int, least binary, many binary")

    def share(rows: pa.Table) -> pa.Table:
        grps = rows.column("grp").to_pylist()
        parts = [unpack6(x) for x in rows.column("least").to_pylist()]
        v = np.concatenate(parts)
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("many").to_pylist()])
        values, back = np.unique(v, return_inverse=True)
        # a group's count stops at 255, so a minimiser may be called heavy early, never late by more than its groups
        texts = np.bincount(back, weights=n)[back]
        out, at = [], 0
        for g, p in zip(grps, parts):
            t = texts[at : at + len(p)]
            at += len(p)
            for kind, ok in ((SHARED, t > 1), (HEAVIES, t >= HEAVY)):
                if ok.any():
                    out.append((g, kind, None, None, None, None, pack6(p[ok])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), INFO_SCHEMA)], schema=INFO_SCHEMA) if out else INFO_SCHEMA.empty_table()

    shared = ws.keep(told.groupBy("bucket").applyInArrow(share, INFO), "shared")
    info = status.unionByName(shared)
    dealt = text.withColumn("grp", grp)

    def cut(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        known, common, heavy, _ = info_of(info)
        rows = rows.combine_chunks()
        ids, marks = rows.column("id").to_pylist(), rows.column("mark").to_pylist()
        ends: dict[tuple[int, bytes], tuple[int, int]] = {}
        for r in rows_of(pa.concat_arrays(rows.column("text").chunks) if len(rows) else pa.array([], pa.string())):
            i = ids[r.at]
            if not known[i, marks[r.at]][1]:
                for _, w, to in stretches(r, common, heavy):
                    lo, hi = ends.get((to, w), (i, i))
                    ends[to, w] = (min(lo, i), max(hi, i))
        g = key[0].as_py()
        out = [(to % groups, g, w, lo, hi) for (to, w), (lo, hi) in ends.items()]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), STRETCH_SCHEMA)], schema=STRETCH_SCHEMA) if out else STRETCH_SCHEMA.empty_table()

    pieces = dealt.groupBy("grp").cogroup(info.groupBy("grp")).applyInArrow(cut, "shard int, grp int, words binary, lo long, hi long")

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("lo")
        data, lo, hi, grps = (rows.column(c).to_pylist() for c in ("words", "lo", "hi", "grp"))
        out = []
        for g, w, last, least in zip(grps, data, hi, first_ids(data, np.array(lo, np.int64))):
            if (least < last).any():
                out.append((g, FOUND, number(w), None, None, None, least.tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), INFO_SCHEMA)], schema=INFO_SCHEMA) if out else INFO_SCHEMA.empty_table()

    found = ws.keep(pieces.groupBy("shard").applyInArrow(search, INFO), "found")

    def remove(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        known, common, heavy, hits = info_of(info)
        ids, marks, own = rows.column("id").to_pylist(), rows.column("mark").to_pylist(), rows.column("doc_id")
        texts = pa.concat_arrays(rows.column("text").chunks) if len(rows) else pa.array([], pa.string())
        n, gone, sha, kept = [], [], [], []
        for r in rows_of(texts):
            i = ids[r.at]
            digest, copy = known[i, marks[r.at]]
            many = len(r.words) // BYTES
            drop = np.zeros(many + 1, np.int64)
            if copy:
                drop[0] = len(r.least) > 0
            else:
                for k, w, _ in stretches(r, common, heavy):
                    least = hits.get(number(w))
                    if least is not None:
                        at = k + np.flatnonzero(least < i)
                        drop[at] += 1
                        drop[at + WINDOW] -= 1
            out = np.cumsum(drop[:many]) > 0
            n.append(many)
            gone.append(int(out.sum()))
            if not gone[-1] and not with_texts:
                sha.append(digest.hex())
                continue
            left = [x for x, y in zip((texts[r.at].as_py() or "").encode().split(), out.tolist()) if not y]
            joined = b" ".join(left)
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode())
        columns = [own.combine_chunks() if len(rows) else pa.array([], own.type), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.table([*columns, pa.array(kept, pa.string())], names=[*names, "kept"]) if with_texts else pa.table(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_texts
    return dealt.groupBy("grp").cogroup(info.unionByName(found).groupBy("grp")).applyInArrow(remove, schema)


BUCKET_SCHEMA = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("least", pa.binary()), ("many", pa.binary())])
STRETCH_SCHEMA = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("words", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])
