"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words; its shingles are runs of five words. Equal
sequences are one node. A sketch of a node takes the three shingles, labelled by
their occurrence, with the least values of one hash, and keeps them in text
order: it agrees for two texts only if what they share stands in the same
order. Half of the 16 sketches see each shingle's first occurrence only, so
that repetition alone doesn't hide a link. A further 32 keys take three of the
distinct shingles as a set, so that neither order nor repetition hides one, and
48 more three of the distinct runs of three words, of which edits leave more.

Two nodes are linked if a banded alignment of their words shows an edit
similarity of ``SIMILAR`` or more (edits of words against the longer text), or
if that part of their distinct shingles is shared (Jaccard), in whatever order:
an alignment sees moved blocks as edits. Classes are the connected components.

Texts that share enough pairs of neighbouring words for a link are aligned in
full, by columns held as bits, so the test is exact. For long texts an alignment
along the shingles that they share, in a chain as long as possible, comes first;
what it costs follows the edits.

Nodes that agree in a key form a bucket, whose hub is the node that is in
most buckets. Every node is first compared, alignment included, with the hubs
it agrees with in ``MEET`` keys, and, if none of them is near, with the hubs of
all its other buckets; most of a group of copies is near its hub, so this star
links groups of any size by a number of pairs proportional to their size. What
is then still apart from its hub's component, and agrees with the
others around that hub in ``AGREE`` keys, is compared with them in blocks:
products of shingle matrices for Jaccard, and of word pairs for what to align, of
which only links between different components leave a task. Of a node's hubs those of the most common
buckets, ``AGREE`` - 1 buckets together at most, are left out there: texts
that agree in ``AGREE`` keys still share another hub; so a line that very many
unlike texts share costs nothing.

Node numbers are 64 bits of a hash of the words. Two texts that share a part J
of their shingles agree in a key with a chance of J^3. So of those with J of 0.8,
the order of what is shared aside, more than 0.9999 are found; and of those that
are near by their edits alone, where one is the other's hub, more than 0.99 at
ten or 15 edits spread over 100 words and some 0.9 at 20, the most that a link
may have. It is less for texts of a few shingles, and for texts that owe most
of what they share to a passage that other texts have, too.

Defined cases: null and empty texts are one class; texts under five words are
similar only to equal ones; a null id is an id like any other, and the class id
is the least id that isn't null; repeated rows share a class; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorframe.llm.store import Workspace, small_batches
from priorframe.llm.words import U, grams, mix, slices, words

SHINGLE = 5
SIMILAR = 0.8
SKETCHES = 16
SETS = 32
SHORT, SHORTS = 3, 48
TAKEN = 3
#: Keys in which a node and a hub that it is compared with first, and two nodes of a block, agree at least.
MEET, AGREE = 2, 5
#: Texts of one side of a block that is compared at once, and columns of its matrices.
SIDE, COLUMNS = 256, 4096

_rng = np.random.default_rng(8)
_ODD = _rng.integers(1, 2**63, SKETCHES + SETS, dtype=np.uint64) * U(2) + U(1)
_XOR = _rng.integers(1, 2**63, SKETCHES + SETS, dtype=np.uint64)
_ODD = np.append(_ODD, _rng.integers(1, 2**63, SHORTS, dtype=np.uint64) * U(2) + U(1))
_XOR = np.append(_XOR, _rng.integers(1, 2**63, SHORTS, dtype=np.uint64))
_HALF = SKETCHES // 2
#: Shingles whose hashes for all sketches are held at once.
BLOCK = 1 << 14


def mark() -> F.Column:
    """A hash of the text as it is."""
    return F.xxhash64("text")


def node_of(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "big", signed=True)


def occurrences(s: np.ndarray) -> np.ndarray:
    """How many equal shingles stand before each."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.ones(len(s), bool)
    new[1:] = run[1:] != run[:-1]
    start = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return out


def least(values: np.ndarray, sketches: slice) -> np.ndarray:
    """The places, in text order, of the TAKEN values least under each sketch: sketches x TAKEN."""
    odd, flip = _ODD[sketches], _XOR[sketches]
    k = min(TAKEN, len(values))
    places = np.zeros((0, len(odd)), np.int64)
    for lo in range(0, len(values), BLOCK):
        part = values[lo : lo + BLOCK]
        h = (part[:, None] ^ flip) * odd
        best = np.argpartition(h, k - 1, axis=0)[:k] if len(part) > k else np.repeat(np.arange(len(part))[:, None], len(odd), 1)
        places = np.concatenate([places, best + lo])
    if len(places) > k:
        h = (values[places] ^ flip) * odd
        places = np.take_along_axis(places, np.argpartition(h, k - 1, axis=0)[:k], 0)
    return np.sort(places, axis=0).T


def folded(chosen: np.ndarray, part: slice) -> np.ndarray:
    """A key for each sketch from the values it has chosen: sketches x TAKEN."""
    key = np.arange(part.start + 1, part.stop + 1, dtype=np.uint64)
    for column in chosen.T:
        key = mix(key * U(0xD6E8FEB86659FD93) + column)
    return key


def sketch(s: np.ndarray) -> np.ndarray:
    """A key for each sketch of a text with these shingles."""
    if not len(s):
        return np.zeros(0, np.int64)
    seen = occurrences(s)
    labelled = mix(s + seen.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    first = mix(s[seen == 0])
    keys = []
    for values, part in ((labelled, slice(0, _HALF)), (first, slice(_HALF, SKETCHES))):
        keys.append(folded(values[least(values, part)], part))
    return np.concatenate(keys).view(np.int64)


def unordered(s: np.ndarray, part: slice = slice(SKETCHES, SKETCHES + SETS)) -> np.ndarray:
    """A key for each set of a text with these shingles, in whatever order and however often."""
    if not len(s):
        return np.zeros(0, np.int64)
    values = mix(np.unique(s))
    return folded(np.sort(values[least(values, part)], axis=1), part).view(np.int64)


def short(h: np.ndarray) -> np.ndarray:
    """A key for each set of a text of these words, from runs too short for many edits to change all."""
    return unordered(grams(h, SHORT), slice(SKETCHES + SETS, SKETCHES + SETS + SHORTS)) if len(h) >= SHINGLE else np.zeros(0, np.int64)


def shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes, shingle hashes)."""
    for row, data, offsets in slices(texts):
        h, first, _, _ = words(data, offsets)
        s = grams(h, SHINGLE)
        for r in range(len(offsets) - 1):
            a, b = int(first[r]), int(first[r + 1])
            yield row + r, h[a:b], s[a : max(a, b - SHINGLE + 1)]


def chain(at: list[int]) -> list[int]:
    """Where a longest increasing subsequence stands."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(at)
    for n, x in enumerate(at):
        k = bisect_left(tails, x)
        back[n] = ends[k - 1] if k else -1
        tails[k : k + 1] = [x]
        ends[k : k + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(n)
        n = back[n]
    return out[::-1]


#: Cells of a table of edits from which on its rows are made as arrays.
SMALL = 400


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to change, add or leave out to make b of a; more than `most` if they are more, but not how many then.

    Cells further than `most` from the diagonal can't lie on a path of so few edits and are left out.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return len(a) + len(b)
    if len(a) * len(b) <= SMALL:
        x, y = a.tolist(), b.tolist()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, z in enumerate(y, 1):
                before, row[j] = row[j], min(before + (w != z), row[j] + 1, row[j - 1] + 1)
        return row[-1]
    far, step = len(a) + len(b) + 1, np.arange(len(b) + 1)
    row = np.where(step <= most, step, far)
    for i in range(1, len(a) + 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        best = np.minimum(row[lo - 1 : hi] + (b[lo - 1 : hi] != a[i - 1]), row[lo : hi + 1] + 1)
        row[lo - 1] = i if lo == 1 else far
        best[0] = min(best[0], row[lo - 1] + 1)
        row[lo : hi + 1] = np.minimum.accumulate(best - step[lo : hi + 1]) + step[lo : hi + 1]
        if row[lo - 1 : hi + 1].min() > most:
            return most + 1
    return int(row[-1])


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(h, 2), return_counts=True)


def bigrams_shared(a: np.ndarray, b: np.ndarray) -> int:
    (x, n), (y, m) = counted(a), counted(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def labelled(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The shingles, of n words, of words, each told apart from equal ones before it."""
    s = grams(h, n)
    return mix(s + occurrences(s).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the words a and b are at most the edits apart that SIMILAR leaves."""
    longer = max(len(a), len(b))
    most = int((1 - SIMILAR) * longer + 1e-9)
    # an edit changes two pairs of neighbours, so with few edits most pairs are shared
    if abs(len(a) - len(b)) > most or bigrams_shared(a, b) < longer - 1 - 2 * most:
        return False
    # what the chain costs follows the edits, so it comes first for long texts only
    return longer > LONG and chained(a, b, most) or apart(a.tolist(), b.tolist(), most) <= most


#: Words from which on a chain of shared shingles is tried first.
LONG = 2000


def apart(a: list[int], b: list[int], most: int) -> int:
    """As edits, by columns of the whole table held as bits of a number: where it rises and where it falls."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, done, left = whole, 0, len(a), len(b)
    for w in b:
        same = places.get(w, 0)
        x = (((same & up) + up) ^ up) | same
        rise, fall = down | (whole & ~(x | up)), up & x
        done += 1 if rise & last else -1 if fall & last else 0
        left -= 1
        if done - left > most:
            return most + 1
        rise, fall, x = (rise << 1 | 1) & whole, (fall << 1) & whole, same | down
        up, down = fall | (whole & ~(x | rise)), rise & x
    return done


def chained(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether an alignment along shared shingles has at most so many edits."""
    _, i, j = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= most
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    done, u, v = 0, 0, 0  # edits so far, up to these places
    for n in chain(j):
        p, q = i[n], j[n]
        if p < u or q < v:  # overlaps the match before: it continues it, or is shifted against it
            if p - u == q - v:
                u, v = p + SHINGLE, q + SHINGLE
            continue
        done += edits(a[u:p], b[v:q], most - done)
        if done > most:
            return False
        u, v = p + SHINGLE, q + SHINGLE
    return done + edits(a[u:], b[v:], most - done) <= most


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct shingles of words, sorted."""
    return np.unique(grams(h, SHINGLE))


def overlapping(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts, as distinct shingles, share enough of them."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and shared >= SIMILAR * (len(a) + len(b) - shared)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts, as hashes of their words, are near-duplicates."""
    return overlapping(distinct(a), distinct(b)) or min(len(a), len(b)) >= SHINGLE and aligned(a, b)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text as it is), node and keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys = [], []
            for _, h, s in shingles(b.column("text")):
                nodes.append(node_of(h))
                keys.append(np.concatenate([sketch(s), unordered(s), short(h)]))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            made = [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *made], ["doc_id", "mark", "node", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", mark().alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, node long, keys array<long>")


def features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and s, the hashes of its words, for wanted (node, rep); the texts are found by the id of one document each."""
    found = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, held = [], []
            want = b.column("node").to_pylist()
            for row, h, _ in shingles(b.column("text")):
                if node_of(h) == want[row]:  # ids need not be unique
                    nodes.append(want[row])
                    held.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(held, pa.binary())], ["node", "s"])

    return found.mapInArrow(run, "node long, s binary")


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are linked."""
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [linked(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(x.column("sa"), x.column("sb"))]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node and comp, its component's least node, for all nodes of edges (a, b).

    What nodes are told is written before it is joined with itself on the component, so that the join has its own
    exchanges and Spark splits the partition of a very large component.
    """
    both = ws.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = ws.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        seen = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "m").alias("m"))
        told = ws.keep(seen.select("node", "m").unionByName(seen.select(F.col("comp").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("comp")), "told")
        jump = told.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = told.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("root", "comp")).alias("comp"))
        old, label = label, ws.keep(new, "labels")
        moved = label.join(old.withColumnRenamed("comp", "was"), "node").filter("comp <> was").limit(1).count()
        ws.drop(old, told)
        if not moved:
            return label


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of a shares with each of b; the shingles of each are distinct."""
    parts = [*a, *b]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, shingle, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    met = many > 1
    column = (np.cumsum(met) - 1)[shingle]
    keep = met[shingle]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = int(met.sum())
    for lo in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((len(parts), min(COLUMNS, width - lo)), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def compare(block: pa.Table) -> pa.Table:
    """Links (a, b) between components, enough to join all that are linked, of the left and right side of a block."""
    left = np.array(block.column("left").to_pylist(), bool)
    nodes, comps = (np.array(block.column(c).to_pylist(), np.int64) for c in ("node", "comp"))
    texts = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("s")]
    sets = [distinct(x) for x in texts]
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    links: list[tuple[int, int]] = []
    if len(a) and len(b):
        size = np.array([len(x) for x in sets])
        shared = overlaps([sets[i] for i in a], [sets[i] for i in b])
        near = (shared > 0) & (shared >= SIMILAR * (size[a][:, None] + size[b] - shared) - 1e-3) & (comps[a][:, None] != comps[b])
        root = {int(c): int(c) for c in comps}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def join(pairs: np.ndarray, told) -> None:
            for i, j in pairs.tolist():
                x, y = int(a[i]), int(b[j])
                p, q = find(int(comps[x])), find(int(comps[y]))
                if p != q and told(x, y):
                    root[p] = q
                    links.append((int(nodes[x]), int(nodes[y])))

        join(np.argwhere(near), lambda x, y: overlapping(sets[x], sets[y]))
        # what aligned asks for first, of all pairs at once
        length = np.array([len(x) for x in texts])
        most = ((1 - SIMILAR) * np.maximum(length[a][:, None], length[b]) + 1e-9).astype(int)
        maybe = (np.abs(length[a][:, None] - length[b]) <= most) & (np.minimum(length[a][:, None], length[b]) >= SHINGLE) & (comps[a][:, None] != comps[b])
        i, j = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if len(i):
            pairs = overlaps([labelled(texts[n], 2) for n in a[i]], [labelled(texts[n], 2) for n in b[j]])
            at = np.ix_(i, j)
            x, y = np.nonzero(maybe[at] & (pairs >= np.maximum(length[a[i]][:, None], length[b[j]]) - 1 - 2 * most[at] - 1e-3))
            join(np.column_stack([i[x], j[y]]), lambda x, y: aligned(texts[x], texts[y]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def around(ws: Workspace, members: DataFrame, label: DataFrame) -> DataFrame:
    """lead, i, j, node, comp and side (left) of the blocks: nodes apart from their hub against all nodes around it.

    Counts by hub are written before they are joined, so that a join on the hub has its own exchange, whose large
    partitions Spark splits.
    """
    comp = label.select("node", "comp")
    by = ws.keep(members.groupBy("lead", "node").agg(F.count(F.lit(1)).alias("c")), "by")
    sizes = ws.keep(by.groupBy("lead").agg(F.count(F.lit(1)).alias("size")), "groups")
    # a group of a hub and one node is done if the star has met it
    by = by.join(sizes, "lead").filter((F.col("size") > 2) | (F.col("c") < AGREE))
    # of all groups that two nodes share, the last in this order is needed for both, if they agree often enough
    own = Window.partitionBy("node").orderBy(F.desc("size"), "lead").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("upto", F.sum("c").over(own)).filter(F.col("upto") >= AGREE)
    by = by.join(comp, "node", "left").join(comp.select(F.col("node").alias("lead"), F.col("comp").alias("main")), "lead", "left")
    by = by.select("lead", "node", F.coalesce("comp", "node").alias("comp"), (F.coalesce("comp", "node") != F.coalesce("main", "lead")).alias("left"))
    by = ws.keep(by, "apart")
    counts = by.groupBy("lead").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("left").cast("long")).alias("lefts")).filter("lefts > 0 and all > 1")
    by = by.join(ws.keep(counts, "counts"), "lead")
    rows, columns = F.ceil(F.col("lefts") / SIDE).cast("int"), F.ceil(F.col("all") / SIDE).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = by.filter("left").select("lead", place(rows).alias("i"), each(columns).alias("j"), "node", "comp", F.lit(True).alias("left"))
    b = by.select("lead", each(rows).alias("i"), place(columns).alias("j"), "node", "comp", F.lit(False).alias("left"))
    return a.unionByName(b)


def grouped(ws: Workspace, docs: DataFrame) -> DataFrame:
    """doc_id, mark, node and comp (its class's least node) of every document.

    Shared keys and hubs are written before they are joined on the key, so that Spark splits the partition of a key
    that very many nodes have.
    """
    small_batches(ws.spark)
    base = ws.keep(sketched(docs), "sketches")
    unique = base.select("node", "keys").distinct()
    keyed = ws.keep(unique.select("node", F.explode("keys").alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    members = ws.keep(keyed.join(ws.keep(shared, "shared"), "key"), "members")
    ws.drop(keyed)
    reps = base.groupBy("node").agg(F.min("doc_id").alias("rep"))
    met = ws.keep(members.groupBy("node").agg(F.count(F.lit(1)).alias("w")), "met")
    known = ws.keep(features(docs, reps.join(met.select("node"), "node", "left_semi")), "features")

    # the node that meets others most often has the least text of its own, so most of a group is near it
    hubs = members.join(met, "node").groupBy("key").agg(F.max(F.struct("w", "node")).getField("node").alias("lead"))
    members = ws.keep(members.select("key", "node").join(ws.keep(hubs, "hubs"), "key"), "around")
    star = ws.keep(members.filter("node <> lead").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).count(), "star")
    links = ws.keep(verified(star.filter(F.col("count") >= MEET).select("a", "b"), known), "links")
    # hubs can differ from key to key, so a node may be near many of them and meet none of them twice
    alone = star.filter(F.col("count") < MEET).join(links.select("b").distinct(), "b", "left_anti")
    links = ws.keep(links.unionByName(verified(alone.select("a", "b"), known)), "links")
    label = components(ws, links)
    blocks = around(ws, members, label).join(known, "node")
    more = ws.keep(blocks.groupBy("lead", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    if more.limit(1).count():
        label = components(ws, links.unionByName(more))
    ids = base.select("doc_id", "mark", "node").join(label, "node", "left").select("doc_id", "mark", "node", F.coalesce("comp", "node").alias("comp"))
    return ws.keep(ids, "ids")


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the class's least doc_id), class_size, node, mark, comp (the class's least node)."""
    ws = Workspace(spark, "neardup")
    ids = grouped(ws, docs)
    least_id = ws.keep(ids.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return ids.join(least_id, "comp").select("doc_id", "class_id", "class_size", "node", "mark", "comp")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The document with the least id of every class, unchanged; of several with that id, one of those with the least mark."""
    ws = Workspace(spark, "keepone")
    alike = grouped(ws, docs).groupBy("comp", "doc_id", "mark").count()
    # a class without any id keeps a document without one
    best = alike.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "count")).alias("x"))
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    id_, mark_, n_ = map(free, ("_id", "_mark", "_n"))
    chosen = ws.keep(best.select(F.col("x.doc_id").alias(id_), F.col("x.mark").alias(mark_), F.col("x.count").alias(n_)), "chosen")

    def pick(some: DataFrame) -> DataFrame:
        on = F.col("doc_id").eqNullSafe(F.col(id_)) & (mark() == F.col(mark_))
        return docs.join(some.select(id_, mark_).hint("shuffle_hash"), on, "left_semi")

    # repeated rows are rare: only they are gathered by their mark
    if not chosen.filter(F.col(n_) > 1).limit(1).count():
        return pick(chosen)
    once = pick(chosen.filter(F.col(n_) > 1)).withColumn(mark_, mark()).dropDuplicates(["doc_id", mark_]).drop(mark_)
    return pick(chosen.filter(F.col(n_) == 1)).unionByName(once)
