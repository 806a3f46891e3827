"""Exact Jaccard join of documents on word shingles (operator 5).

1. Documents with equal shingle sets form a class, named by a 64-bit digest.
2. PartEnum: two sets of one band of sizes that are similar enough differ in at
   most k shingles. The domain of shingles is cut into n1 parts of n2 parts each,
   n1 so large that one of the first has at most one difference, so two of its
   three second parts agree in full. Each set emits the digest of every such pair
   of parts, for its own band and the next one; similar sets share one. There are
   a few more first parts than that needs, so that a set with few empty pairs need
   not emit those, which very many sets would share. A set with more empty pairs
   cuts the domain anew: two similar sets do so until one of them has few.
3. Buckets of few sets give their pairs. Counts of shingles over 64 to 4,096 cells
   bound the differences of two sets from below; pairs within the limit are checked
   on the whole sets.
4. Larger buckets fall apart by the same bound first, as most of their members share a
   common phrase only. Parts whose members are not connected by then are compared in
   blocks inside tasks, which put out links that connect, not pairs.
5. Connected components over all links.

All shingles of all texts take part and nothing is capped: the two ways of step 3
and 4 are both exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rollcall.llm.components import components
from rollcall.llm.tables import fresh, narrow, quoted, slices, small_batches, stage
from rollcall.operators.lookup import Limits, is_small, lookup, salts

#: Sets of a bucket up to which all its pairs are checked one by one.
FEW = 6
#: Members of a bucket up to which one task compares all their counts.
MANY = 8_000
#: Shingles of a block, and signatures of one part of the exchange, about.
BLOCK, PART = 500_000, 1_000_000
#: Signatures that a task of the first side holds before it sends them, about.
HELD = 500_000
#: Times that a set with many empty pairs of parts cuts the domain.
CUTS = 16
#: Pairs of one left set that are checked in one place.
PAIRS = 10_000
_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the runs of ``words`` words, A-Z in lower case.

    bytes.split() cuts at space and \\t to \\r, bytes.lower() changes A-Z alone.
    A shorter text is one run; without words the result is empty.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out = np.full(max(1, len(h) - words + 1), min(len(h), words), np.uint64)
    for i in range(min(len(h), words)):
        out = mix(out * _THREE + h[i : i + len(out)] * _ONE)
    return np.unique(out)


def bands(percent: int, top: int) -> list[int]:
    """Largest sizes of the bands: sizes that may link are in one band or two neighbours."""
    ends, begin = [], 1
    while begin <= top:
        end = begin * 100 // percent
        ends.append(end)
        begin = end + 1
    return ends


def differences(percent: int, end: int) -> int:
    """Most differences of two similar sets of at most ``end`` elements each."""
    return 2 * end * (100 - percent) // (100 + percent)


def first_parts(percent: int, end: int) -> tuple[int, int]:
    """Number of first parts of a band, and how many of them are spare: none where
    sets are so large for their differences that hardly any pair is empty."""
    n1 = differences(percent, end) // 2 + 1
    least = end * percent * percent // 10_000
    spare = n1 // 8 if 3 * n1 * np.exp(-2 * least / (3 * n1)) > 0.05 else 0
    return n1 + spare, spare


def cuts(percent: int, end: int) -> int:
    """How often sets of a band may cut the domain to have few empty pairs: once
    where even the expected number for its smallest sets is too high."""
    n1, spare = first_parts(percent, end)
    least = end * percent * percent // 10_000
    return CUTS if 3 * n1 * np.exp(-2 * least / (3 * n1)) <= spare + 1 else 1


#: Size of sets up to which bands are worked out at first.
TOP = 1 << 20
_ENDS: dict[int, np.ndarray] = {}


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """Digests of which two sets share one if their similarity is ``percent`` or more."""
    if percent not in _ENDS or _ENDS[percent][-2] < len(grams):
        # At least one whole band lies above the set.
        ends = bands(percent, max(TOP, 2 * len(grams)))
        _ENDS[percent] = np.array(ends + bands(percent, ends[-1] + 1)[len(ends) :])
    ends = _ENDS[percent]
    own = int(np.searchsorted(ends, len(grams)))
    kept, out = mix(grams + _ONE), []
    for band in (own, own + 1):
        k = differences(percent, int(ends[band]))
        if k == 0:
            continue  # such sets are equal, thus in one class
        n1, spare = first_parts(percent, int(ends[band]))
        most = cuts(percent, int(ends[band]))
        for cut in range(most):
            spread = mix(grams ^ (_TWO + np.uint64(cut)))
            part = ((spread >> np.uint64(32)) * np.uint64(3 * n1)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept[order])])
            edges = np.searchsorted(part[order], np.arange(3 * n1 + 1, dtype=np.uint64))
            held = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, 3)
            pairs = held.sum(1, dtype=np.uint64)[:, None] - held
            size = np.diff(edges).reshape(n1, 3)
            filled = size.sum(1)[:, None] - size > 0
            places = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3) + np.uint64((cut << 56) + (band << 32))
            found = mix(pairs + mix(places))
            # At least spare + 1 first parts have a pair that agrees. If no more than
            # spare have an empty pair, one of the others tells. Otherwise the next cut
            # tells: of two similar sets both get there unless one of them had enough.
            enough = (~filled.all(1)).sum() <= spare
            out.append(found.ravel() if cut + 1 == most and not enough else found[filled])
            if enough:
                break
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def digest(grams: np.ndarray) -> int:
    """Name of a class of equal sets."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams) & 0xFFFFFFFF) - (1 << 63)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Shingles by cell, at most 255: two sets differ at least as much as their counts.

    A power of two of cells, so that one of 64 to 4,096 holds 8 shingles or fewer."""
    bits = min(12, max(6, (max(len(grams), 1) - 1).bit_length() - 3))
    cell = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """Rows of counts over fewer cells, as if counted over these."""
    if counts.shape[1] == cells:
        return counts
    return np.minimum(counts.reshape(len(counts), cells, -1).sum(2), 255).astype(np.uint8)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differences by row of counts over equal cells."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)


def matrix(sketches: list[bytes], cells: int) -> np.ndarray:
    """Counts of sets of any sizes over ``cells`` cells, which none has fewer of."""
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.empty((len(sketches), cells), np.uint8)
    for own in np.unique(length):
        at = np.flatnonzero(length == own)
        out[at] = folded(np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), own), cells)
    return out


def connected(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Number of each set's part: sets that sizes and sketches allow to link are in one.

    What is reached once is not compared again, so a part of near copies costs little.
    """
    counts = matrix(sketches, min(map(len, sketches)))
    part = np.full(len(n), -1)
    left = np.arange(len(n))
    for start in range(len(n)):
        if part[start] >= 0:
            continue
        part[start], open_ = start, [start]
        left = left[left != start]
        while open_ and len(left):
            i = open_.pop()
            m = n[left]
            fits = 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
            fits &= apart(counts[left], counts[i]) * (100 + percent) <= (100 - percent) * (m + n[i])
            if fits.any():
                found = left[fits]
                part[found] = start
                open_ += found.tolist()
                left = left[~fits]
    return part


def _profile(src: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, node, sketch``: size, class and counts of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, words) for t in b.column("text").to_pylist()]
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array([len(g) for g in sets], pa.int64()),
                     pa.array([digest(g) for g in sets], pa.int64()),
                     pa.array([sketch(g).tobytes() for g in sets], pa.binary())],
                    ["doc_id", "n", "node", "sketch"],
                )

    return src.mapInArrow(run, "doc_id long, n long, node long, sketch binary")


def _within(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and sketches allow to link: none that links is left out."""
    a = sizes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    b = sizes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(c).to_pylist() for c in "xy")
            cells = np.minimum([len(c) for c in x], [len(c) for c in y])
            differ = np.zeros(len(x), np.int64)
            for least in np.unique(cells):
                at = np.flatnonzero(cells == least)
                differ[at] = apart(*(matrix([c[i] for i in at], int(least)) for c in (x, y)))
            most = (100 - percent) * (t.column("n").to_numpy() + t.column("m").to_numpy())
            yield t.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= most))

    return pairs.join(a, "a").join(b, "b").filter(fits).select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _parts(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``sig, a`` of the members ``sig, a`` of buckets, which fall apart into parts by sizes and sketches.

    Sets of a bucket that link are in one part; sets that are alone in theirs go. A
    bucket of more than ``MANY`` sets is cut into blocks; every two blocks are one
    task's work, and what they connect is put together by components.
    """
    known = sizes.select(F.col("node").alias("a"), "n", "sketch")
    count = members.groupBy("sig").agg(F.ceil(F.count("*") / MANY).cast("long").alias("blocks"))
    big = stage(count.filter("blocks > 1"), "jaccard_big")  # at most members / MANY rows
    if big.isEmpty():
        dealt = members.join(known, "a").select("sig", "a", "n", "sketch", *(F.lit(0).cast("long").alias(c) for c in "ij"))
    else:
        cut = members.join(F.broadcast(big), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        cut = cut.join(known, "a").withColumn("block", F.pmod(F.xxhash64("a"), "blocks"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = cut.filter("blocks = 1 or block <> other").select(
            "sig", "a", "n", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        )
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            a = t.column("a").to_numpy()
            part = connected(t.column("n").to_numpy(), t.column("sketch").to_pylist(), percent)
            keep = np.bincount(part, minlength=len(a))[part] > 1
            if keep.any():
                yield pa.record_batch(
                    [t.column(c).combine_chunks().filter(pa.array(keep)) for c in ("sig", "i", "j", "a")]
                    + [pa.array(a[part[keep]])], ["sig", "i", "j", "a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")], 1)
            begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for lo, hi in zip(begins, [*begins[1:], len(keys)], strict=True):
                if held and key != tuple(keys[lo]):
                    yield from flush()
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    found = dealt.mapInArrow(run, "sig long, i long, j long, a long, b long")
    if big.isEmpty():
        return found.select(F.xxhash64("sig", "b").alias("sig"), "a")
    found = stage(found, "jaccard_blocks")
    whole = found.filter("i = j").select(F.xxhash64("sig", "b").alias("sig"), "a")
    cut = found.filter("i < j").select(F.xxhash64("sig", "a").alias("at"), F.xxhash64("sig", "b").alias("to"), "a")
    over = components(cut.select(F.col("at").alias("a"), F.col("to").alias("b")), "jaccard_over")
    over = over.select(F.col("node").alias("at"), F.col("component").alias("sig"))
    return whole.unionByName(cut.select("at", "a").distinct().join(over, "at").select("sig", "a"))


def _among(docs: DataFrame, name: Column, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id is, or isn't, among ``ids`` (one column): ids of a checked
    size are sent to the texts, more are joined without sorting the texts."""
    own = fresh("id")
    ids = ids.toDF(own)
    sent = F.broadcast(ids) if is_small(ids, Limits()) else ids.hint("shuffle_hash")
    return docs.join(sent, name == F.col(own), how)


def _encode(part: np.ndarray, node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Signatures by part: each part's nodes, how many signatures each has, and these.

    A node's signatures follow each other, so it is written once: 9 to 12 bytes a signature."""
    order = np.argsort(part, kind="stable")
    part, node, sig = part[order], node[order], sig[order]
    run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (node[1:] != node[:-1])]))
    counts = np.diff(np.append(run, len(sig))).astype("<u4")
    parts, at = np.unique(part, return_index=True)
    ends, runs = np.append(at, len(sig)), np.searchsorted(run, np.append(at, len(sig)))
    blobs = [
        np.array([hi - lo], "<u4").tobytes() + node[run[lo:hi]].tobytes() + counts[lo:hi].tobytes() + sig[s:e].tobytes()
        for lo, hi, s, e in zip(runs[:-1], runs[1:], ends[:-1], ends[1:], strict=True)
    ]
    return parts, blobs


def _decode(blob: bytes) -> np.ndarray:
    """Rows of signature and node."""
    k = int.from_bytes(blob[:4], "little")
    node = np.frombuffer(blob[4 : 4 + 8 * k], np.uint64)
    counts = np.frombuffer(blob[4 + 8 * k : 4 + 12 * k], "<u4")
    return np.stack([np.frombuffer(blob[4 + 12 * k :], np.uint64), np.repeat(node, counts)], 1)


def _sent(batches: Iterator[pa.RecordBatch], words: int, percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures of the texts by part, sent as soon as there are ``HELD`` of them."""
    held_s, held_n, held = [], [], 0
    seen: set[int] = set()  # copies within a task send nothing twice

    def flush() -> pa.RecordBatch:
        sig, node = np.concatenate(held_s), np.concatenate(held_n)
        held_s.clear()
        held_n.clear()
        to, blobs = _encode((sig % np.uint64(parts)).astype(np.int64), node.view(np.uint64), sig)
        return pa.record_batch([pa.array(to), pa.array(blobs, pa.binary())], ["part", "rows"])

    for whole in batches:
        for b in slices(whole, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                g = shingles(t, words)
                node = digest(g)
                if i is None or not len(g) or node in seen:
                    continue
                seen.add(node)
                s = signatures(g, percent)
                held_s.append(s)
                held_n.append(np.full(len(s), node, np.int64))
                held += len(s)
                if held > HELD:
                    yield flush()
                    held = 0
    if held:
        yield flush()


def _buckets(texts: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """``a, b`` of small buckets, and ``sig, a`` of the members of larger ones."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        done: dict[int, set] = {}
        for b in batches:
            for part, rows in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                x = _decode(rows)
                held.setdefault(part, []).append(x)
                size[part] = size.get(part, 0) + len(x)
                if size[part] > 4 * PART:
                    # More than a part should have: copies fall together, large buckets go out at once.
                    rest, out = _split(held[part], done.setdefault(part, set()))
                    held[part], size[part] = [rest], len(rest)
                    yield from out
        for part in list(held):
            yield from _split(held.pop(part), done.get(part, set()), last=True)[1]

    sent = texts.mapInArrow(lambda batches: _sent(batches, words, percent, parts), "part long, rows binary")
    return sent.repartition(parts, "part").mapInArrow(meet, "sig long, a long, b long")


def _split(blocks: list[np.ndarray], large: set, last: bool = False) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """Rows that stay and rows that go out; ``large`` remembers buckets already sent."""
    x = np.concatenate(blocks)
    blocks.clear()
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    if len(x) > 1:
        x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(1)])]
    begins = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]])) if len(x) else np.empty(0, np.int64)
    counts = np.diff(np.append(begins, len(x)))
    known = np.isin(x[begins, 0], np.fromiter(large, np.uint64, len(large))) if large else np.zeros(len(begins), bool)
    many = (counts > FEW) | known
    out = []

    def batch(sig: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> None:
        none = pa.nulls(len(a), pa.int64())
        out.append(pa.record_batch(
            [pa.array(sig.view(np.int64)) if b is None else none, pa.array(a.view(np.int64)),
             none if b is None else pa.array(b.view(np.int64))], ["sig", "a", "b"]))

    each = np.repeat(many, counts)
    if each.any():
        batch(np.ascontiguousarray(x[each, 0]), np.ascontiguousarray(x[each, 1]), None)
        large.update(x[begins[many], 0].tolist())
    if last:
        found = []
        for k in range(2, FEW + 1):
            at = begins[(counts == k) & ~many]
            found += [np.stack([x[at + i, 1], x[at + j, 1]], 1) for i in range(k) for j in range(i + 1, k)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)
        if len(pairs):
            batch(pairs[:, 0], np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        return x[:0], out
    return x[~each], out


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, words) for t in b.column("text").to_pylist()]
                yield pa.record_batch(
                    [pa.array([digest(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())],
                    ["node", "grams"],
                )

    return texts.mapInArrow(run, "node long, grams binary")


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that link.

    Pairs are dealt by their left set and sorted behind it, so a task holds one left
    set and streams the right ones past it; a left set of very many pairs is copied
    to as many places as these ask for.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("long").alias("places"))
    left = counts.join(sets, counts["a"] == sets["node"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"),
        F.lit(None).cast("long").alias("b"), "grams",
    )
    many = counts.filter("places > 1")  # at most pairs / PAIRS rows
    dealt = pairs.join(many, "a", "left") if not many.isEmpty() else pairs.withColumn("places", F.lit(1))
    right = dealt.join(sets, pairs["b"] == sets["node"]).select(
        "a", F.pmod(F.xxhash64("b"), F.coalesce("places", F.lit(1)).cast("long")).alias("place"), "b", "grams"
    )
    # The left set comes first: nulls sort before all others.
    rows = left.unionByName(right).repartition("a", "place").sortWithinPartitions("a", "place", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            a, b, grams = (batch.column(c) for c in ("a", "b", "grams"))
            for i, j, g in zip(a.to_pylist(), b.to_pylist(), grams, strict=True):
                y = np.frombuffer(g.as_buffer(), np.uint64)
                if j is None:
                    x = y.copy()
                elif linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    out_a.append(i)
                    out_b.append(j)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.select("a", "b", "grams").mapInArrow(run, "a long, b long")


class Forest:
    """Union of sets of row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _compare(percent: int):
    """Links that connect the sets of two blocks (or of one), by an index of shingles."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        n = np.array([len(s) for s in sets])
        node, block, label = (rows[c].to_numpy() for c in ("node", "block", "label"))
        owner = np.repeat(np.arange(len(sets)), n)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        posting, begins = owner[order], np.searchsorted(inverse[order], np.arange(len(values) + 1))
        starts = np.concatenate([[0], np.cumsum(n)])
        forest = Forest(len(sets))
        first: dict[int, int] = {}
        for i, l in enumerate(label.tolist()):  # what is connected already stays so
            forest.join(first.setdefault(l, i), i)
        out = []
        for i in range(len(sets)):
            ids = inverse[starts[i] : starts[i + 1]]
            size = begins[ids + 1] - begins[ids]
            spot = np.repeat(begins[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            common = np.bincount(posting[spot], minlength=len(sets))
            ok = linked(common, n[i], n, percent)
            ok[: i + 1] = False
            if key[1] != key[2]:
                ok &= block != block[i]
            out += [(node[i], node[j]) for j in np.flatnonzero(ok) if forest.join(i, j)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _large(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between sets of large buckets whose members are not connected yet."""
    label = components(links, "jaccard_near").select(F.col("node").alias("a"), "component")
    known = members.join(label, "a", "left").select("sig", "a", F.coalesce("component", "a").alias("label"))
    known = stage(known, "jaccard_known")
    open_ = known.groupBy("sig").agg(F.min("a").alias("b"), F.min("label").alias("x"), F.max("label").alias("y"))
    open_ = open_.filter("x <> y").select("sig", "b")
    edges = stage(known.join(open_, "sig").select("a", "b", "label"), "jaccard_open")
    groups = components(edges.select("a", "b"), "jaccard_groups")
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
    held = nodes.join(groups, "node").join(sets, "node").select(
        "node", "label", F.col("component").alias("g"), "grams", (F.length("grams") / 8).alias("n")
    )
    held = stage(held, "jaccard_held")
    # A group of any size is cut into blocks by its shingles; every two blocks are one task's work.
    blocks = held.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
    dealt = held.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("node", "label", "g", "grams", "block", other)
    dealt = dealt.select("node", "label", "g", "grams", "block", F.least("block", "other").alias("i"),
                         F.greatest("block", "other").alias("j"))
    # Else the join by group is taken as deal enough, and one task gets all blocks of a group.
    dealt = dealt.repartition("g", "i", "j")
    return dealt.groupBy("g", "i", "j").applyInPandas(_compare(percent), "a long, b long")


def _linked_sets(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, n, node`` of every row, ``node, class_id`` of every set, and links ``a, b`` of sets."""
    small_batches(docs.sparkSession)
    src = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(_profile(src, words), "jaccard_sets")
    some = rows.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    # Signatures of a set of n: three for each two differences, for two bands.
    total = (some.agg(F.sum("n")).first()[0] or 0) * 6.75 * (100 - percent) / (100 + percent)
    parts = max(24, int(total / PART))
    met = stage(_buckets(src, words, percent, parts), "jaccard_buckets")
    sizes = stage(some.select("node", "n", "sketch").dropDuplicates(["node"]), "jaccard_sizes")
    pairs = met.filter("b is not null").select("a", "b").distinct()
    pairs = stage(_within(pairs, sizes, percent), "jaccard_pairs")
    members = stage(met.filter("b is null").select("sig", "a").distinct(), "jaccard_members")
    members = stage(_parts(members, sizes, percent), "jaccard_parts")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(
        members.select(F.col("a").alias("node"))
    ).distinct()
    ids = stage(classes.join(wanted, "node", "left_semi").select("class_id").distinct(), "jaccard_wanted")
    found = _sets(_among(src, F.col("doc_id"), ids, "left_semi"), words).dropDuplicates(["node"])
    sets = stage(found, "jaccard_grams")
    near = stage(_check(pairs, sets, percent), "jaccard_links")
    far = stage(_large(members, sets, near, percent), "jaccard_far")
    return rows, classes, near.unionByName(far)


def join_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents with their class, and the links between classes.

    Rows: ``doc_id, n_shingles, class_id`` (smallest id with the same set), one per
    input row. Links: ``a, b`` between class ids; every two sets of similarity
    ``percent`` or more are linked or connected by links of such sets.

    Texts without words, null or empty, have no shingle and a class of their own;
    rows with a null id keep a null class and link nothing; rows that repeat an id
    with another text are documents of their own in links. Ids are whole numbers;
    extra columns are dropped; empty tables give empty results.
    """
    rows, classes, links = _linked_sets(docs, words, percent, id_col, text_col)
    classes = classes.drop("copies")
    for c in ("a", "b"):
        links = links.join(classes.withColumnRenamed("node", c), c).drop(c).withColumnRenamed("class_id", c)
    whole = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), whole).alias("class_id")
    out = rows.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own)
    return out, stage(links, "jaccard_class_links")


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, first_id, first_node, copies`` of every set: the smallest id of its group and the set that has it.

    Groups connect sets, not ids: an id that two unlike texts share connects nothing.
    """
    found = components(links, "jaccard_components").select("node", "component")
    named = classes.join(found, "node", "left").select(
        "node", "class_id", "copies", F.coalesce("component", "node").alias("group")
    )
    first = named.groupBy("group").agg(F.min(F.struct("class_id", "node")).alias("first"))
    return stage(
        named.join(first, "group").select(
            "node", F.col("first.class_id").alias("first_id"), F.col("first.node").alias("first_node"), "copies"
        ),
        "jaccard_groups",
    )


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with what is known of their set's group. A set of very many copies is dealt
    over several places; texts without words match nothing and are spread."""
    keyed = rows.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    small = is_small(groups, Limits())
    return lookup(
        keyed, groups.drop("copies"), "node", spread=F.col("doc_id"), small=small,
        hot=None if small else salts(groups, "node", "copies"),
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable by links, itself included.

    Cases as in ``join_documents``; rows with a null id have a null component.
    """
    rows, classes, links = _linked_sets(docs, words, percent, id_col, text_col)
    out = _with_group(rows, _grouped(classes, links))
    reached = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), reached).alias("component_id"))


def _with_node(docs: DataFrame, text_col: str, words: int, node: str) -> DataFrame:
    """The rows with the class of their text's set; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                sets = [shingles(t, words) for t in b.column(text_col).to_pylist()]
                yield b.append_column(node, pa.array([digest(g) if len(g) else None for g in sets], pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(node, LongType())]))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given rows and columns, one document of each group of near duplicates: that of the smallest id.

    Documents without words and rows with a null id all stay. Rows that repeat an id
    are told apart by their texts: one row of each group stays, the others go only if
    their own text is in a group that keeps another. Of rows with one id and equal
    sets that of the smallest digest of its text stays; of equal texts any. Columns
    of any name pass through.
    """
    rows, classes, links = _linked_sets(docs, words, percent, id_col, text_col)
    first = _grouped(classes, links)
    best = (F.col("doc_id") == F.col("first_id")) & (F.col("node") == F.col("first_node"))
    judged = _with_group(rows.filter("doc_id is not null"), first).select(
        "doc_id", "node", "n", (best | (F.col("n") == 0)).alias("kept")
    )
    judged = stage(judged, "jaccard_judged")
    ids = stage(judged.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows")), "jaccard_ids")
    name = quoted(id_col).cast("long")
    once = _among(docs, name, ids.filter("kept = 0 or rows > 1").select("doc_id"), "left_anti")
    again = ids.filter("kept > 0 and rows > 1").select("doc_id")
    if again.isEmpty():
        return once
    node, own, at = fresh("node"), fresh("id"), fresh("at")
    held = _with_node(_among(docs, name, again, "left_semi"), text_col, words, node)
    good = judged.filter("kept and n > 0").select(F.col("doc_id").alias(own), F.col("node").alias(at)).distinct()
    texts = held.join(good, (name == F.col(own)) & (F.col(node) == F.col(at)), "left_semi")
    whole = F.struct(*(quoted(c).alias(c) for c in docs.columns))
    one = texts.groupBy(name.alias(own), node).agg(F.min_by(whole, F.sha2(quoted(text_col), 256)).alias(at))
    one = one.select(*(F.col(at).getField(c).alias(c) for c in docs.columns))
    return once.unionByName(one).unionByName(held.filter(F.col(node).isNull()).drop(node))
