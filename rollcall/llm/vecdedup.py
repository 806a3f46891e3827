"""Near-duplicate vectors by a subspace pigeonhole join (operator 7).

Unit vectors of cosine c have squared distance 2 - 2c. They are rotated and split
into blocks of dimensions; a pair within that distance is within the block's
proportional share of it in at least one block. So each block is joined by range
on its own: slabs of the block's radius along its first dimension, each slab with
itself and the next one, in a task swept along the second dimension. Pairs within
a block's share are checked on the whole vectors. A pair counts in the first block
that has it, so every pair counts once. Tasks put out link counts by vector and
links that connect, never pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.components import components
from rollcall.llm.tables import narrow, stage
from rollcall.llm.vectors import takes_part, whole_vectors

BLOCKS = 4
#: Vectors of a slab that are one side of a task, about.
ROWS = 12_288
_SLACK = 1e-9


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Space:
    """Rotation, blocks and shares for vectors of one dimension."""

    def __init__(self, dim: int, cosine: float, seed: int) -> None:
        self.turn = _rotation(dim, seed)
        self.cuts = [np.asarray(c) for c in np.array_split(np.arange(dim), min(BLOCKS, dim))]
        whole = 2 - 2 * cosine
        self.share = np.array([whole * len(c) / dim for c in self.cuts]) * (1 + _SLACK) + _SLACK
        self.radius = np.sqrt(self.share)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.sqrt((x * x).sum(1))[:, None]) @ self.turn

    def slab(self, y: np.ndarray, j: int) -> np.ndarray:
        return np.floor(y[:, self.cuts[j][0]] / self.radius[j]).astype(np.int64)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of each dimension with their vectors in double precision."""
    dims = b.column("vec").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        same = b.take(pa.array(np.flatnonzero(dims == dim)))
        yield same, doubles(same.column("vec"), int(dim))


def doubles(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _histogram(reps: DataFrame, cosine: float, seed: int) -> dict[tuple[int, int, int], int]:
    """Vectors by dimension, block and slab. Unit vectors have a few dozen slabs a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for _, x in _by_dim(b):
                dim = x.shape[1]
                space = Space(dim, cosine, seed)
                y = space.rotated(x)
                for j in range(len(space.cuts)):
                    for s, k in zip(*np.unique(space.slab(y, j), return_counts=True), strict=True):
                        n[dim, j, int(s)] += int(k)
        rows = [(*k, v) for k, v in n.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["dim", "j", "s", "n"])

    rows = reps.select("vec").mapInArrow(run, "dim long, j long, s long, n long").groupBy("dim", "j", "s").agg(F.sum("n"))
    return {(r[0], r[1], r[2]): r[3] for r in rows.collect()}


#: Sides of a task: rows of the first are compared with the second, those of ALONE with each other.
FIRST, SECOND, ALONE = 0, 1, 2


def _deal(reps: DataFrame, sizes: dict, cosine: float, seed: int) -> DataFrame:
    """Rows by task. A slab over ``ROWS`` is cut; each two cuts that may hold a pair are one task."""
    chunks = {k: -(-n // ROWS) for k, n in sizes.items()}
    task: dict[tuple, int] = {}
    for dim, j, s in sorted(chunks):
        here, there = chunks[dim, j, s], chunks.get((dim, j, s + 1), 0)
        for i in range(here):
            for other in [(0, k) for k in range(i, here)] + [(1, k) for k in range(there)]:
                task[dim, j, s, i, *other] = len(task)

    def places(dim: int, j: int, s: int, c: int) -> Iterator[tuple[int, int]]:
        """Task and side of every task that a cut takes part in."""
        here, above, below = (chunks.get((dim, j, s + d), 0) for d in (0, 1, -1))
        for k in range(here):
            lo, hi = min(c, k), max(c, k)
            yield task[dim, j, s, lo, 0, hi], ALONE if lo == hi else SECOND if c == hi else FIRST
        for k in range(above):
            yield task[dim, j, s, c, 1, k], FIRST
        for i in range(below):
            yield task[dim, j, s - 1, i, 1, c], SECOND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, x in _by_dim(b):
                dim = x.shape[1]
                space = Space(dim, cosine, seed)
                y = space.rotated(x)
                spread = same.column("rep").to_numpy() * 2654435761 >> 7
                for j in range(len(space.cuts)):
                    slab = space.slab(y, j)
                    for s in np.unique(slab).tolist():
                        inside = np.flatnonzero(slab == s)
                        cut = spread[inside] % chunks[dim, j, s]
                        for c in range(chunks[dim, j, s]):
                            part = same.take(pa.array(inside[cut == c]))
                            if not len(part):
                                continue
                            for t, side in places(dim, j, s, c):
                                fixed = [pa.array(np.full(len(part), v), k) for v, k in
                                         ((t, pa.int64()), (side, pa.int32()), (j, pa.int32()))]
                                yield pa.record_batch([*fixed, *(part.column(k) for k in ("rep", "copies", "vec"))],
                                                      ["task", "side", "j", "rep", "copies", "vec"])

    kind = dict(reps.dtypes)["vec"]
    rows = reps.select("rep", "copies", "vec")
    return rows.mapInArrow(run, f"task long, side int, j int, rep long, copies long, vec {kind}")


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float, seed: int):
    names = ["node", "links", "top"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("rep", "ascending")]).combine_chunks()
        vec = rows.column("vec").combine_chunks()
        x, j = doubles(vec, len(vec[0])), rows.column("j")[0].as_py()
        space = Space(x.shape[1], cosine, seed)
        norm = np.sqrt((x * x).sum(1))
        y = space.rotated(x)
        mine = y[:, space.cuts[j]]
        sweep = mine[:, min(1, mine.shape[1] - 1)]
        side = rows.column("side").to_numpy()
        alone = side[0] == ALONE
        order = np.argsort(sweep, kind="stable")
        left, right = (order, order) if alone else (order[side[order] == FIRST], order[side[order] == SECOND])
        keys, size = sweep[right], (mine * mine).sum(1)[:, None]
        limit, radius = space.share[j] + 1e-5, space.radius[j] + 1e-6
        # One product gives squared distances: |a|^2 + |b|^2 - 2 a b, in single precision for a first look.
        a_form = np.hstack([-2 * mine, size, np.ones_like(size)]).astype(np.float32)
        b_form = np.hstack([mine, np.ones_like(size), size]).astype(np.float32)[right].T.copy()
        copies, found = rows.column("copies").to_numpy(), []
        links = np.zeros(len(x), np.int64)
        for s in range(0, len(left), 256):
            p = left[s : s + 256]
            lo, hi = np.searchsorted(keys, sweep[p[0]] - radius), np.searchsorted(keys, sweep[p[-1]] + radius, "right")
            lo = max(lo, s) if alone else lo
            if lo >= hi:
                continue
            u, v = np.divmod(np.flatnonzero(a_form[p] @ b_form[:, lo:hi] <= limit), hi - lo)
            if alone:
                later = (v + lo) > (u + s)
                u, v = u[later], v[later]
            for i in range(0, len(u), 50_000):
                a, b = p[u[i : i + 50_000]], right[lo + v[i : i + 50_000]]
                near = (x[a] * x[b]).sum(1) / (norm[a] * norm[b]) >= cosine
                a, b = a[near], b[near]
                square = (y[a] - y[b]) ** 2
                share = np.stack([square[:, c].sum(1) for c in space.cuts[: j + 1]], 1) <= space.share[: j + 1]
                first = share[:, j] & ~share[:, :j].any(1)
                found.append((a[first], b[first]))
        if not found:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        a, b = (np.concatenate(f) for f in zip(*found, strict=True))
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        rep = rows.column("rep").to_numpy()
        top = connect(len(x), a, b)
        some = np.flatnonzero(links)
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[top[some]])], names)

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                 seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    ``n_links`` counts the other vectors of at least that cosine (0 < cosine < 1),
    ``component_id`` is the smallest id reachable by links, itself included, and
    ``kept`` marks that one. Vectors that are null, zero or hold null or non-finite
    components link with nothing, nor do rows with a null id (their component is
    null and they are kept); vectors of different lengths don't link. Rows with
    equal vectors are compared once and count as often as they occur. Ids are whole
    numbers that name one vector; extra columns are dropped.
    """
    src = narrow(rows, vec_id=id_col, vec=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    whole = whole_vectors(src, "vec_id", "vec").filter("vec_id is not null")
    reps = whole.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = stage(reps, "vec_reps")
    sizes = _histogram(reps, cosine, seed)
    met = _deal(reps, sizes, cosine, seed).groupBy("task").applyInArrow(
        _compare(cosine, seed), "node long, links long, top long"
    )
    met = stage(met, "vec_links")
    found = components(met.select(F.col("node").alias("a"), F.col("top").alias("b")), "vec_components")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.join(links, reps["rep"] == links["node"], "left").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    members = whole.join(reps.select("vec", "rep"), "vec").select("vec_id", "rep").join(classes, "rep").select(
        "vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id")
    )
    rest = src.filter(~takes_part(F.col("vec")) | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = members.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
