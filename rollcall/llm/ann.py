"""Approximate nearest neighbours by multi-probe p-stable hashing (operator 4).

Every vector stands in one bucket of each table: ``floor((a x + b) / w)`` for a few
random normal directions. A query visits its own bucket and perturbed ones in the
order of their estimated success, the sum of squared distances from its
projections to the borders crossed. Inside a bucket the exact distances are
computed and only the nearest few go on; the tables' candidates are merged and
ranked by exact distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.tables import stage
from rollcall.llm.vectors import matrix, whole_vectors

#: Vectors of one bucket that one task compares, about.
ROWS = 20_000
_KEY = ["dim", "tab", "bucket", "salt"]


class Tables:
    """Hash functions of all tables for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.a = rng.normal(size=(tables, hashes, dim))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.width, self.probes = width, probes
        self.moves = np.array(list(itertools.product((0, -1, 1, -2, 2), repeat=hashes)))

    def place(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.width

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.int64)
        for i in range(cells.shape[-1]):
            out = out * 1_000_003 + cells[..., i]
        return out

    def visited(self, x: np.ndarray, t: int) -> np.ndarray:
        """Buckets of each query, the likeliest first."""
        at = self.place(x, t)
        cells = np.floor(at).astype(np.int64)
        into = at - cells
        far = np.zeros((len(x), len(self.moves)))
        for i in range(cells.shape[1]):
            step = self.moves[:, i]
            to_border = np.where(step < 0, into[:, i : i + 1] - step - 1, step - into[:, i : i + 1])
            far += np.where(step == 0, 0.0, to_border) ** 2
        order = np.argsort(far, axis=1, kind="stable")[:, : self.probes]
        return self.code(cells[:, None, :] + self.moves[order])


def _dealt(rows: DataFrame, make, tables: int, probing: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, same in b.groupby(b["vec"].map(len)):
                x, h = matrix(same["vec"]), make(int(dim))
                for t in range(tables):
                    codes = h.visited(x, t) if probing else h.code(np.floor(h.place(x, t)).astype(np.int64))[:, None]
                    at = np.repeat(np.arange(len(same)), codes.shape[1])
                    yield pd.DataFrame({"dim": dim, "tab": t, "bucket": codes.ravel(),
                                        "vec_id": same["vec_id"].to_numpy()[at], "vec": same["vec"].to_numpy()[at]})

    return rows.mapInPandas(run, "dim int, tab int, bucket long, vec_id long, vec array<double>")


def _nearest(k: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(asked):
            x, ids = matrix(rows["vec"]), rows["vec_id"].to_numpy()
            norms = (x * x).sum(1)
            for s in range(0, len(asked), 256):
                q, names = matrix(asked["vec"].iloc[s : s + 256]), asked["vec_id"].to_numpy()[s : s + 256]
                size = (q * q).sum(1)
                rough = norms + size[:, None] - 2 * q @ x.T
                rough[names[:, None] == ids] = np.inf
                near = min(k, len(ids)) - 1
                limit = np.partition(rough, near, axis=1)[:, near] + 1e-9 * (size + norms.max())
                for i, name in enumerate(names.tolist()):
                    at = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
                    exact = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[at], exact))[:k]
                    found += [(name, v, d) for v, d in zip(ids[at[best]].tolist(), exact[best].tolist(), strict=True)]
        out = pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        return out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _doubled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", F.col("vec").cast("array<double>"))


_FOUND = "query_id long, vec_id long, score double"


def _meet(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return rows.groupBy(*_KEY).cogroup(asked.groupBy(*_KEY)).applyInPandas(_nearest(k), _FOUND)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = 4, hashes: int = 4, width: float = 1.5, probes: int = 28, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows found.

    Score is the Euclidean distance in double precision; nearest first, ties to the
    smaller id; a row with the query's id is not a candidate of its own. ``width``
    counts in root mean square norms. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do null ids; vectors of different
    lengths don't meet; rows that repeat an id count once. A query whose probes
    meet fewer than ``k`` rows is compared with all rows instead, in blocks.
    """
    base = stage(_doubled(whole_vectors(rows, id_col, vec_col)).filter("vec_id is not null"), "ann_rows")
    asked = stage(_doubled(whole_vectors(queries, id_col, vec_col)).filter("vec_id is not null").distinct(), "ann_queries")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    norm, total = base.agg(F.sqrt(F.avg(square)), F.count("*")).first()
    w = width * (norm or 1.0)

    def make(dim: int) -> Tables:
        return Tables(dim, tables, hashes, w, probes, seed)

    dealt = stage(_dealt(base, make, tables, probing=False), "ann_dealt")
    # Buckets beyond what a task should compare are cut; queries go to every cut.
    hot = dealt.groupBy("dim", "tab", "bucket").count().filter(F.col("count") > ROWS)
    hot = hot.select("dim", "tab", "bucket", F.ceil(F.col("count") / ROWS).cast("int").alias("cuts"))
    cut = lambda df: df.join(hot, ["dim", "tab", "bucket"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    left = cut(dealt).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
    right = cut(_dealt(asked, make, tables, probing=True)).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    )
    found = _meet(left.select(*_KEY, "vec_id", "vec"), right.select(*_KEY, "vec_id", "vec"), k)
    found = stage(found.distinct(), "ann_found")
    # Queries that met too few rows: all rows, dealt into blocks.
    met = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    poor = asked.join(met, asked["vec_id"] == met["query_id"], "left").filter(F.coalesce("n", F.lit(0)) < k)
    poor = stage(poor.select("vec_id", "vec"), "ann_poor")
    if not poor.isEmpty():
        cuts = -(-total // ROWS)
        whole = lambda df, salt: df.select(F.size("vec").alias("dim"), F.lit(0).alias("tab"),
                                           F.lit(0).cast("long").alias("bucket"), salt.alias("salt"), "vec_id", "vec")
        rest = _meet(whole(base, F.pmod(F.xxhash64("vec_id"), F.lit(cuts)).cast("int")),
                     whole(poor, F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))), k)
        found = found.unionByName(rest)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
