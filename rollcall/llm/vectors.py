"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow


def takes_part(vec: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vec.isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec``: the vectors that take part; -0 is 0. Single precision stays, all else is double."""
    src = narrow(rows, vec_id=id_col, vec=vec_col)
    kind = "float" if dict(src.dtypes)["vec"] == "array<float>" else "double"
    src = src.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast(f"array<{kind}>").alias("vec"))
    return src.filter(takes_part(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast(kind)))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))
