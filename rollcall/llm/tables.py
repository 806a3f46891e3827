"""Helpers that the operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.staging import stage

__all__ = ["fresh", "narrow", "quoted", "read", "slices", "small_batches", "stage"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Extra columns of the input go here, so that their names never clash with
    those an operator adds.
    """
    return df.select(*(_column(df, c).alias(name) for name, c in columns.items()))


def _column(df: DataFrame, c: str | Column) -> Column:
    return quoted(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let batches of rows for Python tasks hold about ``size`` bytes at most.

    By default a batch may hold 64 MB, in the JVM's buffers and again in the
    worker's; long texts in several tasks at once then take most of an executor.
    A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    held = int(now.rstrip("kmg")) * unit
    if held > size:
        spark.conf.set(key, str(size))


def slices(batch: pa.RecordBatch, text: str, chars: int = 1_000_000):
    """Cut a batch into runs of rows that hold about ``chars`` bytes of text, so
    that work memory stays bounded however long the texts are."""
    column = batch.column(text)
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def fresh(name: str) -> str:
    """A view or column name that no other run has."""
    return f"{name}_{uuid.uuid4().hex[:12]}"
