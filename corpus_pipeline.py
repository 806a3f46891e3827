"""A corpus from raw documents: good ones, one of each near-duplicate group, pseudonyms, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import jaccard, packing, pii, quality
from rollcall.llm.tables import fresh, quoted, read, small_batches, stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; empty texts are judged like all others."""
    small_batches(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its runs of five words.

    Texts without words and null ids stay; repeated ids are told apart by their texts.
    """
    return jaccard.keep_one(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; ``n_chars`` follows a changed text.

    Null texts stay null; all other columns pass through under their own names.
    """
    new = fresh("new")
    masked = docs.withColumn(new, pii.pseudonymise(F.col("text"), "corpus"))
    columns = {c: quoted(c) for c in docs.columns} | {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        columns["n_chars"] = F.when(changed, F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return masked.select(*(c.alias(name) for name, c in columns.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents with their places in sequences of 4096; null texts have the end id alone."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("PII", pseudonymise),
    ("packing", pack),
]

#: A trained model, tokens and keyed digests have no counterpart in SQL; tests
#: compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"corpus_{i}")
    return docs
