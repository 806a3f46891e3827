"""Listing of input files in run order."""

from __future__ import annotations

import posixpath
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import DELIMITED_EXTENSIONS, WORKBOOK_EXTENSIONS

SCHEMA = "file_ord int, path string, file string, length bigint, plain string, ext string"
# Files of one folder from which on one listing is cheaper than a question per file.
LISTED_AT = 16
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"


def plain_path(c: Column | str) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(c, _SCHEME, "")


def literal(path: str) -> str:
    """A path whose brackets, braces, stars and question marks stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _status(spark: SparkSession, path: str):
    """What the path's file system knows of it; None if there is no such file."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        return store, store.getFileStatus(at)
    except Py4JJavaError as err:
        if "FileNotFoundException" in str(err.java_exception.getClass().getName()):
            return store, None
        raise


def children(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Path and length of the files directly in a folder, whatever their names."""
    store, status = _status(spark, folder)
    if status is None or not status.isDirectory():
        raise ValueError(f"'{folder}' is not a directory")
    return [(f.getPath().toString(), f.getLen()) for f in store.listStatus(status.getPath()) if f.isFile()]


def lengths(spark: SparkSession, paths: list[str]) -> list[tuple[str, int | None]]:
    """Paths with their lengths, null where there is no such file.

    A folder named by many paths is listed once instead of asked for each file.
    """
    by_folder: dict[str, set[str]] = {}
    for path in paths:
        by_folder.setdefault(posixpath.dirname(path), set()).add(path)
    known: dict[str, int | None] = {}
    for folder, inside in by_folder.items():
        if len(inside) >= LISTED_AT:
            _, status = _status(spark, folder)
            there = children(spark, folder) if status is not None and status.isDirectory() else []
            found = {posixpath.basename(p): n for p, n in there}
            known |= {p: found.get(posixpath.basename(p)) for p in inside}
            continue
        for path in inside:
            _, status = _status(spark, path)
            known[path] = status.getLen() if status is not None and status.isFile() else None
    return [(p, known[p]) for p in paths]


def extension(name: str) -> str:
    found = re.search(r"\.[^./]*$", name)
    return found[0].lower() if found else ""


def list_inputs(
    spark: SparkSession,
    base: str,
    files: list[str] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Inputs: the given files in order, then a folder's files by path.

    Columns file_ord, path, file, length, plain, ext. Relative paths count from
    ``base``; a path named twice keeps its first place; a given file that does
    not exist has a null length. Only known extensions are taken of a folder.
    The driver lists through the path's file system, which Spark needs anyway.
    """

    def absolute(p: str) -> str:
        return p if "://" in p or p.startswith("file:") else posixpath.normpath(posixpath.join(base, p))

    listed: list[tuple[str, int | None]] = lengths(spark, [absolute(f) for f in files or []])
    if folder is not None:
        known = DELIMITED_EXTENSIONS + WORKBOOK_EXTENSIONS
        inside = [c for c in children(spark, absolute(folder).rstrip("/")) if extension(c[0]) in known]
        listed += sorted(inside, key=lambda c: re.sub(_SCHEME, "", c[0]).encode())
    first: dict[str, tuple[str, int | None]] = {}
    for path, length in listed:
        first.setdefault(re.sub(_SCHEME, "", path), (path, length))
    rows = [
        (n, path, plain.rsplit("/", 1)[-1], length, plain, extension(plain))
        for n, (plain, (path, length)) in enumerate(first.items())
    ]
    return spark.createDataFrame(rows, SCHEMA)
