"""Packing of documents into sequences of fixed length (operator 3).

Documents become pieces: runs of ``size`` ids and a rest. Shortest-pack-first
works on the histogram of piece lengths alone: the lengths are placed longest
first, all pieces of a length at once, always into the packs that hold least so
far; a group of equal packs is one pattern with a count, split when only some of
it is used. Then every piece finds its place by its rank among the pieces of its
length. Each length opens and splits at most one group, so there are at most two
patterns per length, whatever the number of documents.
"""

from __future__ import annotations

import gc
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.bpe import CHARS, KEPT, SPACE, Merges
from rollcall.llm.tables import narrow, slices, stage

SIZE = 4096
#: The id that ends each document.
END = 2
#: Pieces of one length that are ranked in one group, at least.
GROUP = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCodec:
    """Ids of a vocabulary with word ends: lower case, white space dropped.

    Words of plain Latin letters are merged here, each once per worker; units
    with other characters go to the tokenizers library itself.
    """

    #: The split into words, a fixed value of the vocabulary.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], "</w>")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(self.WORDS)
        self.space = regex.compile(f"[{SPACE}]+")
        # Not the capital I with a dot, whose small form is two characters.
        self.plain = regex.compile("[\x21-\x7e\xa1-" + chr(0x12F) + chr(0x131) + "-" + chr(0x17F) + "]+")
        self.controls = regex.compile(r"[\x1c-\x1f]")
        self._clear()

    def _clear(self) -> None:
        self.unit: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # No cycles arise here; looking for them among millions of strings costs time.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.unit) + len(self.word) > KEPT:
            self._clear()
        jobs: list[list] = []
        new: set[str] = set()
        for text in texts:
            parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
            job: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    job.append(self.special[part].to_bytes(4, "little"))
                else:
                    units = [u for u in self.space.split(part) if u] if self.controls.search(part) else part.split()
                    new |= set(units).difference(self.unit)
                    job.append(units)
            jobs.append(job)
        self._learn(new)
        out = []
        for job in jobs:
            found: list[bytes] = []
            for part in job:
                if isinstance(part, bytes):
                    found.append(part)
                else:
                    found.extend(map(self.unit.__getitem__, part))
            out.append(b"".join(found))
        return out

    def _learn(self, units: set[str]) -> None:
        known, whole, marked, cut = self.word, [], [], {}
        for u in units:
            # Letters, perhaps before one mark, need no pattern.
            letters = u.isascii() or self.plain.fullmatch(u)
            if letters and u.isalpha():
                whole.append(u)
            elif letters and u[-1] in ",." and u[:-1].isalpha():
                marked.append(u)
            elif not self.plain.fullmatch(u):
                ids = self.library.encode(u, add_special_tokens=False).ids
                self.unit[u] = np.array(ids, "<u4").tobytes()
            else:
                cut[u] = self.words.findall(u.lower())
        lower = [u.lower() for u in whole]
        heads = [u[:-1].lower() for u in marked]
        new = {*lower, *heads, *(u[-1] for u in marked)}
        new.update(*cut.values())
        raw = {w.encode(): w for w in new.difference(known)}
        for w, ids in self.merges.encode(raw).items():
            known[raw[w]] = ids
        self.unit.update(zip(whole, map(known.__getitem__, lower), strict=True))
        self.unit.update((u, known[w] + known[u[-1]]) for u, w in zip(marked, heads, strict=True))
        self.unit.update((u, b"".join([known[w] for w in ws])) for u, ws in cut.items())


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           size: int = SIZE, end: int = END, digest: bool = False) -> DataFrame:
    """``doc_id, start, length, doc_tokens`` and the ids of each piece.

    A document is its ids and ``end``, cut into runs of ``size`` and a rest; null
    and empty texts are one piece of the end alone. Column ``ids array<int>``
    holds the ids; with ``digest`` their checksum ``ids_crc32`` comes instead.
    """
    path = vocabulary or default_vocabulary()
    src = narrow(docs, doc_id=id_col, text=text_col)
    kind = dict(src.dtypes)["doc_id"]
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                row, start, length, total, load = [], [], [], [], []
                for i, x in enumerate(codec(path).encode([t or "" for t in b.column("text").to_pylist()])):
                    x += tail
                    n = len(x) // 4
                    for at in range(0, n, size):
                        part = x[4 * at : 4 * (at + size)]
                        row.append(i)
                        start.append(at)
                        length.append(len(part) // 4)
                        total.append(n)
                        load.append(zlib.crc32(part) if digest else np.frombuffer(part, "<u4").astype(np.int32))
                yield pa.record_batch(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(total, pa.int64()),
                     pa.array(load, pa.int64() if digest else pa.list_(pa.int32()))],
                    ["doc_id", "start", "length", "doc_tokens", "load"],
                )

    name = "ids_crc32" if digest else "ids"
    out = src.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, "
                              f"load {'long' if digest else 'array<int>'}")
    return out.withColumnRenamed("load", name)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(packs, [(length, times), ...])`` that hold the whole histogram."""
    heap: list[tuple[int, int, int, tuple]] = []
    made = 0

    def put(used: int, packs: int, pattern: tuple) -> None:
        nonlocal made
        made += 1
        heapq.heappush(heap, (used, made, packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= size:
            used, _, packs, pattern = heapq.heappop(heap)
            take = min(packs, left)
            left -= take
            if take < packs:
                put(used, packs - take, pattern)
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(used + length, take, grown)
        fit = size // length
        for packs, times in ((left // fit, fit), (min(1, left % fit), left % fit)):
            if packs:
                put(times * length, packs, ((length, times),))
    return [(packs, list(pattern)) for _, _, packs, pattern in sorted(heap, key=lambda g: g[1])]


def slots(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: ``(length, from rank, to rank, times, first sequence, offset)``.

    Piece ``rank`` of a length, counted from its slot's first, is in sequence
    ``first + rank // times`` at ``offset + length * (rank % times)``.
    """
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for packs, pattern in shortest_pack_first(histogram, size):
        offset = 0
        for length, times in pattern:
            begin = rank.get(length, 0)
            rank[length] = begin + packs * times
            out.append((length, begin, rank[length], times, sequence, offset))
            offset += length * times
        sequence += packs
    return out


def pack(parts: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a column ``length``.

    Every piece keeps its other columns and gets exactly one place; the places of
    a sequence have no gap. ``order`` only fixes which of several pieces of one
    length takes which place; equal rows may swap. Lengths are 1 to ``size``; an
    empty table stays empty. ``parts`` is read twice, so give it a stored table.
    """
    spark = parts.sparkSession
    # One row per length: at most ``size`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    group = max(GROUP, total >> 18)
    groups = spark.createDataFrame(
        [(n, -(-k // group)) for n, k in histogram.items()], "length long, _groups long"
    )
    # At most two patterns per length and 90 lengths per pattern, whatever the input.
    places = spark.createDataFrame(
        slots(histogram, size), "_length long, _from long, _to long, _times long, sequence_id long, offset long"
    )
    # Ranks: a hot length is cut into groups; the groups are small and are counted
    # first, so that no task gets a length whole.
    mark = F.struct(*order, *[c for c in parts.columns if c not in order])
    dealt = parts.join(F.broadcast(groups), "length").withColumn(
        "_group", F.pmod(F.xxhash64(*order), F.col("_groups"))
    ).drop("_groups")
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n")).select(
        "length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("length", "_group").orderBy(mark)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    at = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(places), hit).select(
        *parts.columns,
        (F.col("sequence_id") + F.floor(at / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.col("length") * F.pmod(at, F.col("_times"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   size: int = SIZE, end: int = END, digest: bool = False) -> DataFrame:
    """Pieces of all documents with their ids (or their checksum) and their places.

    Null and empty texts take part with the end id alone; null and repeated ids
    are documents of their own; extra columns are dropped. Executors may be lost:
    the pieces are a written table.
    """
    parts = stage(pieces(docs, id_col, text_col, vocabulary, size, end, digest), "pieces")
    return pack(parts, size)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence in order, at most ``size``."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda p: p["ids"])).alias("ids"))
