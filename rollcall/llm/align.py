"""Alignment of the tokens of two tokenizers (operator 13).

Each tokenizer gives a rising list of the byte offsets where its tokens end. The
shorter list drives a galloping search into the longer one: from the last place on,
steps double until they pass the wanted offset, then a binary search between the
last two steps finds it. Offsets in both lists cut the text into groups; the ranks
of one common offset and the next give the range of tokens on either side, and the
last tokens of a group end together: they are linked.

Both vocabularies end a token before a single space between two other characters
(checked when they are loaded), so a text falls apart into units there and a worker
aligns each distinct unit once.

Counts of linked pairs are summed over all documents. Of two tokens that end
together one is the end of the other, so however large the corpus is, there are
never more pairs than ``Aligner.pair_bound``: a few hundred thousand rows, which is
why the table of counts is broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.bpe import SPACE, byte_letters, default_vocabulary
from rollcall.llm.counts import MARK, default_model
from rollcall.llm.tables import narrow, slices, stage

#: Units that a worker keeps; beyond that it starts anew.
KEPT = 600_000
#: Bytes of text that are aligned at a time, and characters of one text.
CHARS, PIECE = 2_000_000, 2_000_000


def gallop(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of the values that two rising lists share."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    out, low, n = [], 0, len(long)
    for i, x in enumerate(short):
        if long[low] < x:
            step = 1
            while low + step < n and long[low + step] < x:
                step *= 2
            low = bisect_left(long, x, low + step // 2 + 1, min(low + step + 1, n))
            if low == n:
                break
        if long[low] == x:
            out.append((i, low))
    return out if short is a else [(i, j) for j, i in out]


class Unit(NamedTuple):
    """The aligned tokens of a unit."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    #: A id times the B vocabulary plus B id of each link, as 64-bit integers.
    links: bytes
    #: Last ranks of each group on both sides, where they are wanted.
    ranks: list[tuple[int, int]] | None


class Aligner:
    """Two tokenizers over the same bytes: A byte-level, B pieces with byte fallback."""

    def __init__(self, a_path: str, b_path: str, ranks: bool = False) -> None:
        self.ranks = ranks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the threads
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(a_path)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in byte_letters().items()}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(self.first.get_vocab().values()) + 1)
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.a_bytes[i] = bytes(back[c] for c in token)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.width = len(pieces)
        self.digits = [str(i) for i in range(max(len(self.a_bytes), self.width))]
        levels = spec["pre_tokenizer"] or {}
        level = levels.get("type") == "ByteLevel" and levels.get("use_regex") and spec["normalizer"] is None
        crossing = any(regex.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.cut = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])") if level and not crossing else None
        self.known: dict[str, Unit | None] = {}
        self.odd: set[str] = set()  # units with white space at an end

    def pair_bound(self) -> int:
        """Most pairs of ids that can ever be linked: one token's bytes end the other's."""
        sides = [{}, {}]
        for side, tokens in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
            for t in tokens:
                side[t] = side.get(t, 0) + 1
        ends = [sum(side.get(t[i:], 0) for t in tokens for i in range(len(t)))
                for side, tokens in zip(sides[::-1], (self.a_bytes, self.b_bytes), strict=True)]
        return sum(ends)

    def _learn(self, units: list[str]) -> None:
        first = self.first.encode_batch([" " + u for u in units], add_special_tokens=False)
        second = self.second.encode(units, num_threads=1)
        for u, x, b in zip(units, first, second, strict=True):
            a, raw = x.ids, (" " + u).encode()
            at, bt = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            same = b"".join(at) == raw == b"".join(bt)
            self.known[u] = self._unit(a, b, at, bt) if same else None

    def _unit(self, a: list[int], b: list[int], at: list[bytes], bt: list[bytes]) -> Unit:
        ranks = gallop(list(accumulate(map(len, at))), list(accumulate(map(len, bt))))
        digits, i, j, parts, links = self.digits, 0, 0, [], array("q")
        for p, q in ranks:
            left = digits[a[p]] if p == i else ",".join([digits[t] for t in a[i : p + 1]])
            right = digits[b[q]] if q == j else ",".join([digits[t] for t in b[j : q + 1]])
            parts.append(left + "|" + right)
            links.append(a[p] * self.width + b[q])
            i, j = p + 1, q + 1
        return Unit(len(a), len(b), len(ranks), ";".join(parts), links.tobytes(), ranks if self.ranks else None)

    def _parts(self, text: str) -> Iterator[str]:
        """A text cut at unit ends, a bounded number of characters at a time."""
        begin = 0
        while begin < len(text):
            stop = self.cut.search(text, begin + PIECE) if self.cut and len(text) - begin > PIECE else None
            yield text[begin : stop.start()] if stop else text[begin:]
            begin = stop.end() if stop else len(text)

    def _units(self, part: str) -> tuple[list[str], set[str]]:
        """Units of a part, each of which follows a space, and those not known yet."""
        if self.cut is None:
            return [part], {part}.difference(self.known)
        units = part.split(" ")
        seen = set(units)
        fresh = seen.difference(self.known)
        odd = {u for u in fresh if not u or u[0] in WHITE or u[-1] in WHITE}
        self.odd |= odd
        if odd or not seen.isdisjoint(self.odd):  # a space beside other white space: cut with care
            units = self.cut.split(part)
            fresh = set(units).difference(self.known)
            self.odd |= {u for u in fresh if u[0] in WHITE or u[-1] in WHITE}
        return units, fresh

    def align(self, text: str) -> list[Unit] | None:
        """The units of a text in order; none where a tokenizer changes a byte."""
        # No cycles arise here; looking for them among very many units takes a tenth of the time.
        gc.disable()
        try:
            return self._align(text)
        finally:
            gc.enable()

    def _align(self, text: str) -> list[Unit] | None:
        out: list[Unit] = []
        for part in self._parts(text):
            if len(self.known) > KEPT:
                self.known, self.odd = {}, set()
            units, fresh = self._units(part)
            if fresh:
                self._learn(list(fresh))
            found = list(map(self.known.__getitem__, units))
            if None in found:
                return None
            out += found
        return out


WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACE}]", c))


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, ranks: bool = False) -> Aligner:
    return Aligner(a_path, b_path, ranks)


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or default_vocabulary(), b or default_model()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str | None = None,
           b_model: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, a_ends, b_ends``: the tokens of both sides and the groups they form.

    Group k holds the A tokens of rank ``a_ends[k-1]`` to below ``a_ends[k]`` (0 for
    the first) and the B tokens likewise. Cases as in ``align_documents``; texts
    without tokens have empty lists.
    """
    paths = _paths(a_vocabulary, b_model)
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths, ranks=True)
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                n_a, n_b, a_ends, b_ends = [], [], [], []
                for t in b.column("text").to_pylist():
                    x, y, i, j = 0, 0, [], []
                    for u in own.align(t or "") or []:
                        i += [x + r + 1 for r, _ in u.ranks]
                        j += [y + r + 1 for _, r in u.ranks]
                        x, y = x + u.n_a, y + u.n_b
                    n_a.append(x), n_b.append(y), a_ends.append(i), b_ends.append(j)
                ints = pa.list_(pa.int32())
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array(a_ends, ints), pa.array(b_ends, ints)],
                    ["doc_id", "n_a", "n_b", "a_ends", "b_ends"],
                )

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, a_ends array<int>, b_ends array<int>")


def _linked(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """Per document its counts, the digest of its groups, and each linked pair with how often it occurs."""
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                n, shas, keys, times = [], [], [], []
                for t in b.column("text").to_pylist():
                    units = own.align(t) if t else None
                    if not units:
                        n.append((0, 0, 0, 0)), shas.append("")
                        continue
                    h, joint = hashlib.sha256(), ""
                    for i in range(0, len(units), 50_000):
                        h.update((joint + ";".join([u.text for u in units[i : i + 50_000]])).encode())
                        joint = ";"
                    raw = np.frombuffer(b"".join([u.links for u in units]), np.int64)
                    key, often = np.unique(raw, return_counts=True)
                    n.append((sum([u.n_a for u in units]), sum([u.n_b for u in units]), len(raw), len(key)))
                    shas.append(h.hexdigest()), keys.append(key), times.append(often)
                cols = np.array(n, np.int64).reshape(-1, 4).T
                ends = pa.array(np.concatenate([[0], np.cumsum(cols[3])]), pa.int32())
                flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (keys, times)]
                pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["pair", "times"]))
                yield pa.record_batch(
                    [b.column("doc_id"), *(pa.array(c) for c in cols[:3]), pa.array(shas, pa.string()), pairs],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"],
                )

    kind = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    return src.mapInArrow(run, schema + ", pairs array<struct<pair:long,times:long>>")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """``pair, count, best``: links of each pair of ids over all documents, and whether
    no other A id is linked more often with its B id (ties: all are best)."""
    each = linked.select(F.explode("pairs").alias("p")).select("p.pair", "p.times")
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    counts = counts.withColumn("b", F.col("pair") % width)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str | None = None,
                    b_model: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per input row.

    A encodes a space and the text, B the text, both without special tokens, whose
    strings count as text. Null and empty texts, and those whose bytes either side
    changes, have no tokens: zeros and an empty digest. Null, tied and repeated ids
    pass through, each row counts; extra columns are dropped; an empty table gives an
    empty result. Both files must be at the same paths on every executor.
    """
    paths = _paths(a_vocabulary, b_model)
    linked = stage(_linked(docs, paths, id_col, text_col), "align_linked")
    width = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    counts = stage(pair_counts(linked, width), "align_counts")
    keys = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    rows = linked.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", *keys, F.explode_outer("pairs").alias("p")).select("row", *keys, "p.pair", "p.times")
    # Bounded by the vocabularies, see above.
    scored = each.join(F.broadcast(counts), "pair", "left").groupBy("row", *keys).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).cast("long").alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.col("count")), F.lit(0)).cast("long").alias("count_sum"),
    )
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
