"""Byte-pair encoding and decoding (operator 1).

Each distinct word is encoded once per worker. A word is a contiguous array of
parts with the ranks of adjacent pairs beside it: scan for the lowest rank,
delete that boundary, refresh the two neighbouring ranks, repeat. Words of one
length are held as the rows of a matrix, so that one numpy step does this for
thousands of words; every row that is still open loses exactly one boundary per
step. Words over ``LONG`` bytes use a heap of pairs with the same order of merges.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rollcall.llm.tables import narrow, slices

#: White space as the tokenizers' patterns understand it.
_WIDE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = "\t-\r " + "".join(map(chr, _WIDE))
#: The split into words of the byte-level vocabulary.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes from which a word leaves the matrix for the heap.
LONG = 96
#: Entries that a worker keeps; beyond that it starts anew.
KEPT = 900_000
#: Bytes of text that are encoded at a time.
CHARS = 4_000_000
_NONE = np.iinfo(np.int32).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranks of a merge list and the encoder of single words."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "") -> None:
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        # The merged token drops nothing: its text is both texts in a row.
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        width = int(max(self.first.max(), self.last.max())) + 1
        a, b = np.divmod(np.arange(width * width, dtype=np.int64), width)
        self.small = self.look_up(a, b).reshape(width, width)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the highest number where they never merge."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def encode(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[bytes, bytes] = {}
        for n, same in by_length.items():
            if n == 0:
                out[b""] = b""
            elif n > LONG:
                for w in same:
                    out[w] = self._long(w)
            else:
                for i in range(0, len(same), 8192):
                    self._matrix(same[i : i + 8192], n, out)
        return out

    def _base(self, raw: np.ndarray) -> np.ndarray:
        ids = self.first[raw]
        ids[..., -1] = self.last[raw[..., -1]]
        return ids

    def _matrix(self, words: list[bytes], n: int, out: dict[bytes, bytes]) -> None:
        ids = self._base(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n))
        row = np.arange(len(words))

        def settle(which: np.ndarray) -> None:
            blob, k = ids[which].astype("<u4").tobytes(), 4 * ids.shape[1]
            for i, r in enumerate(row[which].tolist()):
                out[words[r]] = blob[i * k : i * k + k]

        ranks = self.small[ids[:, :-1], ids[:, 1:]]
        while ids.shape[1] > 1 and len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            closed = best == _NONE
            if closed.any():
                settle(closed)
                live = ~closed
                ids, ranks, row, at, best = ids[live], ranks[live], row[live], at[live], best[live]
            every, spot = np.arange(len(row)), at[:, None]
            cols = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, cols + (cols > spot), 1)
            ids[every, at] = self.merged[best]
            cols = cols[:, :-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= spot), 1)
            for r, left in ((every[at > 0], at[at > 0] - 1), (every[at < ids.shape[1] - 1], at[at < ids.shape[1] - 1])):
                ranks[r, left] = self.look_up(ids[r, left], ids[r, left + 1])
        if len(row):
            settle(np.ones(len(row), bool))

    def _long(self, word: bytes) -> bytes:
        ids = self._base(np.frombuffer(word, np.uint8)).tolist()
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        base = np.array(ids)
        ranks = self.look_up(base[:-1], base[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks.tolist()) if r != _NONE]
        heapq.heapify(heap)
        gone = bytearray(len(ids))

        def push(i: int) -> None:
            j = after[i]
            if i < 0 or j < 0:
                return
            key = (ids[i] << 32) | ids[j]
            k = int(np.searchsorted(self.keys, key))
            if k < len(self.keys) and self.keys[k] == key:
                heapq.heappush(heap, (int(self.ranks[k]), i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue  # a boundary beside it went meanwhile
            ids[i] = int(self.merged[rank])
            gone[j], after[i] = 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([t for t, g in zip(ids, gone) if not g], "<u4").tobytes()


class Codec:
    """A byte-level vocabulary: texts to ids and back, as its library does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The longest first, as the first match wins.
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        back = {c: b for b, c in byte_letters().items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.words = regex.compile(WORDS)
        self.apart = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self.edge = {"", *regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001))))}
        self._clear()

    def _clear(self) -> None:
        self.inner: dict[str, bytes] = {}  # texts that follow one space
        self.head: dict[str, bytes] = {}  # texts that open a document
        self.bad: set[str] = set()  # texts with white space at an end: cut those documents with care
        self.word: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        # No cycles arise here; looking for them among millions of strings costs a third of the time.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A text is cut at single spaces between two other characters, where no
        word spans; each distinct cut is encoded once.
        """
        if len(self.inner) + len(self.head) + len(self.word) > KEPT:
            self._clear()
        jobs: list[list] = []
        new_head: set[str] = set()
        new_inner: set[str] = set()
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            job: list = []
            for k, part in enumerate(parts):
                if k % 2:
                    job.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    units = part.split(" ")
                    seen = set(units)
                    fresh = seen.difference(self.inner)
                    odd = {u for u in fresh if u[:1] in self.edge or u[-1:] in self.edge}
                    self.bad |= odd
                    if odd or not seen.isdisjoint(self.bad):
                        units = self.apart.split(part)
                        fresh = set(units[1:]).difference(self.inner)
                    new_head.add(units[0])
                    new_inner |= fresh
                    job.append(units)
            jobs.append(job)
        self._learn(new_head.difference(self.head), "", self.head)
        self._learn(new_inner, " ", self.inner)
        out = []
        for job in jobs:
            found: list[bytes] = []
            for part in job:
                if isinstance(part, bytes):
                    found.append(part)
                else:
                    found.append(self.head[part[0]])
                    found.extend(map(self.inner.__getitem__, part[1:]))
            out.append(b"".join(found))
        return out

    def _learn(self, units: Iterable[str], before: str, into: dict[str, bytes]) -> None:
        known, whole, cut = self.word, [], {}
        for u in units:
            # Letters, perhaps before one mark, need no pattern.
            if u.isalpha():
                whole.append(u)
            elif u[-1:] in ",." and u[:-1].isalpha():
                cut[u] = (before + u[:-1], u[-1:])
            else:
                cut[u] = tuple(self.words.findall(before + u))
        new = {before + u for u in whole}
        new.update(*cut.values())
        new = new.difference(known)
        raw = {w.encode(): w for w in new}
        for w, ids in self.merges.encode(raw).items():
            known[raw[w]] = ids
        for u in whole:
            into[u] = known[before + u]
        for u, ws in cut.items():
            into[u] = b"".join([known[w] for w in ws])

    def decode(self, ids: bytes) -> str:
        """The text of ids; broken UTF-8 becomes replacement characters."""
        raw = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, one row per input row.

    Null and empty texts have an empty array; null, tied and repeated ids pass
    through; extra columns are dropped; an empty table gives an empty result.
    The vocabulary file must be at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec(path).encode(_texts(b))]
                yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text``: the text of every array of ids; null ids give a null text."""
    path = vocabulary or default_vocabulary()
    src = narrow(tokens, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                None if x is None else codec(path).decode(np.array(x, "<u4").tobytes())
                for x in (v.as_py() for v in b.column("ids"))
            ]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every whole text in one pass and keep only the digests:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Cases as in ``encode``."""
    path = vocabulary or default_vocabulary()
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                ids = own.encode(_texts(b))
                yield pa.record_batch(
                    [
                        b.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
