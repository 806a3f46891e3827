"""Token counts without tokens (operator 12).

A unit of text is a row of symbols in a linked list; a heap holds the ranks of
adjacent pairs. The pair of the lowest rank, the leftmost of equal ones, is popped
and merged until none is left. The count is the number of symbols at first minus
the merges; a symbol outside the vocabulary counts as its bytes. No ids arise.

Where no piece of the vocabulary goes on after white space that follows something
else, merges never cross the begin of such white space: texts fall apart into units
there, and a worker counts each distinct unit once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from rollcall.llm.tables import narrow, slices

#: The letter that stands for a space in pieces.
MARK = "▁"
#: Units that a worker keeps; beyond that it starts anew.
KEPT = 900_000
#: Bytes of text that are counted at a time.
CHARS = 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Ranks of a sentencepiece vocabulary of byte pairs with byte fallback."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        if not any(map(self.model.is_byte, every)) or any(map(self.model.is_unused, every)):
            raise ValueError(f"{path}: only models with byte fallback and without unused pieces are counted")
        special = (self.model.is_byte, self.model.is_control, self.model.is_unknown)
        scores = {self.model.id_to_piece(i): self.model.get_score(i) for i in every if not any(s(i) for s in special)}
        # Equal scores share a rank: the leftmost pair goes first.
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.apart = not any(regex.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        self.units = regex.compile(f"{MARK}+[^{MARK}]*+|[^{MARK}]++")
        self._clear()

    def _clear(self) -> None:
        self.after: dict[str, int] = {}  # what follows one mark
        self.whole: dict[str, int] = {}  # units with their marks

    def count_unit(self, unit: str) -> int:
        """Tokens of a unit: symbols minus merges."""
        n, rank, merges = len(unit), self.rank.get, 0
        after = list(range(1, n + 1))  # begin of the next symbol; 0 for a symbol that is gone
        before = list(range(-1, n - 1))
        heap = [(r << 40) | i for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            key = heapq.heappop(heap)
            i = key & 0xFF_FFFF_FFFF
            j = after[i]
            if not j or j >= n:
                continue
            k = after[j]
            if rank(unit[i:k]) != key >> 40:
                continue  # a symbol of the pair has grown meanwhile
            merges += 1
            after[i], after[j] = k, 0
            p = before[i]
            if p >= 0 and (r := rank(unit[p:k])) is not None:
                heapq.heappush(heap, (r << 40) | p)
            if k < n:
                before[k] = i
                if (r := rank(unit[i : after[k]])) is not None:
                    heapq.heappush(heap, (r << 40) | i)
        odd = [c for i, c in enumerate(unit) if after[i] == i + 1 and c not in self.rank]
        return n - merges + sum(len(c.encode()) - 1 for c in odd)

    def _sum(self, units: list[str], known: dict[str, int], before: str) -> int:
        for u in set(units).difference(known):
            known[u] = self.count_unit(before + u)
        return sum(map(known.__getitem__, units))

    def count(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text, as the library's ``encode`` gives them by default."""
        out = []
        for text in texts:
            if len(self.after) + len(self.whole) > KEPT:
                self._clear()
            text = self.model.normalize(text)  # the model's own rules, marks for spaces among them
            if not text:
                out.append(0)
            elif not self.apart:
                out.append(self.count_unit(text))
            elif text[0] == MARK and MARK + MARK not in text:
                out.append(self._sum(text[1:].split(MARK), self.after, MARK))
            else:
                out.append(self._sum(self.units.findall(text), self.whole, ""))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 model: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per input row.

    ``n_bytes`` is the length in UTF-8; ``over_limit`` tells more than ``limit``
    tokens. Null and empty texts have none. Null, tied and repeated ids pass through;
    extra columns are dropped; an empty table gives an empty result. Texts of any
    length are counted whole. The model file must be at the same path on every executor.
    """
    path = model or default_model()
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for b in slices(whole, "text", CHARS):
                text = b.column("text").fill_null("")
                n = own.count(text.to_pylist())
                yield pa.record_batch(
                    [b.column("doc_id"), pa.compute.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
