"""Quality scores by positive-unlabelled learning (operator 8).

Trusted positives are documents marked good; everything without a mark is
unlabelled web text, good and bad mixed in an unknown share. A logistic model
minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where the prior, the share of good documents among the unlabelled, is estimated
first: a classifier of positives against unlabelled ranks both, and the part of
the unlabelled that looks no better than the worst positives bounds it from above.
Marks of bad documents are never used, nor language, source or id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow, slices, stage

#: Documents of each kind that the model is fitted on, at most: those of smallest digest.
SAMPLE = 20_000
#: Score from which a document is predicted good.
CUT = 0.3
FEATURES = (
    "chars", "words", "upper", "digit", "mark", "bar", "shout", "symbol", "distinct", "top", "line_repeat", "length",
    "stops", "commas", "lines", "short", "capital", "pairs", "ends", "brackets", "letters", "longest", "triples",
)
_MARKS = str.maketrans("", "", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))


def measure(text: str | None) -> list[float]:
    """Counts over the whole text that tell prose from junk in any language."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    spaces = sum(map(count, " \n\t"))
    bare = len(text.translate(_MARKS))
    symbols = sum(map(count, "#$%&*@^~\\=+<>_"))
    upper = sum(map(str.isupper, words))
    capital = sum(w[:1].isupper() for w in words)
    digits = sum(map(count, "0123456789"))
    pairs = len(set(zip(words, words[1:], strict=False)))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    short = sum(len(w) <= 3 for w in words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), upper / k, digits / n, (len(text) - bare) / n, count("|") / k,
        count("!") / k, symbols / k, len(counts) / k, top / k, 1 - len(set(lines)) / max(len(lines), 1),
        (n - spaces) / k / 10, count(".") / k, count(",") / k, len(lines) / k, short / k, capital / k,
        pairs / max(k - 1, 1), float(text.rstrip()[-1:] in tuple(".!?\"'")), sum(map(count, "()[]{}")) / k,
        (bare - spaces - digits) / n, max(map(len, counts), default=0) / 50, triples / max(k - 2, 1),
    ]


def _spread(x: np.ndarray) -> np.ndarray:
    """Shares are often near 0; their roots tell small ones apart."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_spread(x) - self.mean) / self.scale, -6, 6)
        return _sigmoid(z @ self.weights + self.bias)


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(good: np.ndarray, mixed: np.ndarray, slack: float = 0.02) -> float:
    """Share of good rows among mixed ones, from scores that rank both alike.

    Below any limit lie at least ``prior`` times the positives' share; the limit
    where the unlabelled exceed that most gives the estimate. Limits under which
    few rows lie say little, so their ratios carry a margin.
    """
    limits = np.quantile(np.concatenate([good, mixed]), np.linspace(0.02, 0.98, 97))
    above_good = 1 - np.searchsorted(np.sort(good), limits, "left") / max(len(good), 1)
    above_mixed = 1 - np.searchsorted(np.sort(mixed), limits, "left") / max(len(mixed), 1)
    margin = np.sqrt(np.log(4 / 0.05) / 2 / max(min(len(good), len(mixed)), 1))
    ratio = (above_mixed + margin) / np.maximum(above_good - margin, 1e-9)
    return float(np.clip(np.min(ratio[above_good > margin + 1e-9], initial=1.0) - margin, slack, 1 - slack))


def fit(good: np.ndarray, mixed: np.ndarray, steps: int = 600, decay: float = 1e-3) -> Model:
    """Model from rows of measures of trusted positives and of unlabelled documents.

    Without rows of a kind every document scores the prior of 1 - slack.
    """
    width = 3 * len(FEATURES)
    if not len(good) or not len(mixed):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(0.98 / 0.02)), 0.98)
    p, u = _spread(good.astype(float)), _spread(mixed.astype(float))
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))]) for x in (p, u))

    def versus(w: np.ndarray) -> np.ndarray:
        g = -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u)
        return g + decay * w

    rank = _adam(versus, p.shape[1], steps // 2, 0.05)
    prior = estimate_prior(p @ rank, u @ rank)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        plus = -p.T @ (1 - sp) / len(p)
        minus = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        value = np.mean(np.logaddexp(0, u @ w)) - prior * np.mean(np.logaddexp(0, p @ w))
        # Below zero the model has begun to fit noise: step back instead.
        return (prior * plus + minus if value >= 0 else -minus) + decay * w

    w = _adam(risk, p.shape[1], steps, 0.05)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: CRC32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _measured(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(measure(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [*(b.column(c) for c in ("id", "kind", "digest")), pa.array(x, pa.list_(pa.float64()))],
                ["id", "kind", "digest", "x"],
            )

    # Rows that repeat an id count once, by the text of smallest digest.
    measured = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, kind int, digest long, x array<double>")
    return measured.groupBy("id", "kind").agg(F.min_by("x", F.struct("digest", "x")).alias("x")).select("kind", "x")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          quality_col: str = "quality") -> Model:
    """Fit on at most ``rows`` marked good and ``rows`` unmarked documents.

    Which ones is decided by digests of ids; at most ``2 * rows`` ids are sent to
    the tasks, and only those documents' measures reach the driver. Marks of
    held-out rows aren't read.
    """
    src = narrow(docs, doc_id=id_col, text=text_col)
    marks = narrow(labels, doc_id="doc_id", quality=quality_col)
    ids = src.select("doc_id").filter("doc_id is not null")
    good = marks.filter(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    first = lambda df: df.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = first(ids.join(good, "doc_id", "left_semi")).withColumn("kind", F.lit(1)).unionByName(
        first(ids.join(marks.select("doc_id"), "doc_id", "left_anti")).withColumn("kind", F.lit(0))
    )
    picked = stage(picked, "quality_sample")
    texts = src.join(F.broadcast(picked), "doc_id")
    got = _measured(texts.select(F.col("doc_id").alias("id"), "kind", F.xxhash64("text").alias("digest"), "text")).toArrow()
    kind = got.column("kind").to_numpy()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(kind), len(FEATURES))
    order = np.lexsort((*x.T, kind))  # the fit must not depend on the order of rows
    return fit(x[order][kind[order] == 1], x[order][kind[order] == 0])


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                    cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Null and empty texts are scored by their measures like all others; null ids
    are not held out and have no mark; repeated rows get equal scores; labels of
    unknown documents are ignored; extra columns are dropped; an empty table gives
    an empty result. The model is fitted on at most ``rows`` trusted positives and
    ``rows`` unlabelled documents; every whole text is measured and scored.
    """
    model = train(docs, labels, rows, id_col, text_col)
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                score = model.score(np.array([measure(t) for t in b.column("text").to_pylist()]))
                yield pa.record_batch([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
              cut: float = CUT) -> DataFrame:
    """The given rows and columns of documents that score ``cut`` or more."""
    model = train(docs, labels, rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                score = model.score(np.array([measure(t) for t in b.column(text_col).to_pylist()]))
                yield b.filter(pa.array(score >= cut))

    return docs.mapInArrow(run, docs.schema)
