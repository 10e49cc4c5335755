"""Positive-unlabelled quality classifier: a linear model fitted by minimising the non-negative unbiased risk.

Positives are documents labelled 1, unlabelled ones come from all documents, and the class prior is estimated from these
two: where no negative scores, unlabelled rows are as much rarer than positives as the prior says. Labelled negatives
take no part. The features are shares of character classes, word and line shapes of the whole text; id, source, language
and labels are never among them. The fit runs on the driver over bounded samples of feature rows; scoring is a map over
all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Bounds of the samples that the fit takes: positives, and unlabelled rows.
LABELLED_ROWS, UNLABELLED_ROWS = 12_000, 12_000
THRESHOLD = 0.3
#: What the estimated prior is lowered by at most, as a share of it.
MARGIN = 0.025
FOLDS, HELD_OUT = 5, 0

_KIND = np.zeros(256, dtype=np.uint8)  # 0 white space or control, 1 lower, 2 upper, 3 digit, 4 stop, 5 mark, 6 other
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 6 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 0 if _c.isspace() or _i < 32 else 4 if _c in ".,;:?'\"-()" else 5
N_FEATURES = 24
_MARKS = frozenset(i for i in range(33, 128) if not chr(i).isalnum() and chr(i) not in ".,;:")


def features(text: bytes | None) -> np.ndarray:
    """The feature row of one text; empty and null texts have the row of an empty text."""
    text = text or b""
    x = np.zeros(N_FEATURES)
    x[0] = 1.0 if not text.strip() else 0.0
    raw = np.frombuffer(text, dtype=np.uint8)
    words = text.split()
    n, w = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_KIND[raw], minlength=7) / n
    x[1:8] = np.sqrt(kinds)
    x[8] = np.log1p(len(words))
    x[9] = np.log1p(len(raw) / w)
    low = Counter(text.lower().split())
    x[10] = len(low) / w
    x[11] = np.log1p(max(low.values(), default=0)) - np.log1p(w)
    top = low.most_common(10)
    x[12] = sum(c for _, c in top) / w
    lines = [line for line in text.split(b"\n") if line.strip()]
    x[13] = np.log1p(len(lines))
    x[14] = len(set(lines)) / max(1, len(lines))
    x[15] = np.log1p(n / max(1, len(lines)))
    x[16] = np.sqrt(sum(map(bytes.isupper, words)) / w)
    x[17] = np.sqrt(sum(c for word, c in low.items() if word[-1] in _MARKS) / w)
    x[18] = np.sqrt(sum(c for word, c in low.items() if len(word) == 1 and not word.isalnum()) / w)
    x[19] = np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / w)
    x[20] = text.count(b". ") / w
    x[21] = np.sqrt(sum(c for word, c in low.items() if len(word) <= 3) / w)
    x[22] = np.sqrt(np.count_nonzero(raw[1:] == raw[:-1]) / n)
    x[23] = np.sqrt((text.count(b"http") + text.count(b"@")) / w)
    return x


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand((x - self.mean) / self.scale) @ self.weight, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, their bounded squares and hinges, and a constant."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.minimum(z * z, 12) / 4, np.maximum(z - 0.5, 0), np.maximum(-z - 0.5, 0), np.ones((len(z), 1))], axis=1)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise prior * R+(f) + max(0, R-u(f) - prior * R-p(f)) with the logistic loss (full batches, Adam).

    While the negative part is below 0, only its gradient is followed back, which keeps the risk from over-fitting.
    """
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    w, m, v = np.zeros(positive.shape[1]), 0.0, 0.0
    for t in range(1, rounds + 1):
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        plus = positive.T @ (p - 1) / len(p)
        minus = unlabelled.T @ u / len(u) - prior * (positive.T @ p) / len(p)
        risk = -np.log(1 - u + 1e-12).mean() - prior * -np.log(1 - p + 1e-12).mean()
        g = (prior * plus + minus if risk >= 0 else -minus) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from expanded features of both.

    U = prior * P + (1 - prior) * N, so for any set of rows U / P is at least the prior, and near it for a set without
    negatives. The sets are those above a score that tells positives from unlabelled rows, fitted on half of the
    positives and read on the other half, both ways. Each holds 40 to 80 % of the positives, so that its sampling error
    is small, and of the ratios of these sets the least counts, less twice that error, MARGIN at most: too high a prior lets
    negatives pass, while one a little low costs nothing, and one far too low rejects positives.
    """
    ratios = []
    for k in range(2):
        learnt, read = positive[k::2], positive[1 - k :: 2]
        if not len(learnt) or not len(read) or not len(unlabelled):
            return 0.5
        w = fit_nnpu(learnt, unlabelled, 0.5, rounds=300)
        p, u = np.sort(read @ w), np.sort(unlabelled @ w)
        at = np.quantile(p, np.linspace(0.2, 0.6, 9))
        above = lambda v, at=at: 1 - np.searchsorted(v, at) / len(v)
        ratios.append(above(u) / np.maximum(above(p), 1 / len(p)))
    ratio, share = np.mean(ratios, axis=0), np.linspace(0.8, 0.4, 9)
    best = int(ratio.argmin())
    error = np.sqrt((1 / share[best] - 1) / len(positive) + (1 / np.clip(ratio[best] * share[best], 1e-3, 1) - 1) / len(unlabelled))
    return float(np.clip(ratio[best] * (1 - min(2 * error, MARGIN)), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Model from features of positives and of unlabelled rows. Without either, every score is 0.5."""
    pool = np.concatenate([positive, unlabelled]) if len(positive) or len(unlabelled) else np.zeros((1, N_FEATURES))
    mean, scale = pool.mean(axis=0), pool.std(axis=0) + 1e-6
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, np.zeros(_expand(np.zeros((1, N_FEATURES))).shape[1]), 0.5)
    p, u = (_expand((rows - mean) / scale) for rows in (positive, unlabelled))
    prior = estimate_prior(p, u)
    # the estimate is on the low side: what a model fitted with it takes for positive is nearer, and fits the final one
    prior = float(np.clip((u @ fit_nnpu(p, u, prior) >= 0).mean(), prior, 0.98))
    return Model(mean, scale, fit_nnpu(p, u, prior), prior)


def _fold(c: str):
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most LABELLED_ROWS positive and UNLABELLED_ROWS unlabelled documents, chosen by a hash of their id.

    Labels of fold 0, null labels, null ids and ids with contradicting labels teach nothing. The chosen ids are a
    broadcast of proven size (LABELLED_ROWS rows of two numbers); only feature rows come to the driver.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (_fold(id_col) != HELD_OUT))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).alias("__y")).filter("__y = 1")  # never labelled 0
    known = known.orderBy(F.xxhash64("__id", F.lit(6)), "__id").limit(LABELLED_ROWS)
    n = docs.count()
    share = min(1.0, 0.98 * UNLABELLED_ROWS / max(1, n))
    drawn = F.coalesce(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000), F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), drawn.alias("drawn"))
    picked = base.join(F.broadcast(known), base["doc_id"] == F.col("__id"), "left").filter("drawn OR __y IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).astype(np.float32).tobytes() for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["drawn", "y", "x"])

    rows = picked.select("drawn", F.col("__y").cast("int").alias("y"), "text").mapInArrow(run, "drawn boolean, y int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(float)
    y = np.array([-1 if v is None else v for v in rows["y"].to_pylist()], dtype=int)
    order = np.lexsort(x.T)  # the same sums whatever order rows arrive in
    x, y, u = x[order], y[order], np.array(rows["drawn"].to_pylist(), dtype=bool)[order]
    return fit(x[y == 1], x[u])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null text scores as empty; a null id is in no
    fold and so not held out."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t) for t in utf8(b.column(1))]) if b.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared_model.value.scores(x))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted 1, with all their columns: rejected inside the scan, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = model.value.scores(np.stack([features(t) for t in utf8(b.column(at))])) >= THRESHOLD
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
