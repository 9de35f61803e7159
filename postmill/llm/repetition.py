"""Repetition inside a document: the share of repeated runs of five words.

A logistic regression over hashed n-grams tells which documents may be repetitive, and an exact count
follows for those: a document is counted if its calibrated probability reaches ASK_FROM, and no other
is.  The features are what is cheap for a whole batch at once: a histogram of hashed words and pairs of
words, one of hashed character n-grams, how often words and pairs occur again, and the length.

The model is fitted on at most SAMPLE_ROWS documents, drawn by hash of the id from all; only their
feature vectors reach the driver.  A corpus may hold so little repetition that no sample shows it, so
every document of the sample is a labelled row twice: as it is, and with a stretch of itself, from
a phrase to the whole text, repeated.  Rows are labelled by their exact share, and count as positive
from SUSPECT on, well below the threshold that is asked for, so what lies above that is not on the
border of the classes.  With one class only, the model can't tell and every document is counted.

Defined cases: null and empty texts and texts of fewer than five words have no runs, share 0;
texts of any length are counted whole; every row of a repeated id is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import flat_hashes, run_hashes, word_hashes

RUN = 5
THRESHOLD = 0.3
SUSPECT = 0.18  # share from which on a labelled row is positive
SAMPLE_ROWS = 2_000
ASK_FROM = 0.03
WORD_BUCKETS = 256
CHAR_BUCKETS = 128
FEATURES = WORD_BUCKETS + CHAR_BUCKETS + 5

SCORED = "doc_id long, runs long, distinct_runs long, repeated_share double, probability double, likely boolean"


def exact_share(hashed: np.ndarray) -> tuple[int, int]:
    runs = run_hashes(hashed, RUN)
    return len(runs), len(np.unique(runs))


def _within(hashed: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that don't cross from one document into the next, with their documents."""
    runs = run_hashes(hashed, length)
    inside = owner[: len(runs)] == owner[length - 1 : length - 1 + len(runs)]
    return runs[inside], owner[: len(runs)][inside]


def _histogram(hashed: np.ndarray, owner: np.ndarray, docs: int, buckets: int) -> np.ndarray:
    """Square roots of the shares of each bucket, a row for each document."""
    at = (hashed >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)
    counts = np.bincount(owner * buckets + at, minlength=docs * buckets).reshape(docs, buckets)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _again(hashed: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """The share of entries beyond the first of each kind, for each document."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(32)) | (hashed >> np.uint64(32)))
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    distinct = np.bincount((keys[first] >> np.uint64(32)).astype(np.int64), minlength=docs)
    total = np.bincount(owner, minlength=docs)
    return np.where(total > 0, 1.0 - distinct / np.maximum(total, 1), 0.0)


def features_of(texts: list[str], hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The feature vectors of a block of texts."""
    docs = len(texts)
    out = np.zeros((docs, FEATURES), dtype=np.float32)
    owner = np.repeat(np.arange(docs), counts)
    pairs, pair_owner = _within(hashed, owner, 2)
    threes, three_owner = _within(hashed, owner, 3)
    out[:, :WORD_BUCKETS] = _histogram(np.concatenate([hashed, pairs]), np.concatenate([owner, pair_owner]), docs, WORD_BUCKETS)
    raw = [t.encode("utf-8", "replace") for t in texts]
    signs = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    if len(signs) > 3:
        four = signs[:-3] | (signs[1:-2] << np.uint64(8)) | (signs[2:-1] << np.uint64(16)) | (signs[3:] << np.uint64(24))
        sign_owner = np.repeat(np.arange(docs), [len(r) for r in raw])[: len(four)]
        out[:, WORD_BUCKETS : WORD_BUCKETS + CHAR_BUCKETS] = _histogram(four * np.uint64(0x9E3779B97F4A7C15), sign_owner, docs, CHAR_BUCKETS)
    out[:, -5] = _again(pairs, pair_owner, docs)
    out[:, -4] = _again(threes, three_owner, docs)
    out[:, -3] = _again(hashed, owner, docs)
    out[:, -2] = np.log1p(counts) / 10
    out[:, -1] = out[:, -4] ** 2
    return out


class Model:
    """Logistic regression, then a logistic calibration of its scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge penalty; the bias isn't penalised."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    """Fitted on two thirds of the rows, calibrated on the rest.  If a part has one class only, nothing
    can be told, and every probability is 1."""
    held = np.arange(len(y)) % 3 == 2
    if any(len(part) < 10 or part.min() == part.max() for part in (y[held], y[~held])):
        return Model(np.zeros(x.shape[1]), 0.0, 0.0, 30.0)
    w, b = _fit(x[~held], y[~held], penalty=0.05)
    score = (x[held] @ w + b)[:, None]
    soft = np.where(y[held] > 0, (y[held].sum() + 1) / (y[held].sum() + 2), 1 / ((1 - y[held]).sum() + 2))
    slope, shift = _fit(score, soft, penalty=1e-3)
    return Model(w, b, float(slope[0]), shift)


def _sampled(documents: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` documents with the smallest hashes; most are filtered out at the scan."""
    total = documents.count()
    rank = F.xxhash64(F.col("doc_id"), F.lit(17))
    share = min(1.0, 2.0 * rows / max(1, total))
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    return (
        documents.select("doc_id", "text", rank.alias("rank"))
        .where(F.col("rank") <= F.lit(limit))
        .orderBy("rank", "doc_id")
        .limit(rows)
    )


def repeated_part(text: str, seed: int) -> str:
    """The text with a stretch of its words repeated, as spam and broken generation do: from a phrase of
    five words to all of it, once or several times, behind it or inside."""
    words = text.split()
    draw = np.random.default_rng(seed)
    if not words:
        return text
    size = int(draw.integers(5, max(6, len(words) + 1)))
    start = int(draw.integers(0, max(1, len(words) - size + 1)))
    part = words[start : start + size]
    times = 1 + int(draw.integers(0, 1 + max(1, len(words) // max(1, len(part)))))
    at = int(draw.integers(0, len(words) + 1)) if draw.random() < 0.5 else len(words)
    return " ".join(words[:at] + part * times + words[at:])


def train(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            both = [x for k, t in zip(ids, texts) for x in (t, repeated_part(t, (k or 0) & 0x7FFFFFFF))]
            vectors, labels = [], []
            for block, hashed, counts in flat_hashes(both):
                vectors.extend(v.tobytes() for v in features_of(block, hashed, counts))
            for hashed in word_hashes(both):
                n, d = exact_share(hashed)
                labels.append(bool(n and (n - d) / n >= SUSPECT))
            yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(labels, pa.bool_())], ["x", "y"])

    # two rows for each of the sample
    got = _sampled(documents, rows).select("doc_id", "text").mapInArrow(label, "x binary, y boolean").collect()
    if not got:
        return fit_model(np.zeros((0, FEATURES)), np.zeros(0))
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in got])
    return fit_model(x, np.array([float(r.y) for r in got]))


def score_repetition(documents: DataFrame, model: Model | None = None, all_shares: bool = True) -> DataFrame:
    """``doc_id, runs, distinct_runs, repeated_share, probability, likely``, a row per document.

    With ``all_shares`` every document has its exact share; without, documents that the model rules out
    (``likely`` is false) have null in the three exact columns.
    """
    model = model or train(documents)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[int | None] = []
            d: list[int | None] = []
            share: list[float | None] = []
            found = []
            for block, hashed, counts in flat_hashes(batch.column(1).to_pylist()):
                probability = model.probability(features_of(block, hashed, counts))
                found.append(probability)
                ends = np.cumsum(counts)
                for k, p in enumerate(probability):
                    if all_shares or p >= ASK_FROM:
                        a, b = exact_share(hashed[ends[k] - counts[k] : ends[k]])
                        n.append(a), d.append(b), share.append((a - b) / a if a else 0.0)
                    else:
                        n.append(None), d.append(None), share.append(None)
            probability = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(share, pa.float64()),
                 pa.array(probability, pa.float64()), pa.array(probability >= ASK_FROM, pa.bool_())],
                ["doc_id", "runs", "distinct_runs", "repeated_share", "probability", "likely"],
            )

    return documents.select("doc_id", "text").mapInArrow(score, SCORED)


def repetitive(documents: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``doc_id`` of documents that the model holds for likely and whose exact share of repeated runs
    reaches ``threshold``."""
    scored = score_repetition(documents, model, all_shares=False)
    return scored.where(F.col("likely") & (F.col("repeated_share") >= threshold)).select("doc_id").distinct()
