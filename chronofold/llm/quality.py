"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import as_bytes, batches, cut, read

#: Shrinkage of each class covariance towards the pooled one, then towards a multiple of the identity.
POOL, RIDGE = 0.1, 0.02
THRESHOLD = 0.7
NAMES = ("words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "lines", "distinct", "line_repeats", "short_words", "entropy", "repeat_gap", "line_length")
D = len(NAMES)
#: Steps of the calibration histogram over the squashed log-density difference.
BINS, SPAN = 400, 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@[\\]^_`{}~")] = True


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, all finite for any bytes (empty ones too)."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    size = max(1, len(text))
    p = counts[counts > 0] / size
    lines = text.split(b"\n")
    distinct = len(set(words))
    per = lambda x: math.log1p(100.0 * x / max(1, n))
    half = words[: n // 2]
    fresh = len(set(words[n // 2 :]) - set(half)) if n > 1 else 0
    longest = max(map(len, lines))
    return [
        math.log1p(n),
        math.log1p(len(text) / max(1, n)),
        math.sqrt(counts[65:91].sum() / max(1.0, letters)),
        math.sqrt(counts[48:58].sum() / size),
        per(counts[_SYMBOL].sum()),
        per(counts[124]),
        per(counts[33]),
        per(counts[46]),
        per(counts[44]),
        per(len(lines) - 1),
        math.log(max(1, distinct) / math.pow(max(1, n), 0.8)),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(sum(len(w) < 4 for w in words) / max(1, n)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        math.sqrt(fresh / max(1, n - n // 2)),
        math.log1p(longest),
    ]


def _features(it):
    import pyarrow as pa

    for batch in batches(it):
        x = [statistics(t) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x of each row's whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, "doc_id long, x array<double>")


def _vectors(batch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), float).reshape(-1, D)


def _moments(it):
    """Sums for each class over a partition: count, first and second moments, as (label, i, value)."""
    import pyarrow as pa

    sums = np.zeros((2, 1 + D + D * D))
    for batch in batches(it):
        x, y = _vectors(batch), np.asarray(batch.column("label"), int)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    label, i = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(label.ravel().astype("int32")), pa.array(i.ravel().astype("int32")), pa.array(sums.ravel())], names=["label", "i", "value"])


class Discriminant:
    """Class means and Cholesky factors of the shrunk class covariances, with a calibrated score."""

    def __init__(self, sums: np.ndarray) -> None:
        self.n = sums[:, 0]
        self.ready = bool((self.n > 1).all())
        self.slope, self.offset = 1.0, 0.0
        if not self.ready:
            return
        mean = sums[:, 1 : 1 + D] / self.n[:, None]
        second = sums[:, 1 + D :].reshape(2, D, D) / self.n[:, None, None]
        covariance = second - mean[:, :, None] * mean[:, None, :]
        pooled = (covariance * self.n[:, None, None]).sum(0) / self.n.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.mean, self.scale = mean / scale, scale
        self.factors, self.log_det = [], []
        for c in (0, 1):
            s = ((1 - POOL) * covariance[c] + POOL * pooled) / np.outer(scale, scale)
            s = (1 - RIDGE) * s + RIDGE * max(1e-6, np.trace(s) / D) * np.eye(D)
            low = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Squashed log-density difference of class 1 to class 0, from the Mahalanobis distances."""
        z = x / self.scale
        d = [(((z - self.mean[c]) @ self.factors[c].T) ** 2).sum(1) + self.log_det[c] for c in (0, 1)]
        return np.arcsinh((d[0] - d[1]) / 2)

    def calibrate(self, centre: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        """Logistic curve over the histogram of labelled differences, by Newton's method with a weak prior."""
        x = np.stack([centre, np.ones_like(centre)], 1)
        loss = lambda w: (good * np.logaddexp(0, -(x @ w)) + bad * np.logaddexp(0, x @ w)).sum() + 0.5 * w @ w
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (bad * p - good * (1 - p)) + w
            step = np.linalg.solve((x * ((good + bad) * p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.0 if self.n[0] > self.n[1] else 1.0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on all rows (x, label); the driver sees sums and a histogram of fixed size only."""
    sums = np.zeros((2, 1 + D + D * D))
    for r in labelled.mapInArrow(_moments, "label int, i int, value double").groupBy("label", "i").agg(F.sum("value").alias("value")).collect():
        sums[r["label"], r["i"]] = r["value"]
    model = Discriminant(sums)
    if not model.ready:
        return model

    def histogram(it):
        import pyarrow as pa

        n = np.zeros((2, BINS), np.int64)
        for batch in batches(it):
            z = model.difference(_vectors(batch))
            at = np.clip(((z + SPAN) * BINS / (2 * SPAN)).astype(int), 0, BINS - 1)
            np.add.at(n, (np.asarray(batch.column("label"), int), at), 1)
        label, at = np.indices(n.shape)
        yield pa.RecordBatch.from_arrays([pa.array(label.ravel().astype("int32")), pa.array(at.ravel().astype("int32")), pa.array(n.ravel())], names=["label", "i", "n"])

    seen = np.zeros((2, BINS))
    for r in labelled.mapInArrow(histogram, "label int, i int, n long").groupBy("label", "i").agg(F.sum("n").alias("n")).collect():
        seen[r["label"], r["i"]] = r["n"]
    model.calibrate((np.arange(BINS) + 0.5) * 2 * SPAN / BINS - SPAN, seen[1], seen[0])
    return model


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    The model learns from rows with a label 0 or 1 whose doc_id is not held out; a doc_id with several labels
    counts with the largest. Labels, language, source and id are no inputs of a score. Null and empty texts get
    the score of their statistics (all zero). Repeated rows score alike. With fewer than two rows in a class
    nothing can be fitted: then each score is 1, or 0 if only label 0 was seen. An empty table gives no rows.
    One pass reads the texts; the model is fitted and applied on their checkpointed statistics.
    """
    held = cut(features(docs))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    model = fit(held.where(~is_held_out()).join(known, "doc_id").select("x", "label"))

    def scored(it):
        import pyarrow as pa

        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_vectors(batch)))], names=["doc_id", "score"])

    return held.mapInArrow(scored, "doc_id long, score double").select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores THRESHOLD or more; the texts are read twice and not shuffled."""
    held = cut(features(docs))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    model = fit(held.where(~is_held_out()).join(known, "doc_id").select("x", "label"))
    schema = docs.schema

    def good(it):
        import pyarrow as pa

        for batch in batches(it):
            x = np.array([statistics(t) for t in as_bytes(batch.column("text"))])
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(good, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
