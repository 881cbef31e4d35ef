"""Quality classifier: regularised quadratic discriminant analysis.

Per-document statistics are transformed (logarithms of lengths, logits of
rates) and clipped to a central range, so that a Gaussian per class is a fair
description.  Class means and covariances come from sums that executors
accumulate over all labelled training rows; covariances are shrunk towards the
pooled one and its mean variance.  A document's score is the posterior from the
difference of Mahalanobis log densities, computed with each class's cached
Cholesky factor.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.boosting import sigmoid
from evergrove.llm.common import checkpointed, crc_fold, whole_text

NAMES = (
    "mean word length", "long words", "upper case", "digits", "marks", "marks at word ends", "bars", "sentence ends",
    "distinct words", "distinct word pairs", "most frequent word", "repeated lines", "one-letter words", "line breaks",
)
D = len(NAMES)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-;:()?"]


#: Usual rates, towards which the rates of short texts are drawn,
#: as if PRIOR more words (or marks, or lines) at that rate had been seen.
PRIOR = 12.0
RATES = {"long": 0.002, "upper": 0.03, "digit": 0.002, "mark": 0.002, "end": 0.002, "bar": 0.002, "stop": 0.1, "pair": 0.97, "top": 0.06, "line": 0.01, "single": 0.03, "break": 0.03}


def _logit(part: float, whole: float, kind: str) -> float:
    p = (part + PRIOR * RATES[kind]) / (whole + PRIOR)
    return float(np.log(p / (1.0 - p))) if p < 1 else 8.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text, in the order of NAMES."""
    words = text.split()
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), len(raw) - int(counts[32]) - int(counts[10])
    letters = int(counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum())
    lines = [line for line in text.split("\n") if line]
    top = Counter(words).most_common(1)[0][1] if n else 0
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    ends = sum(1 for w in words if w[-1] in "#$%&*!|~^=+<>@")
    return [
        float(np.log((size + PRIOR * 5) / (n + PRIOR))),
        _logit(sum(1 for w in words if len(w) > 24), n, "long"),
        _logit(int(counts[_UPPER].sum()), letters, "upper"),
        _logit(int(counts[_DIGIT].sum()), size, "digit"),
        _logit(int(counts[_MARKS].sum()), size, "mark"),
        _logit(ends, n, "end"),
        _logit(min(int(counts[124]), n), n, "bar"),
        _logit(min(int(counts[46]), n), n, "stop"),
        # a text repeats words the more the longer it is: compare with a power law
        float(np.log((distinct + PRIOR) / (n + PRIOR) ** 0.85)),
        _logit(pairs, max(n - 1, 0), "pair"),
        _logit(max(top - 1, 0), n, "top"),
        _logit(len(lines) - len(set(lines)), len(lines), "line"),
        _logit(sum(1 for w in words if len(w) == 1), n, "single"),
        _logit(min(int(counts[10]), n), n, "break"),
    ]


def _measure(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            x = [statistics(text) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], schema=schema)


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, x): every text's MD5 and its statistics."""
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, digest string, x array<double>")


@dataclass
class Quadratic:
    low: np.ndarray
    high: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverted Cholesky factors of the two covariances, made once
    offsets: list[float]  # log prior minus half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = factor @ (x - mean).T
            density.append(offset - 0.5 * (z * z).sum(axis=0))
        return sigmoid(density[1] - density[0])


def _summed(low: list[float], high: list[float]):
    """Per task and class: rows, sums and products, as (class, place, value)."""

    def run(batches):
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.array(batch.column(0).to_pylist())
            x = np.clip(np.array(batch.column(1).to_pylist(), dtype=float), low, high)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                own = x[label == c]
                totals[c] = totals.get(c, 0) + own.T @ own
        schema = pa.schema([("label", pa.int32()), ("place", pa.int32()), ("value", pa.float64())])
        for c, products in totals.items():
            flat = np.asarray(products).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(flat), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], schema=schema)

    return run


def fit_quadratic(training: DataFrame, to_pooled: float = 0.25, to_mean: float = 0.05, clip: float = 0.002) -> Quadratic:
    """Fit on all rows of ``training`` (label 0/1, x).

    Covariances move by ``to_pooled`` towards the pooled one, and by ``to_mean``
    towards its mean variance; values beyond the ``clip`` quantiles count as
    those.  A class without rows gets the pooled moments and half a row."""
    limits = training.agg(*[F.percentile_approx(F.get("x", F.lit(k)), [clip, 1 - clip], 1000).alias(str(k)) for k in range(D)]).first()
    bounds = [limits[str(k)] or (-1.0, 1.0) for k in range(D)]
    low, high = [b[0] for b in bounds], [b[1] for b in bounds]
    sums = training.select("label", "x").mapInArrow(_summed(low, high), "label int, place int, value double")
    total = np.zeros((2, (D + 1) ** 2))
    for row in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # 2 * (D + 1)^2 numbers
        total[row["label"], row["place"]] = row["value"]
    total = total.reshape(2, D + 1, D + 1)

    def moments(s):
        n = max(s[0, 0], 1e-9)
        mean = s[0, 1:] / n
        return mean, s[1:, 1:] / n - np.outer(mean, mean)

    pooled_mean, _ = moments(total.sum(axis=0))
    within = sum(total[c, 0, 0] * moments(total[c])[1] for c in (0, 1)) / max(total[:, 0, 0].sum(), 1.0)
    floor = np.eye(D) * max(np.trace(within) / D, 1e-3)
    means, factors, offsets = [], [], []
    for c in (0, 1):
        n = total[c, 0, 0]
        mean, own = moments(total[c]) if n else (pooled_mean, within)
        shrunk = (1 - to_mean) * ((1 - to_pooled) * own + to_pooled * within) + to_mean * floor
        factor = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(np.linalg.inv(factor))
        offsets.append(float(np.log(n + 0.5) - np.log(np.diag(factor)).sum()))
    return Quadratic(np.array(low), np.array(high), means, factors, offsets)


def _scorer(model: Quadratic):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(2).to_pylist(), dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], schema=schema)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted and
    ``digest``, the text's MD5: a score is the text's alone, so id and digest find
    its rows again, null and repeated ids included.

    Only labelled rows outside the held-out fold (crc32 of the id's text modulo
    ``folds``) teach the classes.  Null text counts as empty; empty texts have
    statistics and so a score.  Labels other than 0 and 1 are ignored; without
    labels every score is 1/2.  Repeated rows give repeated rows.  Other columns
    are ignored.
    """
    stats = checkpointed(document_statistics(docs, id_column, text_column))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("label"))
    known = known.where(crc_fold("labelled", folds) != held_out)
    training = stats.join(known, F.col("doc_id") == F.col("labelled")).select("label", "x")
    scored = stats.mapInArrow(_scorer(fit_quadratic(training)), "doc_id long, digest string, score double")
    return scored.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "digest")
