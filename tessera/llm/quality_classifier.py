"""Document quality by regularised quadratic discriminant analysis.

Each whole text gives a vector of transformed statistics (logarithms of lengths and shares). Class
means and covariances come from one aggregate over all labelled training rows; each covariance is
shrunk towards the pooled one and the pooled diagonal, its Cholesky factor is kept, and a
document's score is the logistic function of the difference of the two log densities (Mahalanobis
distances by a triangular solve, log determinants, priors).

Defined cases: a null text is the empty text and is scored like any other; labels other than 0 and 1
and null ids never train; several labels of one id count as one (the smallest); with one class or no
labels the score is the share of label 1 (0.5 without labels); repeated rows are scored one by one;
an empty table gives an empty result.

Scale: one narrow pass over the text; the vectors (about 100 bytes a document) are checkpointed, the
fit is a two-row aggregate with map-side sums over every labelled row, and the scores are narrow.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, slices

FEATURES = ("words", "word_length", "symbols", "marks", "capitals", "digits", "stops", "bars", "variety", "stutter")
SHRINK, RIDGE = 0.1, 0.02
THRESHOLD = 0.3
_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&<>", b"!?", bytes(range(65, 91)), b"0123456789", b".,;:", b"|"), 1):
    _KINDS[list(_chars)] = _k


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id never trains, so it counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def vectors(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per UTF-8 text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        kinds = np.bincount(_KINDS[np.frombuffer(t, np.uint8)], minlength=7) if t else np.zeros(7)
        w = t.split()
        n, chars = len(w), max(1, sum(map(len, w)))
        m = max(1, n)
        share = kinds / chars
        variety = len(set(w)) / m
        stutter = sum(map(eq, w, w[1:])) / m
        out[i] = (np.log1p(n), np.log1p(chars / m), *np.log(share[[1, 2, 3, 4, 5, 6]] + 1e-3), np.log(1.02 - variety) - 0.35 * np.log1p(n),
                  np.log(stutter + 1e-2))
    return out


def _vector_batches(batches):
    for b in slices(batches):
        x = vectors([t.encode() for t in b.column("text").to_pylist()])
        yield pa.record_batch([b.column("doc_id")] + [pa.array(x[:, k]) for k in range(x.shape[1])],
                              names=["doc_id", *(f"x_{f}" for f in FEATURES)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double column x_<feature> per feature."""
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_vector_batches, "doc_id long, " + ", ".join(f"x_{f} double" for f in FEATURES))


def fit(x: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Means, Cholesky factors and log priors of both classes, from sums over all training rows."""
    train = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    cols, d = [f"x_{f}" for f in FEATURES], len(FEATURES)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j <= i]
    rows = {r["y"]: r for r in x.join(train, "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = {y: (rows[y]["n"] if y in rows else 0) for y in (0, 1)}
    if min(n.values()) < 2:
        return {"constant": n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5}
    mean, cov = {}, {}
    for y in (0, 1):
        mean[y] = np.array([rows[y][f"s{i}"] for i in range(d)]) / n[y]
        s = np.array([[rows[y][f"s{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n[y]
        cov[y] = s - np.outer(mean[y], mean[y])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    chol = {y: np.linalg.cholesky((1 - SHRINK) * cov[y] + SHRINK / 2 * (pooled + np.diag(np.diag(pooled))) + RIDGE * np.eye(d)) for y in (0, 1)}
    total = n[0] + n[1]
    return {"mean": mean, "inverse": {y: np.linalg.inv(chol[y]) for y in (0, 1)},
            "offset": {y: float(np.log(n[y] / total) - np.log(np.diag(chol[y])).sum()) for y in (0, 1)}}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of label 1 minus that of label 0, priors included."""
    side = {y: model["offset"][y] - 0.5 * (((x - model["mean"][y]) @ model["inverse"][y].T) ** 2).sum(1) for y in (0, 1)}
    return side[1] - side[0]


def score_vectors(x: DataFrame, model: dict) -> DataFrame:
    """doc_id, score from the statistics."""
    def score(batches):
        for b in batches:
            v = np.stack([b.column(f"x_{f}").to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            s = np.full(len(v), model["constant"]) if "constant" in model else 1 / (1 + np.exp(-np.clip(log_odds(model, v), -500, 500)))
            yield pa.record_batch([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])
    return x.mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    x = checkpoint(statistics(docs))
    return score_vectors(x, fit(x, labels, label)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good; columns as they were.

    Ids need not be unique: the score depends on the text, so the verdict is taken from the text of
    each row itself.
    """
    model = fit(statistics(docs), labels)

    def good(batches):
        for b in slices(batches):
            v = vectors([(t or "").encode() for t in b.column("text").to_pylist()])
            s = np.full(len(v), model["constant"]) if "constant" in model else 1 / (1 + np.exp(-np.clip(log_odds(model, v), -500, 500)))
            yield b.filter(pa.array(s >= threshold))
    return docs.mapInArrow(good, docs.schema)
