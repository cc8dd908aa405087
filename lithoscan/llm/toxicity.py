"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

A document is the set of its hashed character n-grams.  Over a bounded sample
of the labelled training documents the presence counts of each n-gram per class
give its naive Bayes log-count ratio; n-grams whose counts differ no more than
chance would make them are left at zero.  A logistic regression over the presence of the
others, scaled by their ratios, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, text_or_empty

ORDERS, BITS = (3, 4, 5, 6), 20
#: Labels the model is fitted on at most: those of the lowest hashes of their id.
MAX_FIT_ROWS = 10_000


def ngram_buckets(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the lower-cased text, with repeats.
    White space of any kind is one blank, and one stands at either end."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out, h = [], chars
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append(x >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


@dataclass
class ToxicityModel:
    """``buckets`` sorted; ``ratios`` their log-count ratios; ``weights`` the
    regression's, before scaling."""

    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.buckets] = self.ratios * self.weights
        used = table != 0

        def score(text: str) -> float:
            found = ngram_buckets(text)
            found = np.unique(found[used[found]])
            return float(1 / (1 + np.exp(-(self.bias + table[found].sum(dtype=np.float64)))))

        return score


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        for toxic, text in zip(batch.column("_toxic").to_pylist(), batch.column("_text"), strict=True):
            counts[toxic, np.unique(ngram_buckets(text.as_py()))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array(counts[0, at], pa.int64()), pa.array(counts[1, at], pa.int64())],
        names=["bucket", "clean", "toxic"],
    )


def _chosen(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            found = []
            for text in batch.column("_text"):
                own = place[ngram_buckets(text.as_py())]
                found.append(np.unique(own[own >= 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_toxic"), pa.array(found, pa.list_(pa.int32()))], names=["_toxic", "_found"]
            )

    return run


def _fit(doc: np.ndarray, col: np.ndarray, labels: np.ndarray, ratios: np.ndarray, l2: float, rounds: int):
    """Logistic regression over scaled presence, by accelerated gradient steps.
    Document ``doc[i]`` holds n-gram ``col[i]``."""
    rows = labels
    scale = ratios[col]
    # The steepest curvature, by power iteration on the scaled presence matrix.
    v = np.random.default_rng(0).normal(size=len(ratios))
    norm = 1.0
    for _ in range(12 if len(doc) else 0):
        v = np.bincount(col, scale * np.bincount(doc, scale * v[col], len(rows))[doc], len(ratios))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (0.3 * norm / max(1, len(rows)) + l2 + 0.25)
    prior = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    w = look = np.zeros(len(ratios))
    b = look_b = float(np.log(prior / (1 - prior)))
    for k in range(1, rounds + 1):
        z = look_b + np.bincount(doc, scale * look[col], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / max(1, len(rows))
        gradient = np.bincount(col, scale * error[doc], len(ratios)) + l2 * look
        new_w, new_b = look - step * gradient, look_b - step * error.sum()
        momentum = (k - 1) / (k + 2)
        look, look_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w, b


def train_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_fit_rows: int = MAX_FIT_ROWS,
    least_deviation: float = 4.0,
    l2: float = 1e-5,
    rounds: int = 200,
) -> ToxicityModel:
    """Train on the labelled rows of ``df`` (null labels and ids are left out;
    of repeated labels the larger holds; any label but 0 is toxic).

    ``max_fit_rows`` labels of these rows at most are used, chosen by the hash of their id;
    that bounds what is broadcast, so texts are never shuffled for training.

    Where one class has no row, every text gets the score of the other: nearly 1
    if all are toxic, else nearly 0, also where there are no labels at all."""
    prepare(df.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).cast("long").alias("_id")).agg(
        F.max((F.col(label_col) != 0).cast("int")).alias("_toxic")
    )
    known = df.select(F.col(id_col).cast("long").alias("_id")).where("_id IS NOT NULL")
    marks = marks.join(known, "_id", "left_semi")  # ids only; labels of rows that are not there do not count
    marks = materialize(marks.orderBy(F.xxhash64("_id"), "_id").limit(max_fit_rows), "fit_labels")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.join(F.broadcast(marks), "_id").select("_id", "_toxic", "_text")

    counts = rows.select("_toxic", "_text").mapInArrow(_presence, "bucket long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    per_class = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = per_class.get(0, 0), per_class.get(1, 0)
    if not n_clean or not n_toxic:
        prior = 1 - 1e-3 if n_toxic else 1e-3
        none = np.empty(0)
        return ToxicityModel(none.astype(np.int64), none, none, float(np.log(prior / (1 - prior))))
    # Shares per class, and how many standard deviations they lie apart.
    p, q = F.col("toxic") / F.lit(n_toxic), F.col("clean") / F.lit(n_clean)
    pooled = (F.col("toxic") + F.col("clean") + 1) / F.lit(n_toxic + n_clean + 2)
    spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / n_toxic + 1 / n_clean))
    ratio = F.log((F.col("toxic") + 1) / (n_toxic + 2)) - F.log((F.col("clean") + 1) / (n_clean + 2))
    # At most 2^BITS buckets exist, and few stand out.
    chosen = counts.where(F.abs(p - q) / spread >= least_deviation).select("bucket", ratio.alias("ratio"))
    chosen = sorted((r["bucket"], r["ratio"]) for r in chosen.collect())
    buckets = np.array([b for b, _ in chosen], dtype=np.int64)
    ratios = np.array([r for _, r in chosen])

    fitted = rows.select("_toxic", "_text").mapInArrow(
        _chosen(buckets), "_toxic int, _found array<int>"
    )
    # As many rows as max_fit_rows (but for repeats of an id), of few n-grams each.
    told = fitted.toArrow()
    found = told.column("_found").combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    toxic = told.column("_toxic").to_numpy().astype(float)
    weights, bias = _fit(doc, found.values.to_numpy().astype(np.int64), toxic, ratios, l2, rounds)
    return ToxicityModel(buckets, ratios, weights, bias)


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(scores, pa.float64())], names=["_id", "score"]
            )

    return run


def score_toxicity(
    df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``(id, score, predicted)`` of every row, by its whole text alone; null
    texts count as empty and get the model's score of no n-grams.  Repeated
    rows and null ids are scored like any other; an empty table gives an empty
    result; other columns are not carried."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    scored = rows.mapInArrow(_score(model), "_id long, score double")
    return scored.select(
        F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(
    df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, in their own
    columns.  Null texts count as empty; repeated rows are judged alike; an
    empty table gives an empty result."""
    prepare(df.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in batches:
            yield texts.map(own)

    return df.where(score(F.coalesce(df[text_col].cast("string"), F.lit(""))) < threshold)
