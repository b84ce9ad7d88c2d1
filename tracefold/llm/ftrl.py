"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and their stems (first six bytes), word pairs and pairs with one word left out,
hashed to 2^18. A feature's value is its inverse document frequency in the sample, log(N / df) / log(N), and 0 if it
is in under three documents; it is folded into the weight. Every coordinate has its own learning rate; the L1
term leaves most weights exactly zero, so that the model is the few pairs (index, weight) that aren't, a table of
a size that doesn't depend on the data (at most 2^18 entries, 3 MB).

The model is fitted in one task on at most ``sample`` labelled documents, those of least hashed doc_id. All
documents are then scored in one narrow scan without a shuffle, their whole texts in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import written

BUCKETS, SAMPLE, EPOCHS, ALPHA, BETA, L1, L2, THRESHOLD, LEAST_DOCS = 1 << 18, 12_000, 5, 2.0, 1.0, 8.0, 0.0, 0.35, 3


def features(t: tv.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first token) of each feature of a chunk, repeats included."""
    each = np.arange(len(t.hash))
    out = [(tv.mix(t.hash + np.uint64(1)), each), (tv.mix(t.stems(6) + np.uint64(2)), each), tv.grams(t, 2), tv.grams(t, 2, 1)]
    return np.concatenate([(h >> np.uint64(46)).astype(np.int64) for h, _ in out]), np.concatenate([a for _, a in out])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in tv.tokens(b.column(1)):
            bucket, at = features(t)
            both = np.unique(t.row[at] * BUCKETS + bucket)
            first = np.searchsorted(both // BUCKETS, np.arange(t.hi - t.lo + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), b.column(2).slice(t.lo, t.hi - t.lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array((both % BUCKETS).astype(np.int32)))], ["doc_id", "y", "x"])


def fit_ftrl(xs: list[np.ndarray], ys: np.ndarray, buckets: int = BUCKETS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights; the last is the bias, which has no penalty."""
    df = np.bincount(np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int64), minlength=buckets)
    value = np.append(np.where(df >= LEAST_DOCS, np.log(len(xs) / np.maximum(df, 1)) / np.log(max(2, len(xs))), 0.0), 1.0)
    xs = [np.append(x[value[x] > 0], buckets) for x in xs]
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    lam = np.append(np.full(buckets, l1), 0.0)

    def weights(x) -> np.ndarray:
        return np.where(np.abs(z[x]) <= lam[x], 0.0, -(z[x] - np.sign(z[x]) * lam[x]) / ((beta + np.sqrt(n[x])) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(xs, ys):
            w, v = weights(x), value[x]
            g = (1 / (1 + np.exp(-np.clip((w * v).sum(), -35, 35))) - y) * v
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - s * w
            n[x] += g * g
    return weights(np.arange(buckets + 1)) * value


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The model: rows (bucket, weight), bucket 2^18 being the bias. A document with labels that differ counts as toxic."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    y = written(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")[0]  # at most ``sample`` rows, which are broadcast
    x = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", "y").mapInArrow(_sets, "doc_id long, y int, x array<int>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=tv.mix(pdf.doc_id.to_numpy().astype(np.uint64))).sort_values(["order", "doc_id"])
        w = fit_ftrl(list(pdf.x), pdf.y.to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "weight": w[at]})

    return written(x.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "bucket long, weight double"), "ftrl")[0]


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) of every document with a doc_id; reads doc_id and text. No text scores as the bias alone."""
    w = np.zeros(BUCKETS + 1)
    rows = model.collect()  # at most BUCKETS + 1
    if not rows:
        w[-1] = -35.0
    for r in rows:
        w[r.bucket] = r.weight
    at, weight, bias = np.flatnonzero(w[:-1]).astype(np.int64), w[np.flatnonzero(w[:-1])], float(w[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS)
        table[at] = weight
        for b in batches:
            for t in tv.tokens(b.column(1)):
                bucket, first = features(t)
                hit = np.flatnonzero(table[bucket])
                both = np.unique(t.row[first[hit]] * BUCKETS + bucket[hit])
                s = bias + np.bincount(both // BUCKETS, table[both % BUCKETS], t.hi - t.lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "score"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that score at least ``threshold``: rows (doc_id, score), the greatest score where a doc_id repeats.

    Reads doc_id and text; doc_id and toxic. Null doc_ids and labels are left out, null and empty texts have no
    feature and score as the bias. Without any labelled document no document is toxic.
    """
    scored = score(docs, train(docs, labels, sample)).where(F.col("score") >= threshold)
    return scored.groupBy("doc_id").agg(F.round(F.max("score"), 9).alias("score"))
