"""Quality classifier by co-training of a text view and a metadata view.

The text view sees the frequencies of characters and the repetition of words; the metadata view sees
the language, the source, and size and layout of the page. Both are logistic regressions, fitted on labelled documents first. In
every round each one labels all documents without a label that it is sure of, if what it is sure of among the documents held out is right,
and the other one learns from these, by a step over labelled and pseudo-labelled documents that never makes their loss greater (the
Hessian's upper bound stands for it); the pseudo-labels of a class weigh no more than its labels, however many they are.
Both are then calibrated (Platt) on labelled documents held out of training, and a last logistic regression
on those weighs the two calibrated views.

Scale: features are made in one narrow scan, have a fixed width (880 bytes a document) and are kept as a table for the rounds. Labels are
a sample of at most ``sample`` documents, those of least hashed doc_id; the pool is everything else. What a round gathers is sums of
a fixed size from each partition, added up on 32 executors' tasks before they go to the driver. The model is some 250 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import kept, written

SAMPLE, ROUNDS, SURE, THRESHOLD, SLOTS, LEAST_HELD = 8192, 4, 0.95, 0.3, 32, 5
LANGS, SOURCES = 16, 64
N_TEXT, N_META = 128 + 8, LANGS + SOURCES + 4


def _one_hot(col: pa.Array, width: int, salt: int) -> np.ndarray:
    out = np.zeros((len(col), width), np.float32)
    codes = pc.dictionary_encode(tv.as_strings(col))
    hashed = np.array([int(tv.tokenised(*tv.raw(pa.array([x], pa.large_string())), 0, 1).hash.sum() % np.uint64(width)) for x in codes.dictionary.to_pylist()] or [0])
    out[np.arange(len(col)), (hashed[codes.indices.to_numpy()] + salt) % width] = 1
    return out


def features(text, lang, source, n_chars) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its range, text view and metadata view (float32)."""
    whole = tv.as_strings(text)
    for lo, hi in tv.chunks(whole):
        part = whole.slice(lo, hi - lo)
        plain, off = tv.raw(part)
        rows = hi - lo
        size = np.maximum(1, np.diff(off)).astype(np.float64)
        row = np.repeat(np.arange(rows), np.diff(off))
        low = plain < 128
        hist = np.bincount(row[low] * 128 + plain[low], minlength=rows * 128).reshape(rows, 128)
        lines = hist[:, 10].copy()
        upper = hist[:, 65:91].sum(1) / size
        t = tv.tokenised(*tv.raw(pc.utf8_lower(part)), lo, hi)
        n = np.maximum(1, t.counts)
        trow = t.row
        order = np.lexsort((t.hash, trow))
        repeat = np.zeros(rows)
        pair = np.zeros(rows)
        if len(t.hash) > 1:
            same = (t.hash[order][1:] == t.hash[order][:-1]) & (trow[order][1:] == trow[order][:-1])
            repeat = np.bincount(trow[order][1:][same], minlength=rows)
            near = (t.hash[1:] == t.hash[:-1]) & (trow[1:] == trow[:-1])
            pair = np.bincount(trow[1:][near], minlength=rows)
        length = np.bincount(trow, t.end - t.start, minlength=rows)
        longest = np.zeros(rows)
        np.maximum.at(longest, trow, t.end - t.start)
        extra = np.stack([upper, repeat / n, pair / n, length / n, longest / 50, length / size, t.counts / size, np.log1p(t.counts)], 1)
        x = np.concatenate([np.log1p(200 * hist / size[:, None]), extra], 1).astype(np.float32)
        said = pc.fill_null(n_chars.slice(lo, rows).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        said = np.where(np.isfinite(said) & (said >= 0), said, size)
        layout = np.stack([np.log1p(said), np.log1p(lines), np.log1p(size / lines.clip(1)), lines / size], 1)
        yield lo, hi, x, np.concatenate([_one_hot(lang.slice(lo, rows), LANGS, 0), _one_hot(source.slice(lo, rows), SOURCES, 0), layout], 1).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and bias, by Newton's method."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class CoTrainer:
    """The two views' weights while they are trained on labelled rows (y is 1 or 0) of which ``held`` are kept for calibration."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> None:
        self.stats, self.bounds = [], [(x.min(0), x.max(0)) for x in views]
        for x in views:
            mean, sd = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
            self.stats.append((mean, np.where(sd > 1e-9, sd, np.inf)))
        self.views, self.y, self.held = [self.scaled(k, x) for k, x in enumerate(views)], y.astype(float), held
        self.ws = [logistic(x[~held], self.y[~held]) for x in self.views]

    def scaled(self, k: int, x: np.ndarray) -> np.ndarray:
        mean, sd = self.stats[k]
        return (np.clip(x, *self.bounds[k]) - mean) / sd

    def sure(self, k: int, p: np.ndarray, label: int) -> np.ndarray:
        """Where a view is sure of a class; nowhere, if that isn't borne out by the labels held out."""
        own = 1 / (1 + np.exp(-logit(self.views[k][self.held], self.ws[k])))
        said = own >= SURE if label else own <= 1 - SURE
        if said.sum() < LEAST_HELD or (self.y[self.held][said] == label).mean() < SURE:
            return np.zeros(len(p), bool)
        return p >= SURE if label else p <= 1 - SURE

    def sums(self, views: list[np.ndarray]) -> np.ndarray:
        """Of pool rows, for each view and class that the other view is sure of: bound of the Hessian, gradient and number, in one vector."""
        xs = [self.scaled(k, x) for k, x in enumerate(views)]
        ps = [1 / (1 + np.exp(-logit(x, w))) for x, w in zip(xs, self.ws)]
        out = []
        for k in range(2):
            for label in (0, 1):
                sure = self.sure(1 - k, ps[1 - k], label)
                x1, p = np.concatenate([xs[k][sure], np.ones((int(sure.sum()), 1))], 1), ps[k][sure]
                out += [(0.25 * x1.T @ x1).ravel(), x1.T @ (p - label), np.array([float(sure.sum())])]
        return np.concatenate(out)

    def step(self, total: np.ndarray, l2: float = 1.0) -> list[list[float]]:
        """A step of each view over its labelled and pseudo-labelled rows; how many pseudo-labels each got, by class."""
        at, counts, new = 0, [], []
        for k in range(2):
            x, y = self.views[k][~self.held], self.y[~self.held]
            x1, n = np.concatenate([x, np.ones((len(x), 1))], 1), x.shape[1] + 1
            p = 1 / (1 + np.exp(-logit(x, self.ws[k])))
            ridge = np.append(np.full(n - 1, l2), 1e-6)
            h, g, own = 0.25 * x1.T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * self.ws[k], []
            for label in (0, 1):
                hess, grad, many = total[at : at + n * n].reshape(n, n), total[at + n * n : at + n * n + n], total[at + n * n + n]
                at += n * n + n + 1
                weight = (y == label).sum() / many if many else 0.0
                h, g = h + min(1.0, weight) * hess, g + min(1.0, weight) * grad
                own.append(float(many))
            new.append(self.ws[k] - np.linalg.solve(h, g))
            counts.append(own)
        self.ws = new
        return counts

    def model(self) -> list[np.ndarray]:
        """[text weights, metadata weights, combination] for plain features, and the least and greatest values that labels cover."""
        y = self.y[self.held]
        raw = [logit(x[self.held], w)[:, None] for x, w in zip(self.views, self.ws)]
        platt = [logistic(r, y, 1e-3) for r in raw]
        both = np.concatenate([logit(r, a)[:, None] for r, a in zip(raw, platt)], 1)
        last = logistic(both, y, 1e-2)
        for k in np.flatnonzero(last[:-1] < 0):  # a view that says nothing mustn't count against itself
            both[:, k] = 0
            last = logistic(both, y, 1e-2)
        out = []
        for w, a, (mean, sd) in zip(self.ws, platt, self.stats):
            plain = np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()) * a[0]
            plain[-1] += a[1]
            out.append(plain)
        return [*out, last, *(np.concatenate(b) for b in zip(*self.bounds))]


_COLS = ("text", "lang", "source", "n_chars")


def _typed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), *more)


def _rows(b: pa.RecordBatch, at: int = 0) -> np.ndarray:
    """The features of a batch, a row a document; its column ``at`` has them as bytes."""
    return np.frombuffer(b"".join(b.column(at).to_pylist()), np.float32).reshape(b.num_rows, N_TEXT + N_META)


def feature_table(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, x, more...) of each row with a doc_id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x, m in features(*(b.column(i) for i in range(1, 5))):
                both = np.concatenate([x, m], 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in both], pa.binary()), *(b.column(i).slice(lo, hi - lo) for i in range(5, b.num_columns))], ["doc_id", "x", *more])

    return _typed(docs, *more).mapInArrow(make, "doc_id long, x binary" + "".join(f", {c} int" for c in more))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, features, labels) of the sample, in order of hashed doc_id; a document with labels that differ is of low quality."""
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("__y"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct().join(y, "__id")
    chosen = written(ids.orderBy(F.xxhash64("__id"), "__id").limit(sample), "chosen")[0]
    keyed = docs.select("doc_id", *_COLS).join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("__id"))  # at most ``sample`` ids
    rows = feature_table(keyed, "__y").dropDuplicates(["doc_id", "x"]).collect()  # at most ``sample`` documents of 880 bytes
    rows.sort(key=lambda r: (int(tv.mix(np.array([r.doc_id]).view(np.uint64))[0]), r.doc_id, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), N_TEXT + N_META)
    return np.array([r.doc_id for r in rows], np.int64), x, np.array([r[2] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, table: DataFrame | None = None) -> tuple[list[np.ndarray], list] | None:
    """(model, numbers of pseudo-labels by round, view and class), or None where labelled documents of both kinds are missing.

    ``table`` is ``feature_table(docs)``, written already, if there is one.
    """
    ids, x, y = labelled(docs, labels, sample)
    held = tv.mix(tv.mix(ids.view(np.uint64))) % np.uint64(4) == 0
    if any(len(set(y[k])) < 2 for k in (held, ~held)):
        return None
    trainer, told, known = CoTrainer([x[:, :N_TEXT], x[:, N_TEXT:]], y, held), [], np.sort(ids)
    if table is None:
        table = written(feature_table(docs), "features")[0]

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], trainer=trainer) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                own = b.column(0).to_numpy()
                free = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] != own
                z = _rows(b, 1)[free]
                now = trainer.sums([z[:, :N_TEXT], z[:, N_TEXT:]])
                total = now if total is None else total + now
            if total is not None:
                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum([np.frombuffer(v) for v in pdf.sums], axis=0).tobytes()]})

        parts = table.select("doc_id", "x").mapInArrow(run, "slot int, sums binary").groupBy("slot").applyInPandas(add, "sums binary").collect()  # at most SLOTS rows
        if not parts:
            break
        told.append(trainer.step(np.sum([np.frombuffer(bytes(r.sums)) for r in parts], axis=0)))
    return trainer.model(), told


def _scores(x: np.ndarray, model: list[np.ndarray] | None) -> list[np.ndarray]:
    """Of the text view, of the metadata view, of both."""
    if model is None:
        return [np.ones(len(x))] * 3
    x = np.clip(x, model[3], model[4])  # a linear view isn't carried on beyond what labels cover
    ls = [logit(x[:, :N_TEXT], model[0]), logit(x[:, N_TEXT:], model[1])]
    return [np.round(1 / (1 + np.exp(-v)), 9) for v in (*ls, logit(np.stack(ls, 1), model[2]))]


def score(table: DataFrame, model: list[np.ndarray] | None) -> DataFrame:
    """(doc_id, text_score, meta_score, score) of every row of a feature table; all 1 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _scores(_rows(b, 1), model))], ["doc_id", "text_score", "meta_score", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text_score, meta_score, score, keep), one for each doc_id.

    Reads doc_id, text, lang, source and n_chars; doc_id and quality. keep is score >= threshold. A null text counts as
    empty, a null or negative n_chars as the text's size in bytes; null languages and sources are values of their own.
    Where rows share a doc_id the one with the greatest score counts. A document with labels that differ is of low
    quality. Without labelled documents of both kinds every score is 1. Null doc_ids are left out.
    """
    table = written(feature_table(docs), "features")[0]
    trained = train(docs, labels, sample, table=table)
    s = score(table, trained and trained[0])
    best = s.groupBy("doc_id").agg(F.max(F.struct("score", "text_score", "meta_score")).alias("b"))
    return best.select("doc_id", "b.text_score", "b.meta_score", "b.score", (F.col("b.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, each judged by itself; rows without a doc_id stay."""
    trained = train(docs, labels, sample)
    model = trained and trained[0]

    def judge(b: pa.RecordBatch) -> np.ndarray:
        cols = [b.column(b.schema.get_field_index(c)) for c in _COLS]
        out = np.ones(b.num_rows, bool)
        if model is not None:
            for lo, hi, x, m in features(*cols):
                out[lo:hi] = _scores(np.concatenate([x, m], 1), model)[2] >= threshold
        return out | b.column(b.schema.get_field_index("doc_id")).is_null().to_numpy(zero_copy_only=False)

    return kept(docs, judge)
