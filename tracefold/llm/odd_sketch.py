"""MinHash near-duplicates with odd sketches.

A document's word pairs (its single word, if it has one) give ``bands * rows`` MinHash samples. The samples of
each band form a key; documents that share a key are candidates. An odd sketch folds all samples into a bitmap
of ``bits`` bits, sample i flipping one bit that depends on i and the sample. Samples that two documents have in
common cancel out in the exclusive or of their bitmaps, so that its population count o estimates
the similarity as 1 + bits / (4 samples) ln(1 - 2 o / bits), the more precisely the higher it is.

Scale: one shuffle by document signature puts exact repeats of a sample set together, so only one of them takes
part further; one shuffle by band key carries (key, id, bitmap), 80 bytes for each band of a document. Within a
key the verified graph is explored from one unassigned member at a time, and only its spanning tree is
emitted, so that a key shared by m copies costs about m comparisons and m - 1 edges, with no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import connected, fresh, written

BANDS, ROWS, BITS, THRESHOLD = 25, 5, 512, 0.7
_NONE = np.uint32(0xFFFFFFFF)


def samples(col, count: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its range, the MinHash samples (rows x count, uint32), and which rows have a token."""
    mult = (tv.seeds(count, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    plus = (tv.seeds(count, 13) >> np.uint64(32)).astype(np.uint32)
    for t in tv.tokens(col):
        h, at = tv.grams(t, 2)
        one = np.flatnonzero(t.counts == 1)
        if len(one):
            order = np.argsort(np.concatenate([at, t.first[one]]), kind="stable")
            h, at = np.concatenate([h, t.hash[t.first[one]]])[order], np.concatenate([at, t.first[one]])[order]
        first = np.searchsorted(at, t.first)
        x = (h >> np.uint64(32)).astype(np.uint32)
        out = np.empty((t.hi - t.lo, count), np.uint32)
        for k in range(count):
            out[:, k] = tv.segment_min(x * mult[k] + plus[k], first, _NONE)
        yield t.lo, t.hi, out, t.counts > 0


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (rows x bits / 8, uint8)."""
    n, count = sample.shape
    where = tv.mix(sample.astype(np.uint64) + (np.arange(count, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + where.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1)


def estimate(odd: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The similarity that an odd population count stands for; 0 where it is too large to tell."""
    return np.maximum(0.0, 1 + bits / (4 * count) * np.log(np.maximum(1e-9, 1 - 2 * odd / bits)))


def most_odd(threshold: float, bits: int, count: int) -> int:
    """The largest population count that still means a similarity of at least ``threshold``."""
    odd = np.arange(bits // 2)
    return int(odd[estimate(odd, bits, count) >= threshold].max())


def tree(ids: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A spanning tree (a, b, popcount) of each connected part of the graph of pairs within ``most`` of each other."""
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            d = np.zeros(len(left), np.int64)
            for k in range(words.shape[1]):
                d += np.bitwise_count(words[left, k] ^ words[u, k])
            near = d <= most
            if near.any():
                v = left[near]
                yield np.full(len(v), ids[u]), ids[v], d[near]
                queue.extend(v)
                left = left[~near]


def _edges(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []  # the last key's rows, which may go on in the next batch

        def emit(ids: np.ndarray, sketch: np.ndarray) -> list[tuple]:
            _, one = np.unique(ids, return_index=True)
            return list(tree(ids[one], np.frombuffer(np.ascontiguousarray(sketch[one]).tobytes(), np.uint64).reshape(len(one), -1), most)) if len(one) > 1 else []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0), pa.int64() if i < 2 else pa.int32()) for i in range(3)], ["a", "b", "odd"])

        def close() -> list[tuple]:
            return emit(*(np.concatenate([x[i] for x in parts]) for i in range(2))) if parts else []

        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            end = np.append(start[1:], len(key))
            if key[0] == open_key:
                parts.append((ids[: end[0]], sketch[: end[0]]))
                if len(start) == 1:
                    continue
                start, end = start[1:], end[1:]
            out = close()
            for s, e in zip(start[:-1], end[:-1]):
                if e - s > 1:
                    out.extend(emit(ids[s:e], sketch[s:e]))
            open_key, parts = key[-1], [(ids[start[-1] :], sketch[start[-1] :])]
            if out:
                yield batch(out)
        yield batch(close())

    return run


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, sig, sketch, keys) of each document with a token; reads doc_id and text."""
    count = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, s, some in samples(b.column(1), count):
                at = np.flatnonzero(some)
                s = s[at]
                sketch = odd_sketch(s, bits)
                wide = s.astype(np.uint64)
                sig = tv.fold(wide, 1).view(np.int64)
                keys = np.stack([tv.fold(wide[:, k * rows : (k + 1) * rows], 100 + k) for k in range(bands)], 1).view(np.int64) if len(at) else np.zeros((0, bands), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(at)), pa.array(sig), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bands, pa.int32()), pa.array(keys.ravel()))],
                    ["doc_id", "sig", "sketch", "keys"],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig long, sketch binary, keys array<long>")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Groups of near-duplicates: rows (doc_id, dup_of, similarity) for every document that has a lesser one in its group.

    Reads doc_id and text. dup_of is the least doc_id of the group of documents connected by verified pairs;
    similarity is the estimate for the closest verified pair that the document is the greater part of, null where
    that pair is only reached through others. Null doc_ids and documents without a token (null, empty, punctuation
    only) are in no group. A pair counts as verified from an estimate of ``threshold`` on, which takes pairs of a true
    similarity of 0.70 in half of all cases, of 0.75 in 87 % and of 0.80 in 99 %. Rows that repeat a doc_id with the same text count once; with other texts, the document
    is in the groups of each. Ties and copies fall to the least doc_id. An empty table gives no rows.
    """
    most = most_odd(threshold, bits, bands * rows)
    sigs, _ = written(signatures(docs, bands, rows, bits), "signatures")
    heads = sigs.groupBy("sig").agg(F.min("doc_id").alias("head"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    copies = sigs.select("doc_id", "sig").join(sigs.groupBy("sig").agg(F.min("doc_id").alias("head")), "sig").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("odd"))
    by_key = heads.select(F.explode("keys").alias("key"), "head", "sketch").repartition("key").sortWithinPartitions("key")
    found = by_key.mapInArrow(_edges(most), "a long, b long, odd int")
    edges, _ = written(copies.unionByName(found).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("odd").alias("odd")), "pairs")
    near = edges.groupBy(F.col("b").alias("node")).agg(F.min("odd").alias("odd"))
    groups = connected(edges.select("a", "b")).where("node <> root")
    o = F.lit(2.0) * F.col("odd") / F.lit(bits)
    value = F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(bits / (4.0 * bands * rows)) * F.log(F.lit(1.0) - o))
    return groups.join(near, "node", "left").select(F.col("node").alias("doc_id"), F.col("root").alias("dup_of"), F.round(value, 6).alias("similarity"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of a lesser doc_id; rows without a doc_id stay, and so do repeats of a row that is kept."""
    (own,) = fresh(docs.columns, "gone")
    gone = near_duplicates(docs, **params).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[own], "left_anti")
