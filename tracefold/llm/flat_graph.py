"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are normalised; equal ones are one node. Nodes are assigned to the nearest of many pivots, which
gives overlapping cluster shards. In each shard every node's nearest others are pruned robustly (a neighbour is left out
if a closer one kept lies ``alpha`` times nearer to it than the node), parts that nothing links are tied to the medoid, and the
adjacency lists of all shards and their reverse edges are united. The united graph is then searched shard by shard: a shard
is loaded with those nodes of other shards to which its lists lead at a similarity near the threshold, and every node of it
is a query: a greedy search from the medoid and from the query's own place, with a beam of ``beam``, that goes on expanding for
as long as it meets nodes within the range. What is found is verified by the exact cosine. Of the pairs of a shard a spanning
forest is given and every node's closest one, so that dense groups don't give all pairs.

Recall is audited against brute force for a sample of queries, half of them nodes that have a partner. Where it is below
``recall`` the search is repeated with twice the beam and one more shard per node, then by exact comparison
within shards; a recall that is still too low is warned of and stands in the result.

Scale: pivots are one node in ``shard`` by hash, so that shards stay of one size as the data grow and dense clusters have many
pivots; a shard that comes out over four times as large is cut again by pivots of its own, overlapping too. Pivots sent to
all tasks are of at most ``pivot_bytes``; where all would be more there are two levels: cells by fewer pivots, and in
each cell, its pivots first in the stream, the pivots of the shards. Large cells are split by a salt. Vectors are shuffled
once for each shard they belong to and pass, adjacency lists are ids. The audit's queries are a fixed number.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import connected, remove, written

THRESHOLD, SHARD, OVERLAP, DEGREE, ALPHA, BEAM, AUDIT, RECALL, PIVOT_BYTES, MARGIN = 0.95, 1000, 2, 24, 1.2, 8, 256, 0.95, 8 << 20, 0.1


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row, nearest first."""
    k = min(k, len(pivots))
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        sim = x[s : s + 1024] @ pivots.T
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable")
        out[s : s + 1024] = np.take_along_axis(top, order, 1)
    return out


def pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust pruning of each row's nearest 3 * degree others; all rows at once, block by block."""
    n, near = len(x), min(len(x) - 1, 3 * degree)
    out: list[np.ndarray] = []
    if near < 1:
        return [np.zeros(0, np.int64)] * n
    for s in range(0, n, 512):
        e = min(n, s + 512)
        sim = x[s:e] @ x.T
        sim[np.arange(e - s), np.arange(s, e)] = -np.inf
        cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sim, cand, 1), axis=1, kind="stable"), 1)
        own = 1 - np.take_along_axis(sim, cand, 1)
        v = x[cand]
        left, picked, count = np.ones(cand.shape, bool), np.zeros(cand.shape, bool), np.zeros(e - s, int)
        for j in range(near):
            take = left[:, j] & (count < degree)
            picked[take, j] = True
            count[take] += 1
            gap = 1 - np.einsum("bd,bnd->bn", v[:, j], v)
            left &= ~(take[:, None] & (alpha * gap <= own))
        out.extend(c[p] for c, p in zip(cand, picked))
    return out


def shards_of(x: np.ndarray, most: int, overlap: int, salt: int = 0) -> list[np.ndarray]:
    """Overlapping parts of at most ``most`` rows, if the rows can be told apart."""
    if len(x) <= most:
        return [np.arange(len(x))]
    if salt > 8:  # pivots don't tell them apart: parts by rank along the axis on which they differ most, each with half of the next
        order = np.argsort(x[:, x.std(0).argmax()], kind="stable")
        return [np.sort(order[k : k + most]) for k in range(0, max(1, len(x) - most // 2), most // 2)]
    count = 2 * -(-len(x) // most) + 1
    pick = np.argsort(tv.mix(np.arange(len(x), dtype=np.uint64) + np.uint64(salt * 7919)))[:count]
    near = nearest(x, x[pick], overlap)
    out = []
    for k in range(count):
        own = np.flatnonzero((near == k).any(1))
        if len(own) == len(x):
            return shards_of(x, most, overlap, 9)
        if len(own):
            out.extend(own[p] for p in shards_of(x[own], most, overlap, salt + 1))
    return out


def parts_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is linked to by edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(x: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The edges of adjacency lists, and one from the medoid to the first row of each part that they leave by itself."""
    a, b = np.repeat(np.arange(len(x)), [len(o) for o in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    medoid = int(np.argmax(x @ x.mean(0))) if len(x) else 0
    label = parts_of(len(x), a, b)
    lone = np.setdiff1d(label, label[medoid : medoid + 1])
    return np.concatenate([a, np.full(len(lone), medoid)]), np.concatenate([b, lone])


def search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) rows within the range: greedy from the medoid and the query's own place, expanding on while it meets such nodes.

    ``adjacency`` is a matrix of row numbers filled up with -1.
    """
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(0)))
    qs, found = [], []
    for s in range(0, len(queries), 512):
        q = queries[s : s + 512]
        m = len(q)
        sim = np.full((m, n), -np.inf, np.float32)
        todo = np.full((m, n), -np.inf, np.float32)
        each = np.arange(m)
        sim[:, medoid] = todo[:, medoid] = x[q] @ x[medoid]
        sim[each, q] = todo[each, q] = np.einsum("ij,ij->i", x[q], x[q])
        best = np.full((m, beam), -np.inf, np.float32)
        best[:, 0] = sim[:, medoid]
        live = each
        while len(live):
            at = todo[live].argmax(1)
            value = todo[live, at]
            go = (value > -np.inf) & ((value >= best[live, -1]) | (value >= threshold))
            live, at = live[go], at[go]
            if not len(live):
                break
            todo[live, at] = -np.inf
            next_ = adjacency[at]
            r = np.repeat(live, next_.shape[1])
            c = next_.ravel()
            ok = c >= 0
            r, c = r[ok], c[ok]
            new = sim[r, c] == -np.inf
            r, c = r[new], c[new]
            both = np.unique(r.astype(np.int64) * n + c)
            r, c = both // n, both % n
            v = np.einsum("ij,ij->i", x[q[r]], x[c])
            sim[r, c] = todo[r, c] = v
            merged = np.full((len(live), beam + next_.shape[1]), -np.inf, np.float32)
            merged[:, :beam] = best[live]
            row = np.searchsorted(live, r)
            slot = np.arange(len(r)) - np.searchsorted(r, r, "left")
            merged[row, beam + slot] = v
            best[live] = -np.partition(-merged, beam - 1, axis=1)[:, :beam]
            best[live] = -np.sort(-best[live], axis=1)
        a, b = np.nonzero(sim >= threshold)
        qs.append(q[a])
        found.append(b)
    return np.concatenate([*qs, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])


def forest(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Which of the pairs make up a spanning forest, together with the closest pair of every row. Pairs are without repeats."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    order = np.argsort(-cosine, kind="stable")
    keep, best = np.zeros(len(a), bool), np.full(len(nodes), len(a))
    np.minimum.at(best, a[order], np.arange(len(a)))
    np.minimum.at(best, b[order], np.arange(len(a)))
    keep[order[best]] = True
    label = parts_of(len(nodes), a[keep], b[keep])
    while True:  # each round joins every part to another one, if any pair does
        out = np.flatnonzero(label[a] != label[b])
        if not len(out):
            return keep
        _, first = np.unique(label[a[out]], return_index=True)
        _, other = np.unique(label[b[out]], return_index=True)
        keep[out[first]] = keep[out[other]] = True
        label = parts_of(len(nodes), a[keep], b[keep])


def _nodes(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, v): unit vectors of ``width`` numbers, zero vectors left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(np.nan_to_num(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(b.num_rows, -1))
                ok = np.flatnonzero(np.abs(x).sum(1) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array([r.tobytes() for r in x[ok]], pa.binary())], ["vec_id", "v"])

    return _rows(vectors).where(F.size("embedding") == width).mapInArrow(run, "vec_id long, v binary")


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _floats(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(len(col), -1)


def _assigned(ids: pa.Array, v: pa.Array, near: np.ndarray, name: str, first: int = 0) -> pa.RecordBatch:
    """A row for each of a vector's pivots; rank 0 is the nearest."""
    k = near.shape[1]
    at = pa.array(np.repeat(np.arange(len(near)), k))
    return pa.RecordBatch.from_arrays([pa.array(near.ravel() + first), pa.array(np.tile(np.arange(k, dtype=np.int32), len(near))), ids.take(at), v.take(at)], [name, "rank", "node", "v"])


def _pivots(nodes: DataFrame, count: int, n: int) -> np.ndarray | None:
    """About ``count`` of n nodes, by hash."""
    rows = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // count))) == 0).orderBy("node").select("v").collect()
    return _floats([r.v for r in rows]) if rows else None


def _by_pivots(nodes: DataFrame, pivots: np.ndarray | None, overlap: int, name: str) -> DataFrame:
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _floats(b.column(1).to_pylist())
                near = nearest(x, sent.value, overlap) if sent.value is not None else np.zeros((len(x), 1), np.int64)
                yield _assigned(b.column(0), b.column(1), near, name)

    return nodes.select("node", "v").mapInArrow(assign, f"{name} long, rank int, node long, v binary")


def place(nodes: DataFrame, shard: int, overlap: int, pivot_bytes: int) -> DataFrame:
    """(shard, node, v): each node in its nearest shards."""
    n = nodes.count()
    width = len(nodes.select("v").first().v) if n else 4
    wanted = max(1, n // shard)
    if wanted * width <= pivot_bytes:
        return _by_pivots(nodes, _pivots(nodes, wanted, n), overlap, "shard").select("shard", "node", "v")
    cells, _ = written(_by_pivots(nodes, _pivots(nodes, max(2, min(int(wanted**0.5) + 1, pivot_bytes // width)), n), overlap, "cell"), "cells")
    is_pivot = F.pmod(F.xxhash64("node"), F.lit(shard)) == 1
    salts = cells.groupBy("cell").agg(F.ceil(F.count("*") / (64 * shard)).cast("int").alias("salts"))
    salted = cells.join(salts, "cell")
    rows = salted.select("cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "rank", "node", "v")
    first = salted.where(is_pivot).select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "rank", "node", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, x = None, [], None
        for b in batches:
            cell, salt, kind, rank, node = (b.column(i).to_numpy() for i in range(5))
            group = cell * 4096 + salt
            for s, e in zip(start := np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))) if len(group) else [], np.append(start[1:], len(group)) if len(group) else []):
                if group[s] != now:
                    now, pivots, x = group[s], [], None
                if kind[s] == 0:
                    pivots.append((_floats(b.column(5).slice(s, e - s).to_pylist()), node[s:e]))
                    continue
                if x is None and pivots:
                    x, names = np.concatenate([v for v, _ in pivots]), np.concatenate([k for _, k in pivots])
                own = _floats(b.column(5).slice(s, e - s).to_pylist())
                near = names[nearest(own, x, overlap)] if x is not None else np.full((e - s, 1), cell[s])
                rb = _assigned(b.column(4).slice(s, e - s), b.column(5).slice(s, e - s), near, "shard")
                use = (rb.column(1).to_numpy() == 0) | (np.repeat(rank[s:e], near.shape[1]) == 0)
                yield rb.filter(pa.array(use)).select(["shard", "node", "v"])

    placed = rows.unionByName(first).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "node").mapInArrow(run, "shard long, node long, v binary")
    return placed.dropDuplicates(["shard", "node"])


def graph_pairs(nodes: DataFrame, threshold: float, shard: int, overlap: int, beam: int, pivot_bytes: int = PIVOT_BYTES, exact: bool = False) -> DataFrame:
    """Verified pairs (a, b, cosine), a < b, of nodes (node, v) that span the groups; ``exact``: by comparison of all within shards."""
    spark = nodes.sparkSession
    placed, placed_at = written(place(nodes, shard, overlap, pivot_bytes), "placed")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x, ids = _floats(pdf.v), pdf.node.to_numpy()
        out = []
        for own in shards_of(x, 4 * shard, overlap):
            a, b = linked(x[own], pruned(x[own]))
            close = np.einsum("ij,ij->i", x[own[a]], x[own[b]]) >= threshold - MARGIN
            out += [(ids[own[a]], ids[own[b]], close), (ids[own[b]], ids[own[a]], close)]
        return pd.DataFrame({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("node", "other", "close"))}).drop_duplicates()

    edges = placed.groupBy("shard").applyInPandas(build, "node long, other long, close boolean")
    flat, flat_at = written(edges.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("others"), F.collect_set(F.when(F.col("close"), F.col("other"))).alias("close")), "graph")
    leads = placed.join(flat, "node").select("shard", F.explode("close").alias("node")).distinct().join(placed.select("shard", "node"), ["shard", "node"], "left_anti")
    ends = leads.join(nodes.select("node", "v"), "node").select("shard", "node", "v", F.lit(False).alias("own"))
    loaded = placed.select("shard", "node", "v", F.lit(True).alias("own")).unionByName(ends).join(flat.select("node", "others"), "node", "left")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        x_all, ids_all, own_all = _floats(pdf.v), pdf.node.to_numpy(), pdf.own.to_numpy()
        out = []
        for part in shards_of(x_all, 4 * shard, overlap):
            x, ids = x_all[part], ids_all[part]
            queries = np.flatnonzero(own_all[part])
            if exact:
                hits = [np.nonzero(x[queries[s : s + 512]] @ x.T >= threshold - 1e-4) for s in range(0, len(queries), 512)]
                q, f = (np.concatenate([*([queries[s * 512 + h[0]] for s, h in enumerate(hits)] if k == 0 else [h[1] for h in hits]), np.zeros(0, np.int64)]) for k in range(2))
            else:
                lists = [np.asarray(o if o is not None else [], np.int64) for o in pdf.others.to_numpy()[part]]
                size = np.array([len(o) for o in lists])
                flat_ids, row = np.concatenate([*lists, np.zeros(0, np.int64)]), np.repeat(np.arange(len(ids)), size)
                at = np.minimum(np.searchsorted(ids, flat_ids), len(ids) - 1)
                here = ids[at] == flat_ids
                at, row = at[here], row[here]
                adjacency = np.full((len(ids), max(1, int(np.bincount(row, minlength=1).max()))), -1, np.int64)
                adjacency[row, np.arange(len(row)) - np.searchsorted(row, row)] = at
                q, f = search(x, adjacency, queries, beam, threshold - 1e-4)
            a, b = np.minimum(q, f), np.maximum(q, f)
            both = np.unique(a[a < b] * len(ids) + b[a < b])
            a, b = both // len(ids), both % len(ids)
            cosine = np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 100_000]].astype(np.float64), x[b[s : s + 100_000]].astype(np.float64)) for s in range(0, len(a), 100_000)] or [np.zeros(0)])
            good = cosine >= threshold
            a, b, cosine = a[good], b[good], cosine[good]
            some = forest(a, b, cosine) if len(a) else np.zeros(0, bool)
            out.append(pd.DataFrame({"a": ids[a[some]], "b": ids[b[some]], "cosine": cosine[some]}))
        return pd.concat(out).drop_duplicates(["a", "b"])

    found, _ = written(loaded.groupBy("shard").applyInPandas(find, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "pairs")
    remove(spark, placed_at)
    remove(spark, flat_at)
    return found


def audit(nodes: DataFrame, groups: DataFrame, threshold: float, queries: int) -> float:
    """The share of the true pairs of sampled queries that are in one group (node, root); half of the queries, by hash, are nodes that have one."""
    by_hash = (F.xxhash64("node"), "node")
    some = nodes.join(groups.select("node"), "node", "left_semi").orderBy(*by_hash).limit(queries // 2)
    sample = nodes.orderBy(*by_hash).limit(queries - queries // 2).select("node", "v").unionByName(some.select("node", "v")).distinct().collect()
    if not sample:
        return 1.0
    ids, q = np.array([r.node for r in sample]), _floats([r.v for r in sample])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, other = _floats(b.column(1).to_pylist()), b.column(0).to_numpy()
                i, j = np.nonzero((q.astype(np.float64) @ x.T.astype(np.float64)) >= threshold)
                ok = ids[i] != other[j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][ok]), pa.array(other[j][ok])], ["a", "b"])

    true = nodes.select("node", "v").mapInArrow(brute, "a long, b long")
    ra, rb = (groups.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
    row = true.join(ra, "a", "left").join(rb, "b", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("ra") == F.col("rb"), 1)).alias("hit")).first()
    return row.hit / row.n if row.n else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL, audit_queries: int = AUDIT, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """Rows (vec_id, dup_of, cosine, recall) for every vector that has a lesser one in its group.

    Reads vec_id and embedding. dup_of is the least vec_id of the group connected by verified pairs of cosine at
    least ``threshold``; cosine is the greatest to any other vector found near it; recall is the audited share of true pairs
    that are in one group. Null vec_ids, null, empty and zero vectors are in no group; vectors of different lengths are compared
    with their like only; nulls and NaNs inside a vector count as 0. Repeated rows count once; a vec_id with several vectors
    is in the groups of each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    edges, worst = None, 1.0
    for width in sorted(r.w for r in _rows(vectors).groupBy(F.size("embedding").alias("w")).count().where("count > 1").collect()):
        all_vecs, _ = written(_nodes(vectors, width).distinct(), "vectors")
        keyed = all_vecs.withColumn("key", F.sha2("v", 256))
        nodes, _ = written(keyed.groupBy("key").agg(F.min("vec_id").alias("least"), F.first("v").alias("v")), "nodes")
        # a vec_id may have several vectors, so that nodes get numbers of their own
        nodes = nodes.withColumn("node", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
        for beam_, overlap_, exact in ((beam, overlap, False), (2 * beam, overlap + 1, False), (beam, overlap + 2, True)):
            pairs = graph_pairs(nodes, threshold, shard, overlap_, beam_, pivot_bytes, exact)
            got = audit(nodes, connected(pairs.select("a", "b")), threshold, audit_queries)
            if got >= recall:
                break
        else:
            warnings.warn(f"audited recall {got:.3f} of vectors of length {width} is below {recall}", stacklevel=2)
        worst = min(worst, got)
        least = nodes.select("node", "least", "key")
        copies = keyed.join(least, "key").where("vec_id <> least").select(F.col("least").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("cosine"))
        near = pairs.join(least.select(F.col("node").alias("a"), F.col("least").alias("la")), "a").join(least.select(F.col("node").alias("b"), F.col("least").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"), "cosine")
        both = copies.unionByName(near).where("a <> b")
        edges = both if edges is None else edges.unionByName(both)
    if edges is None:
        return spark.createDataFrame([], "vec_id long, dup_of long, cosine double, recall double")
    edges, _ = written(edges, "edges")
    top = edges.select(F.col("a").alias("node"), "cosine").unionByName(edges.select(F.col("b").alias("node"), "cosine")).groupBy("node").agg(F.max("cosine").alias("cosine"))
    groups = connected(edges.select("a", "b")).where("node <> root")
    return groups.join(top, "node").select(F.col("node").alias("vec_id"), F.col("root").alias("dup_of"), F.round("cosine", 6).alias("cosine"), F.lit(round(worst, 6)).alias("recall"))
