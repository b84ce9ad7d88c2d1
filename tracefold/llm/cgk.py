"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item of n tokens leaks into a document when some passage is within a token edit distance of
``floor(max_edit * n)`` of it. The CGK walk reads a token sequence with a pointer that moves on, or doesn't, by
a random bit that depends on the step and the token; the symbols it reads, one a step, form the embedding, in
which a small edit distance is a small Hamming distance with good probability. Every repetition has its own walk
and samples ``sampled`` coordinates, which form an LSH key; items and windows that share a key are candidates, and
each is verified by exact edit distance.

The walk drifts with the number of edits, so that items of over ``PIECE`` tokens are also cut into pieces of like length, which
are matched as items are. Of k edits to an item some piece has at most its own share (else they would be more than k),
so that a piece is within its own limit wherever the item leaks; the whole item is then verified around it.

Windows are as long as the items (items of like length form a class, and a window is walked over the least
length of its class) and may start at each token of a document. Before the walk, windows that no item can match
are passed over: k edits spare at least n - 1 - 2 k of an item's token pairs, so a window (with room for k
insertions) that holds fewer pairs of its class than the least n of the class needs can't match. That count comes
from a table of 2^20 masks, fixed in size whatever the benchmark, which only errs towards keeping a window. Of
neighbouring starts those stay at which the count is as high as at the next one to either side.

Scale: documents are read once, narrow, and nothing but verified matches leaves the scan. The items of a benchmark
(tokens, keys and masks) go to every task; their number is checked, and a benchmark of more than ``most_items``
is matched in several such scans, each with a part of it, so that what is sent stays under about 30 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import kept

MAX_EDIT, REPEATS, SAMPLED, LEAST_TOKENS, TABLE, CLASSES, MOST_ITEMS = 0.2, 40, 3, 4, 1 << 20, 62, 20_000
GRAMS = (2, 3)
PIECE = 32
_U = np.uint64
_NONE = _U(0)


def allowed(n: int, max_edit: float) -> int:
    return int(max_edit * n + 1e-9)


def least_runs(lo: int, hi: int, g: int, max_edit: float) -> int:
    """How many runs of g tokens the edits allowed spare at least, of any item of lo to hi tokens; not monotone in the length."""
    return min(n - g + 1 - g * allowed(n, max_edit) for n in range(lo, hi + 1))


def length_classes(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of item lengths, each at most 1.15 times as long at its end, and more where there would be over 62."""
    ratio = 1.15
    while True:
        out: list[list[int]] = []
        for n in sorted(set(lengths)):
            if out and n <= out[-1][0] * ratio:
                out[-1][1] = n
            else:
                out.append([n, n])
        if len(out) <= CLASSES:
            return [(a, b) for a, b in out]
        ratio *= 1.1


def walks(windows: np.ndarray, c: int, repeats: int, sampled: int) -> np.ndarray:
    """LSH keys (windows x repeats) of windows of n tokens (a matrix; shorter ones are filled up with zeros)."""
    count, n = windows.shape
    flat = np.concatenate([windows.ravel(), np.zeros(1, _U)])
    draws = np.stack([np.sort(np.random.default_rng([c, r, n]).choice(2 * n, min(sampled, 2 * n), replace=False)) for r in range(repeats)])
    flips = np.stack([tv.seeds(2 * n, 1000 * c + r + 1) for r in range(repeats)])
    out = np.empty((count, repeats), np.int64)
    for s in range(0, count, 4096):
        e = min(count, s + 4096)
        begin = (np.arange(s, e) * n)[:, None]
        key = np.broadcast_to((c * 4096 + np.arange(repeats)).astype(_U), (e - s, repeats)).copy()
        p = np.zeros((e - s, repeats), np.int64)
        for j in range(draws.max() + 1):
            sym = flat[np.where(p < n, begin + p, count * n)]
            for r in np.flatnonzero((draws == j).any(axis=1)):
                key[:, r] = tv.mix(key[:, r] * _U(0x9E3779B97F4A7C15) + sym[:, r])
            p += (((sym ^ flips[:, j]) * _U(0xBF58476D1CE4E5B9)) >> _U(63)).astype(np.int64)
        out[s:e] = key.view(np.int64)
    return out


def matrix(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Their first n tokens, row by row, filled up with zeros."""
    out = np.zeros((len(parts), n), _U)
    for i, x in enumerate(parts):
        out[i, : min(n, len(x))] = x[:n]
    return out


def edit_distances(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """The least edit distance of each item to any passage of its window."""
    out = np.zeros(len(items), np.int64)
    step = max(1, min(2048, (1 << 18) // max(map(len, windows), default=1)))
    for s in range(0, len(items), step):
        a, b = items[s : s + step], windows[s : s + step]
        n, m = max(map(len, a)), max(1, max(map(len, b)))
        x, y = np.zeros((len(a), n), _U), np.full((len(a), m), _U(1))
        for i, (u, v) in enumerate(zip(a, b)):
            x[i, : len(u)], y[i, : len(v)] = u, v
        size = np.array([len(u) for u in a])
        col = np.arange(m + 1)
        d = np.zeros((len(a), m + 1), np.int64)
        best = np.zeros(len(a), np.int64)
        for i in range(n):
            new = np.empty_like(d)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (y != x[:, i : i + 1]))
            d = np.minimum.accumulate(new - col, axis=1) + col
            done = size == i + 1
            best[done] = d[done].min(axis=1)
        out[s : s + step] = best
    return out


class Items:
    """The benchmark's tokens by length class, and the table of pair masks."""

    def __init__(self, rows: list[tuple[int, str]], max_edit: float) -> None:
        t = next(iter(tv.tokens(pa.array([x for _, x in rows], pa.large_string()), size=1 << 40)), None) if rows else None
        self.max_edit = max_edit
        self.ids: list[int] = []
        self.tokens: list[np.ndarray] = []
        for i, (item, _) in enumerate(rows):
            tok = t.hash[t.first[i] : t.first[i + 1]]
            if len(tok) >= LEAST_TOKENS:
                self.ids.append(item)
                self.tokens.append(tok)
        self.pieces: list[np.ndarray] = []
        self.item_of: list[int] = []
        self.offset: list[int] = []
        for i, tok in enumerate(self.tokens):
            parts = -(-len(tok) // PIECE)
            ends = [len(tok) * k // parts for k in range(parts + 1)]
            for a, b in [*zip(ends, ends[1:]), *[(0, len(tok))] * (parts > 1)]:
                self.pieces.append(tok[a:b])
                self.item_of.append(i)
                self.offset.append(a)
        self.classes = length_classes([len(x) for x in self.pieces])
        self.of = [next(c for c, (a, b) in enumerate(self.classes) if a <= len(x) <= b) for x in self.pieces]
        self.masks = [np.zeros(TABLE, _U) for _ in GRAMS]
        for c, tok in zip(self.of, self.pieces):
            for g, mask in zip(GRAMS, self.masks):
                np.bitwise_or.at(mask, runs(tok, g), _U(1) << _U(c))

    def keys(self, repeats: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
        """All LSH keys in order, and the number of the piece that each belongs to."""
        found = [walks(matrix([tok], self.classes[c][0]), c, repeats, sampled)[0] for tok, c in zip(self.pieces, self.of)]
        key, item = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(found)), repeats)
        order = np.argsort(key, kind="stable")
        return key[order], item[order]


def runs(tok: np.ndarray, g: int) -> np.ndarray:
    """Where in a table of masks each run of g tokens is."""
    if len(tok) < g:
        return np.zeros(0, np.int64)
    h = tok[: len(tok) - g + 1].copy()
    for k in range(1, g):
        h = h * _U(0x9E3779B97F4A7C15) + tok[k : len(tok) - g + 1 + k]
    return (tv.mix(h + _U(g)) & _U(TABLE - 1)).astype(np.int64)


def _windows(items: Items, repeats: int, sampled: int):
    classes, masks, max_edit = items.classes, items.masks, items.max_edit
    key_of, item_of = items.keys(repeats, sampled)

    def candidates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (window, piece) that share a key."""
        lo, hi = np.searchsorted(key_of, keys.ravel(), "left"), np.searchsorted(key_of, keys.ravel(), "right")
        n = hi - lo
        which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.unique(np.repeat(np.arange(len(keys)).repeat(repeats), n) * len(items.pieces) + item_of[which])
        return both // len(items.pieces), both % len(items.pieces)

    def starts(t: tv.Tokens, row: np.ndarray, seen: list[np.ndarray], stop: np.ndarray, c: int) -> np.ndarray:
        """Starts of the windows of a class that may match."""
        lo, hi = classes[c]
        n, at = len(t.hash), np.arange(len(t.hash))
        ok, total = np.ones(n, bool), np.zeros(n, np.int32)
        for g, m in zip(GRAMS, seen):
            hits = np.zeros(n + 1, np.int32)
            np.cumsum((m >> _U(c)) & _U(1), out=hits[1:], dtype=np.int32)
            count = hits[np.maximum(at, np.minimum(at + hi + allowed(hi, max_edit), stop) - g + 1)] - hits[:n]
            ok &= count >= max(1 if g == 2 else 0, least_runs(lo, hi, g, max_edit))
            total += count
        same = row[1:] == row[:-1]
        ok[1:] &= ~same | (total[1:] >= total[:-1])
        ok[:-1] &= ~same | (total[:-1] >= total[1:])
        return np.flatnonzero(ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            found: dict[int, list] = {}
            for t in tv.tokens(b.column(1)):
                n = len(t.hash)
                if not n:
                    continue
                row = t.row
                stop = t.first[row + 1]
                seen = []
                for g, mask in zip(GRAMS, masks):
                    m = np.zeros(n, _U)
                    m[: max(0, n - g + 1)] = mask[runs(t.hash, g)]
                    m[np.arange(n) + g > stop] = 0
                    seen.append(m)
                some = int(np.bitwise_or.reduce(seen[0]))
                for c, (_, hi) in enumerate(classes):
                    if some >> c & 1:
                        slack = allowed(hi, max_edit)
                        for x in starts(t, row, seen, stop, c).tolist():
                            first, last = int(t.first[row[x]]), int(stop[x])
                            begin = max(first, x - slack)
                            found.setdefault(c, []).append((ids[t.lo + row[x]], x - first, t.hash[begin : min(last, x + hi + 2 * slack)].copy(), t.hash[x : min(last, x + hi)].copy(), t.hash, first, last, x))
            for c, rows in found.items():
                w, i = candidates(walks(matrix([r[3] for r in rows], classes[c][0]), c, repeats, sampled))
                d = edit_distances([items.pieces[x] for x in i], [rows[x][2] for x in w])
                near = np.flatnonzero(d <= np.array([allowed(len(items.pieces[x]), max_edit) for x in i], np.int64))
                hits, whole = [], {}
                for x, piece, distance in zip(w[near].tolist(), i[near].tolist(), d[near].tolist()):
                    item = items.item_of[piece]
                    n, (doc, at, _, _, tokens, first, last, x) = len(items.tokens[item]), rows[x]
                    if n == len(items.pieces[piece]):
                        hits.append((doc, items.ids[item], at, distance))
                    else:
                        start, room = x - items.offset[piece], 2 * allowed(n, max_edit) + allowed(classes[c][1], max_edit)
                        whole[id(tokens), first, item, start] = (doc, item, max(0, start - first), tokens[max(first, start - room) : min(last, start + n + room)])
                far = edit_distances([items.tokens[r[1]] for r in whole.values()], [r[3] for r in whole.values()])
                hits.extend((doc, items.ids[item], at, distance) for (doc, item, at, _), distance in zip(whole.values(), far.tolist()) if distance <= allowed(len(items.tokens[item]), max_edit))
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "at", "distance"])

    return run


def _parts(benchmark: DataFrame, most_items: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, at most about ``most_items`` at a time."""
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = max(1, -(-bench.count() // most_items))
    for k in range(parts):
        yield sorted((r.item_id, r.text) for r in bench.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect())


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, repeats: int = REPEATS, sampled: int = SAMPLED, most_items: int = MOST_ITEMS) -> DataFrame:
    """Rows (doc_id, item_id, at, distance): each document that holds a passage of a benchmark item, at its best place.

    Reads doc_id and text; item_id and text. ``at`` is the number of the token where the best window begins,
    distance the token edit distance there; of items of over ``PIECE`` tokens it is where the piece that matched puts their first. Null ids, null or empty texts give no rows, nor do items of under four
    tokens, which are no evidence. Ties go to the least ``at``. Repeated documents or items (rows of the same id)
    count once. Documents shorter than an item are matched whole. Empty tables give no rows.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for own in _parts(benchmark, most_items):
        some = rows.mapInArrow(_windows(Items(own, max_edit), repeats, sampled), "doc_id long, item_id long, at int, distance int")
        found = some if found is None else found.unionByName(some)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "at")).alias("best")).select("doc_id", "item_id", "best.at", "best.distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, each judged by itself, in narrow passes; rows without a doc_id stay."""
    for own in _parts(benchmark, params.get("most_items", MOST_ITEMS)):
        run = _windows(Items(own, params.get("max_edit", MAX_EDIT)), params.get("repeats", REPEATS), params.get("sampled", SAMPLED))

        def judge(b: pa.RecordBatch, run=run) -> np.ndarray:
            text = tv.as_strings(b.column(b.schema.get_field_index("text")))
            out = np.ones(b.num_rows, bool)
            for hit in run(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), text], ["doc_id", "text"])])):
                out[hit.column(0).to_numpy()] = False
            return out | b.column(b.schema.get_field_index("doc_id")).is_null().to_numpy(zero_copy_only=False)

        docs = kept(docs, judge)
    return docs
