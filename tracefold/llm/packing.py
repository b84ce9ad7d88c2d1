"""Bounded-space online packing of documents into training windows.

Every partition of the documents is read once, as it is stored, and keeps at most ``open_windows`` windows open. A piece goes into
the open window with the least room that still takes it; if none does, the fullest is emitted and a new one opened.
What remains open at the end of the partitions is merged by the same rule, best fit, fullest first, over all of them. A window
holds the texts of its pieces and where each begins, in tokens, so that a trainer can mask across pieces.

Scale: nothing is shuffled but the pieces of the windows still open at the end of a partition (``open_windows`` of them), with their
texts; partitions are independent. How those windows are merged is decided in one task over one row a window, a number that
depends on the partitions, not on the documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import written

WINDOW, OPEN = 2048, 32
_OUT = "part int, serial long, leftover boolean, slot int, start int, doc_id long, first_token long, tokens int, text string, fill int"
_TYPES = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32())
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Shelf:
    """At most ``most`` open windows, ordered by room."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.opened = window, most, 0
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, size: int, what) -> list[tuple[int, list]]:
        """Puts ``what`` into the window that it fits best; the windows that are emitted for it."""
        out = []
        k = bisect.bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, w = self.rooms.pop(k)
        else:
            if len(self.rooms) == self.most:
                _, full = self.rooms.pop(0)
                out.append((full, self.held.pop(full)))
            room, w = self.window, self.opened
            self.opened += 1
            self.held[w] = []
        self.held[w].append(what)
        if room - size:
            bisect.insort(self.rooms, (room - size, w))
        else:
            out.append((w, self.held.pop(w)))
        return out


def words(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each text its UTF-8 bytes, and where its runs of non-blank characters begin and end."""
    whole = tv.as_strings(texts)
    for lo, hi in tv.chunks(whole):
        b, off = tv.raw(whole.slice(lo, hi - lo))
        edge = np.diff((~_BLANK[b]).view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(start, off)
        data = b.tobytes()
        for i in range(hi - lo):
            yield data[off[i] : off[i + 1]], start[first[i] : first[i + 1]] - off[i], end[first[i] : first[i + 1]] - off[i]


def by_tokenizer(path: str) -> Callable[[pa.Array], Iterator[tuple[bytes, np.ndarray, np.ndarray]]]:
    """Like ``words``, with the tokens of a tokenizer.json; pieces are cut where no token and no character is split."""

    def run(texts: pa.Array):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for text in tv.as_strings(texts).to_pylist():
            at = np.cumsum([0, *(len(c.encode()) for c in text)])
            spans = np.array(tok.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            ends = np.maximum.accumulate(at[spans[:, 1]]) if len(spans) else np.zeros(0, np.int64)
            yield text.encode(), np.concatenate([[0], ends])[: len(spans)], ends

    return run


def _pack(window: int, most: int, cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, part, rows, held = Shelf(window, most), TaskContext.get().partitionId(), [], 0

        def flush(emitted, leftover: bool) -> None:
            for w, pieces in emitted:
                fill, at = sum(p[2] for p in pieces), 0
                for k, p in enumerate(pieces):
                    rows.append((part, w, leftover, k + 1, at, *p, fill))
                    at += p[2]

        def batch() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, _TYPES)], [x.split()[0] for x in _OUT.split(", ")])
            rows.clear()
            return rb

        for b in batches:
            for doc, (data, start, end) in zip(b.column(0).to_pylist(), cut(b.column(1))):
                size, at = len(start), 0
                while at < size:
                    n = min(window, size - at)
                    piece = (doc, at, n, data[start[at] : end[at + n - 1]].decode("utf-8", "replace"))
                    held += len(piece[3])
                    if n == window:
                        flush([(shelf.opened, [piece])], False)
                        shelf.opened += 1
                    else:
                        flush(shelf.place(n, piece), False)
                    at += n
                if held > 8 << 20 and rows:
                    yield batch()
                    held = 0
        flush(sorted(shelf.held.items()), True)
        yield batch()

    return run


def merged(sizes: list[tuple[int, int]], window: int) -> list[int]:
    """For window fills (fullest first), the number of the merged window that each goes into, best fit."""
    rooms: list[tuple[int, int]] = []
    out, made = [], 0
    for size, _ in sizes:
        k = bisect.bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, w = rooms.pop(k)
        else:
            room, w, made = window, made, made + 1
        out.append(w)
        if room > size:
            bisect.insort(rooms, (room - size, w))
    return out


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN, tokenizer: str | None = None) -> DataFrame:
    """Rows (window_id, slot, start, doc_id, first_token, tokens, text, fill): the pieces of documents, window by window.

    Reads doc_id and text. A token is a run of non-blank characters, or one of the tokenizer whose tokenizer.json is at the
    path ``tokenizer``. ``text`` is the piece of the document's text from its first token to its last as it is written, ``start`` the
    place of its first token in the window and ``first_token`` in the document. A document of ``window`` tokens or more is cut:
    whole windows of its own, then a rest. Every token of every document is in one piece. Documents without a token (null,
    empty or blank text) and null doc_ids are in none. Repeated rows are packed as often as they occur. Ties between windows of
    like room go to the one opened first. slot numbers the pieces of a window from 1, fill is its sum of tokens. An
    empty table gives no rows.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces, _ = written(rows.mapInArrow(_pack(window, open_windows, by_tokenizer(tokenizer) if tokenizer else words), _OUT), "pieces")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = sorted(((f, p, s, n) for b in batches for p, s, f, n in zip(*(b.column(i).to_pylist() for i in range(4)))), key=lambda r: (-r[0], r[1], r[2]))
        into = merged([(f, 0) for f, _, _, _ in left], window)
        slots, fills, base = {}, {}, []
        for w, (f, _, _, n) in zip(into, left):
            base.append((slots.get(w, 0), fills.get(w, 0)))
            slots[w], fills[w] = slots.get(w, 0) + n, fills.get(w, 0) + f
        cols = [[r[1] for r in left], [r[2] for r in left], into, [x for x, _ in base], [x for _, x in base], [fills[w] for w in into]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["part", "serial", "into", "slots", "starts", "total"])

    left = pieces.where("leftover").groupBy("part", "serial").agg(F.first("fill").alias("fill"), F.count("*").cast("int").alias("n")).select("part", "serial", "fill", "n").coalesce(1).mapInArrow(merge, "part int, serial long, into long, slots int, starts int, total int")
    own = ("doc_id", "first_token", "tokens", "text")
    rest = pieces.where("leftover").join(left, ["part", "serial"]).select(F.concat_ws("-", F.lit("m"), "into").alias("window_id"), (F.col("slot") + F.col("slots")).alias("slot"), (F.col("start") + F.col("starts")).alias("start"), *own, F.col("total").alias("fill"))
    return pieces.where("not leftover").select(F.concat_ws("-", "part", "serial").alias("window_id"), "slot", "start", *own, "fill").unionByName(rest)
