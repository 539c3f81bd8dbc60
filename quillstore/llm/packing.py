"""Packing token sequences best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each is
placed, longest first, into the open window with the least sufficient room.
Pieces of one length are interchangeable, so the driver packs the histogram of
lengths (as many numbers as a window has tokens, whatever the corpus) and gets
the very windows of best-fit decreasing over all pieces; executors then number
the pieces of each length and read their places off that plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import encoder
from .common import bounded_batches
from .numbering import PART, ROW, fix_rows, number


class SegmentTree:
    """Counts of open windows by remaining room; finds the least room of at least some size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.sums[i] += n
            i >>= 1

    def least(self, room: int) -> int | None:
        """The least remaining room >= room with an open window."""
        i = room + self.leaves
        if self.sums[i]:
            return room
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int) -> list[tuple]:
    """Places for all pieces: rows (length, first rank, pieces per window, first window, first offset).

    A row holds until the next rank of its length; rank r of it is in window first + (r - rank) // per at offset
    first offset + ((r - rank) % per) * length.
    """
    tree, open_runs = SegmentTree(window), {}
    plan, windows = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room = window
                need = -(-left // (window // length))
                run = (windows, need)
                windows += need
            else:
                run = open_runs[room].pop()
                tree.add(room, -run[1])
            first, n = run
            per = room // length
            whole = min(n, left // per)
            used = 0
            for count, each in ((whole, per), (1, left - whole * per if whole < n else 0)):
                if count and each:
                    plan.append((length, rank, each, first + used, window - room))
                    rank, left, used = rank + count * each, left - count * each, used + count
                    rest = room - each * length
                    if rest:
                        open_runs.setdefault(rest, []).append((first + used - count, count))
                        tree.add(rest, count)
            if used < n:
                open_runs.setdefault(room, []).append((first + used, n - used))
                tree.add(room, n - used)
    return plan


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text): full windows, then one shorter rest, if any.  ids (little-endian unsigned 32-bit) are
    carried along if asked for.  A null or empty text is the end id alone."""

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            data, offsets, _ = K.utf8_column(batch.column(1))
            for a, b in K.chunks(offsets):
                ids, counts = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                first = np.cumsum(counts) - counts
                n = -(-counts // window)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(counts[doc] - start, window)
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * x : 4 * y] for x, y in zip((first[doc] + start).tolist(), (first[doc] + start + length).tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(a + doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(counts[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array([bytes(s) for s in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.mapInArrow(run, PIECE.format(id=docs.dtypes[0][1]) + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Each id of each document (its text's ids, then end_id) lies in exactly one piece; sequences are numbered from 0
    and hold at most ``window`` ids.  A null or empty text is its end id; repeated rows are packed each; pieces of one
    length take their places by the input's order; a long text gives as many pieces as it needs; an empty table gives
    none; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    pieces = fix_rows(token_pieces(slim, tokenizer, window, end_id, with_ids))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    plan = np.array(sorted(best_fit_decreasing(histogram, window)), np.int64).reshape(-1, 5)
    ranked = number(pieces, "length", "rank", window).drop(ROW, PART)
    at = {c: i for i, c in enumerate(ranked.columns)}
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        span = np.int64(1) << 44
        key = plan[:, 0] * span + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(at[c])).astype(np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(key, length * span + rank, side="right") - 1]
            inside = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in names), pa.array(row[:, 3] + inside // row[:, 2]), pa.array(row[:, 4] + inside % row[:, 2] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")
