"""Quality rules by compression bands.

A text is kept when it passes two base rules (enough words, few words inside
repeated 8-word windows) and when zstandard neither shrinks it too well
(repetitive) nor too badly (incompressible) for its length.  The whole text is
measured, and so is each fixed chunk of it, the shorter last one included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import bounded_batches, filter_rows

#: Upper byte bound of a band, least and greatest ratio of raw to compressed bytes of a whole text.
#: Short texts cannot be judged by a low ratio: the frame of a compressed text alone takes some bytes.
BANDS = (
    (128, 0.0, 2.4),
    (256, 0.9, 2.9),
    (512, 1.1, 3.1),
    (1024, 1.2, 3.6),
    (4096, 1.3, 4.2),
    (16384, 1.4, 4.8),
    (1 << 62, 1.45, 5.5),
)


@dataclass(frozen=True)
class Limits:
    """bands: limits by length; chunk_bytes: size of the fixed chunks; chunk_low, chunk_high: limits of a chunk's
    ratio (a last chunk below that size has those of its length's band); bad_chunk_share: the share of a text's bytes in
    chunks outside their limits from which it is rejected;
    level: of zstandard; min_words, max_repeat_pct, window: the base rules."""

    bands: tuple = BANDS
    chunk_bytes: int = 4096
    chunk_low: float = 1.25
    chunk_high: float = 4.5
    bad_chunk_share: float = 0.2
    level: int = 3
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunk_share double, base_failed boolean, kept boolean"

NOT_NEWLINE = ~K.table([10])
SYMBOLS = K.table(b"#*$%&|<>")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def _chunk(data: np.ndarray, offsets: np.ndarray, limits: Limits, squeeze) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = K.words(data, offsets, K.NOT_SPACE)
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    inside = K.NOT_SPACE[data]
    out = {"n_words": n_words, "word_chars": _per_row(inside & K.code_points(data), offsets), "n_symbols": _per_row(SYMBOLS[data], offsets)}

    line_start, line_end, line_row = K.words(data, offsets, NOT_NEWLINE)
    c = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    full = c[line_end] > c[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    key = K.word_hashes(data, line_start, line_end) ^ K.splitmix(line_row.astype(K.U))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)

    grams, at = K.gram_hashes(K.word_hashes(data, starts, ends), rows, limits.window)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(grams):
        _, inverse, count = np.unique(grams ^ K.splitmix(rows[at].astype(K.U)), return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + limits.window, -1)
    hit = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = np.bincount(rows[hit], minlength=n).astype(np.int64)

    ratio, bad = np.ones(n), np.zeros(n)
    raw = data.tobytes()
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b > a:
            ratio[i] = (b - a) / len(squeeze(raw[a:b]))
            for x in range(a, b, limits.chunk_bytes):
                size = min(limits.chunk_bytes, b - x)
                low, high = (limits.chunk_low, limits.chunk_high) if size == limits.chunk_bytes else next((c, d) for n, c, d in limits.bands if size <= n)
                got = ratio[i] if size == b - a else size / len(squeeze(raw[x : x + size]))
                bad[i] += 0 if low <= got <= high else size
            bad[i] /= b - a
    band = np.searchsorted([x[0] for x in limits.bands], np.diff(offsets))
    low, high = np.array([x[1] for x in limits.bands])[band], np.array([x[2] for x in limits.bands])[band]
    out |= {"ratio": ratio, "bad_chunk_share": bad}
    out["base_failed"] = (n_words < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_pct * n_words)
    out["kept"] = ~out["base_failed"] & (ratio >= low) & (ratio <= high) & (bad < limits.bad_chunk_share)
    return out


def measure(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """All measures of a string column; a null text counts as an empty one."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=limits.level).compress
    data, offsets, _ = K.utf8_column(column)
    parts = [_chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], limits, squeeze) for a, b in K.chunks(offsets)]
    if not parts:
        parts = [_chunk(np.zeros(0, np.uint8), np.zeros(1, np.int64), limits, squeeze)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def compression_bands(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measures and the verdict ``kept``.

    Narrow: no shuffle, memory bounded by one Arrow batch.  A null or empty text has no words, so it fails the
    base rules; repeated rows are judged alike; a ratio equal to a limit is inside; a long text is one row of a batch; an
    empty table gives an empty result; other columns are not looked at.
    """
    limits = limits or Limits()
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            got = measure(batch.column(1), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got.values())], names=["doc_id", *got])

    kind = dict(slim.dtypes)["doc_id"]
    out = slim.mapInArrow(run, f"doc_id {kind}, " + MEASURES)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def keep_compressible(docs: DataFrame, limits: Limits | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text is kept (see ``compression_bands``); columns may have any
    names; an empty table stays empty."""
    limits = limits or Limits()
    return filter_rows(docs, text_col, lambda column: measure(column, limits)["kept"])
