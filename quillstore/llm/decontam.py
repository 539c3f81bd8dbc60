"""Benchmark decontamination by a positional inverted index that is partitioned by document.

The index is a table of *segments*.  A segment covers some whole documents
(about a megabyte of text, or one longer document) and holds, for each term of
the stated test set, the sorted positions of that term: its postings.  Index
and search need no shuffle, so a source, word or passage that fills a third of
all rows only fills its own segments.

A test window is looked up term by term, rarest postings first: each posting
minus the term's offset in the window is a candidate start, and each further
list keeps the candidates that it also has at its own offset (exact phrase) or
within some slack of it (proximity).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_batches, cut, drop_keys

SEGMENT = "doc_ids {id}, doc_keys array<long>, n_words array<long>, terms array<int>, counts array<int>, postings binary"


@dataclass
class TestSet:
    """A block of test items: sorted hashes of their terms, distinct windows as rows of term numbers (-1: no
    further term), and for each window the items that hold it."""

    __test__ = False
    vocabulary: np.ndarray
    windows: np.ndarray
    items: list[str]
    item_of: np.ndarray
    window_of: np.ndarray


def _name(item) -> str:
    return "null" if item is None else str(item)


def encode_items(items: list[tuple], window: int) -> TestSet:
    """items: (id, text) pairs; a null text has no words and hence no window.  Rows of one id are one item, which has the
    windows of all of them; the id of an item without one is ``null``."""
    column = pa.array([t for _, t in items], pa.large_string())
    data, offsets, _ = K.utf8_column(column)
    data = K.ascii_lower(data[offsets[0] : offsets[-1]])
    starts, ends, rows = K.words(data, offsets - offsets[0], K.WORD)
    hashes = K.word_hashes(data, starts, ends)
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes).astype(np.int32)
    names = sorted({_name(i) for i, _ in items})
    number = {x: i for i, x in enumerate(names)}
    out, owner = [], []
    bounds = np.searchsorted(rows, np.arange(len(items) + 1))
    for i in range(len(items)):
        own = ids[bounds[i] : bounds[i + 1]]
        if 0 < len(own) < window:
            out.append(np.pad(own, (0, window - len(own)), constant_values=-1)[None])
        elif len(own):
            out.append(np.lib.stride_tricks.sliding_window_view(own, window))
        owner += [number[_name(items[i][0])]] * (len(out[-1]) if len(own) else 0)
    every = np.concatenate(out) if out else np.zeros((0, window), np.int32)
    distinct, inverse = np.unique(every, axis=0, return_inverse=True)
    return TestSet(vocabulary, distinct, names, np.array(owner, np.int64), inverse.reshape(-1))


def blocks(items: DataFrame, window: int, block_bytes: int):
    """The stated test set in blocks of bounded size, read by the driver one after the other."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode()) + 64
        if size >= block_bytes:
            yield encode_items(block, window)
            block, size = [], 0
    if block:
        yield encode_items(block, window)


def build_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Segments of (doc_id, doc_key, text): per document its number of words, per term of the vocabulary its postings.

    A position counts words over the segment, one number is left free between documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.tobytes())

    def run(batches):
        known = np.frombuffer(shared.value, K.U)
        for batch in batches:
            data, offsets, _ = K.utf8_column(batch.column(2))
            for a, b in K.chunks(offsets):
                own = K.ascii_lower(data[offsets[a] : offsets[b]])
                starts, ends, rows = K.words(own, offsets[a : b + 1] - offsets[a], K.WORD)
                hashes = K.word_hashes(own, starts, ends)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
                term = at[hit].astype(np.int32)
                order = np.argsort(term, kind="stable")
                position = (hit + rows[hit]).astype(np.int32)[order]
                terms, counts = np.unique(term, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.schema.field(0).type)),
                        pa.array([batch.column(1).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.bincount(rows, minlength=b - a).astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([position.tobytes()], pa.binary()),
                    ],
                    names=["doc_ids", "doc_keys", "n_words", "terms", "counts", "postings"],
                )

    return docs.mapInArrow(run, SEGMENT.format(id=f"array<{docs.dtypes[0][1]}>"))


def find_windows(windows: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, slack: int = 0, block: int = 1 << 20):
    """(window, start) of each occurrence in a segment; with slack each word may be that far from its place.

    Postings lists are intersected from the rarest term of each window on.  Candidates are handled in blocks, so
    memory does not grow with the number of windows.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(windows):
        return nothing
    n_terms = int(max(windows.max(initial=0), terms.max())) + 1
    size = np.zeros(n_terms + 1, np.int64)  # the last: for "no further term"
    size[terms] = counts
    base = np.zeros(n_terms + 1, np.int64)
    base[terms] = np.concatenate(([0], np.cumsum(counts)[:-1]))
    of = size[windows]
    of[windows < 0] = np.iinfo(np.int64).max
    live = np.flatnonzero(of.min(1) > 0)
    if not len(live):
        return nothing
    order = np.argsort(of[live], axis=1, kind="stable")  # offsets in a window, rarest term first
    span = np.int64(1) << 32
    key = np.repeat(terms.astype(np.int64), counts) * span + postings  # ascending: by term, then position
    rarest = windows[live, order[:, 0]]
    load = np.concatenate(([0], np.cumsum(size[rarest])))
    found = []
    a = 0
    while a < len(live):
        b = max(a + 1, int(np.searchsorted(load, load[a] + block, side="right")) - 1)
        n = size[rarest[a:b]]
        which = np.repeat(np.arange(a, b), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = postings[base[rarest[which]] + within].astype(np.int64) - order[which, 0]
        for step in range(1, windows.shape[1]):
            if not len(which):
                break
            offset = order[which, step]
            term = windows[live[which], offset].astype(np.int64)
            wanted = term * span + np.maximum(start + offset - slack, 0)
            at = np.searchsorted(key, wanted)
            at[at == len(key)] = 0
            ok = (term < 0) | ((key[at] >= wanted) & (key[at] <= term * span + start + offset + slack))
            which, start = which[ok], start[ok]
        keep = start >= 0
        found.append((live[which[keep]], start[keep]))
        a = b
    w, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return w, s


RESULT = "doc_id {id}, doc_key long, n_words long, n_hit long, hits binary, items array<string>, near_items array<string>"


def search(index: DataFrame, block: TestSet, slack: int = 3) -> DataFrame:
    """Per document of the index: n_words, n_hit, its hit words as packed bits, and the ids, as sorted strings, of the
    block's items that have an exact occurrence (items) or only one within the slack (near_items)."""
    shared = index.sparkSession.sparkContext.broadcast(pickle.dumps((block.windows, block.item_of, block.window_of, block.items)))
    kind = dict(index.dtypes)["doc_ids"][6:-1]

    def run(batches):
        windows, item_of, window_of, names = pickle.loads(shared.value)
        by_window = np.argsort(window_of, kind="stable")
        bound = np.searchsorted(window_of[by_window], np.arange(len(windows) + 1))
        length = (windows >= 0).sum(1)

        def pairs(w, doc):
            """Distinct (document, item)."""
            if not len(w):
                return np.zeros((0, 2), np.int64)
            at = np.unique(doc * len(windows) + w)
            doc, w = at // len(windows), at % len(windows)
            n = bound[w + 1] - bound[w]
            item = item_of[by_window[np.repeat(bound[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
            return np.unique(np.stack([np.repeat(doc, n), item], 1), axis=0)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, n_words = batch.column(0)[i].values, batch.column(1)[i].values, np.asarray(batch.column(2)[i].values)
                n = len(n_words)
                terms, counts = np.asarray(batch.column(3)[i].values), np.asarray(batch.column(4)[i].values)
                postings = np.frombuffer(batch.column(5)[i].as_py(), np.int32)
                first = np.concatenate(([0], np.cumsum(n_words + 1)))  # of each document, free numbers included
                w, s = find_windows(windows, terms, counts, postings)
                doc = np.searchsorted(first, s, side="right") - 1
                mark = np.zeros(first[-1] + 1, np.int64)
                np.add.at(mark, s, 1)
                np.add.at(mark, s + length[w], -1)
                hit = np.cumsum(mark) > 0
                exact = pairs(w, doc)
                near = np.zeros((0, 2), np.int64)
                if slack:
                    w, s = find_windows(windows, terms, counts, postings, slack)
                    doc = np.searchsorted(first, s, side="right") - 1
                    inside = s + length[w] - 1 - first[doc] < n_words[doc]
                    near = pairs(w[inside], doc[inside])
                    known = np.isin(near[:, 0] * (1 << 32) + near[:, 1], exact[:, 0] * (1 << 32) + exact[:, 1])
                    near = near[~known]
                some = set(exact[:, 0].tolist())
                lists = [[[] for _ in range(n)] for _ in range(2)]
                for out, found in zip(lists, (exact, near), strict=True):
                    for d, item in found.tolist():
                        out[d].append(names[item])
                hits = [hit[first[d] : first[d + 1] - 1] if d in some else hit[:0] for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        keys,
                        pa.array(n_words),
                        pa.array([int(h.sum()) for h in hits], pa.int64()),
                        pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()),
                        *(pa.array([sorted(x) for x in out], pa.list_(pa.string())) for out in lists),
                    ],
                    names=["doc_id", "doc_key", "n_words", "n_hit", "hits", "items", "near_items"],
                )

    return index.mapInArrow(run, RESULT.format(id=kind))


REPORT = "doc_id {id}, doc_key long, n_words long, n_hit long, items array<string>, near_items array<string>"


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, slack: int = 3, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, doc_key (hash of the text), n_words, n_hit (words inside an exact occurrence of
    a window), items (ids, as strings, with an exact occurrence, sorted), near_items (only within the slack).

    Null and empty texts have no words.  An item with fewer words than the window, but not none, is one window.
    Repeated rows of ``docs`` each get a row, ids may be null; repeated item ids are one item and a null one is reported
    as ``null``, whatever the blocks.  An empty table of documents gives no rows, one of items no hits.  A long text is a
    segment of its own.  Items are read in blocks of ``block_bytes``; one block is the common case, further blocks cost
    one more pass each and are joined by document.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col], docs[text_col].isNull()).alias("doc_key"), docs[text_col].alias("text"))
    kind = slim.dtypes[0][1]
    found = [search(cut(build_index(slim, b.vocabulary)), b, slack) for b in blocks(items.select(items[item_col], items[item_text_col]), window, block_bytes)]
    if not found:
        found = [search(build_index(slim, np.zeros(0, K.U)), encode_items([], window), slack)]
    if len(found) == 1:
        return found[0].drop("hits")
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    # Results of a document are equal for equal ids and texts, so repeated rows are counted and given back.
    per_block = merged.groupBy("doc_id", "doc_key", "n_words").agg(
        (F.count(F.lit(1)) / len(found)).cast("int").alias("copies"),
        F.collect_set("hits").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near_items")))).alias("near_items"),
    )

    def union_bits(batches):
        for batch in batches:
            n = []
            for sets in batch.column(4).to_pylist():
                every = 0
                for x in sets:
                    every |= int.from_bytes(x, "little")
                n.append(every.bit_count())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), batch.column(5), batch.column(6)], names=["doc_id", "doc_key", "n_words", "n_hit", "items", "near_items"])

    spread = per_block.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return spread.mapInArrow(union_bits, REPORT.format(id=kind)).withColumn("near_items", F.array_except("near_items", "items"))


def digest(report: DataFrame) -> DataFrame:
    """The columns of the contract: counts, the hash of the sorted item ids and the verdict."""
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, without the contaminated documents.  Null and empty texts stay;
    repeated rows stay or go together; columns may have any names; an empty table stays empty."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = decontaminate(docs, items, slack=0, **options).where(contaminated()).select(F.col("doc_id").alias("f_id"), F.col("doc_key").alias("f_key")).distinct()
    return drop_keys(docs, id_col, text_col, bad)
