"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit hashes; a key belongs to the
first point clockwise of its hash.  No shard may hold more than its part of all
rows (the parts differ by one at most): keys that a full shard cannot take
continue clockwise to the next point whose shard has room.  All keys of an arc
between two points walk the same way, so the walk is planned on the driver
from one count per arc, as many numbers as the ring has points, and executors
only number the rows of each arc.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .numbering import fix_rows, number


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes and their shards; those of a shard do not depend on the others."""
    ids = np.arange(shards * points, dtype=K.U)
    position = K.splitmix(K.splitmix(ids // K.U(points) + K.U(1)) ^ (ids % K.U(points)))
    order = np.argsort(position, kind="stable")
    return position[order], (ids // K.U(points)).astype(np.int64)[order]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (arc, first rank, shard, first slot).  Arcs fill their own shard first, in ring order; what is left of an
    arc then goes on clockwise, past full shards."""
    room, used = list(room), [0] * len(room)
    runs, left = [], []

    def put(arc, rank, n, shard):
        n = min(n, room[shard])
        if n:
            runs.append((arc, rank, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    for arc in sorted(counts):
        done = put(arc, 0, counts[arc], int(owner[arc]))
        if done < counts[arc]:
            left.append((arc, done))
    for arc, rank in left:
        step = 1
        while rank < counts[arc]:
            rank += put(arc, rank, counts[arc] - rank, int(owner[(arc + step) % len(owner)]))
            step += 1
    return runs


def shard_rows(docs: DataFrame, shards: int = 16, points: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and one), text_crc32, arc, shard, slot (0, 1, ... in a shard).

    Numbers of rows of any two shards differ by one at most, whatever the keys (law ``rows``): rows of one repeated or
    null key share an arc and overflow from it like others.  Equal texts are not kept together, as a third of all rows
    may be one text; they are told by text_crc32 and size.  A null text counts as empty; a long one is one row; which
    rows of an arc overflow follows the input's order; an empty table gives no rows; other columns are not looked at.
    """
    slim = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(docs[id_col]).alias("hash"),
    )
    position, owner = ring(shards, points)
    kinds = dict(slim.dtypes)
    plain = ["doc_id", "size", "text_crc32"]

    def arcs(batches):
        for batch in batches:
            at = np.searchsorted(position, np.asarray(batch.column(3)).view(K.U), side="left") % len(position)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at.astype(np.int32))], names=[*plain, "arc"])

    head = ", ".join(f"{c} {kinds[c]}" for c in plain) + ", arc int"
    fixed = fix_rows(slim.mapInArrow(arcs, head))
    counts = {r[0]: r[1] for r in fixed.groupBy("arc").count().collect()}  # at most shards * points rows
    plan = np.array(sorted(walk(counts, owner, capacities(sum(counts.values()), shards))), np.int64).reshape(-1, 4)
    ranked = number(fixed, "arc", "rank", shards * points).select(*plain, "arc", "rank")

    def place(batches):
        span = np.int64(1) << 48
        key = plan[:, 0] * span + plan[:, 1]
        for batch in batches:
            arc, rank = np.asarray(batch.column(3)).astype(np.int64), np.asarray(batch.column(4))
            run = plan[np.searchsorted(key, arc * span + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(run[:, 2].astype(np.int32)), pa.array(run[:, 3] + rank - run[:, 1])], names=[*plain, "arc", "shard", "slot"])

    return ranked.mapInArrow(place, head + ", shard int, slot long")


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "arc")
