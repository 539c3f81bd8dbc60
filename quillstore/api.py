"""Facades in the style of client libraries: a reader with typed getters, a writer that collects inserts.

Single lookups are Spark jobs: milliseconds, not nanoseconds.  For throughput use batches (``operators.lookup``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionary as D
from .operators import load as load_ops
from .operators import lookup as L
from .plans.store import SnapshotStore
from .types import CacheKind, KeySpaceFullError, NotFoundError, OffsetBitsError, StoreError, UninitializedError, ValueType

OK, ERROR, OFFSET_BITS, KEY_SPACE_FULL = 0, 1, 2, 3


class Reader:
    """Typed lookups on the newest, or a pinned, version of a name.

    Missing keys, keys of another type and empty lists raise NotFoundError; an empty key does too; a reader that was
    closed or never updated raises UninitializedError.
    """

    def __init__(self, spark: SparkSession, root: str, task: str, timestamp: int | None = None, preload: bool = False):
        self.store, self.name = SnapshotStore(spark, root), task.rpartition(".")[0] or task
        self.pinned, self.preload = timestamp, preload
        self.frame: DataFrame | None = None
        self.timestamp = -1

    def update(self, timestamp: int | None = None) -> int:
        """Open a version and swap it in; returns its timestamp.  On failure the published one stays."""
        ts = timestamp if timestamp is not None else self.pinned if self.pinned is not None else self.store.latest_timestamp(self.name)
        new = self.store.open(self.name, ts, self.preload)
        old, self.frame, self.timestamp = self.frame, new, ts
        self.kind = CacheKind(self.store.manifest(self.name, ts).kind)
        if old is not None and self.preload:
            old.unpersist()
        return ts

    def initialize(self, timestamp: int | None = None) -> int:
        """0, or 1 on any failure."""
        try:
            self.update(timestamp)
            return OK
        except StoreError:
            return ERROR

    def close(self) -> None:
        if self.frame is not None and self.preload:
            self.frame.unpersist()
        self.frame = None

    def _one(self, key, getter):
        if self.frame is None:
            raise UninitializedError(self.name)
        raw = key.encode() if isinstance(key, str) else bytes(key)
        if not raw:
            raise NotFoundError(key)
        row = L.point(self.frame, raw).withColumn("exists", F.lit(True)).select(getter.alias("r")).first()
        return None if row is None else row[0]

    def _value(self, key, getter):
        got = self._one(key, L.gated(getter, self.kind) if self.frame is not None else getter)
        if got is None or not got["exists"]:
            raise NotFoundError(key)
        return got["value"]

    def contains_key(self, key) -> bool:
        if self.frame is None:
            raise UninitializedError(self.name)
        return bool(key) and bool(self._one(key, L.contains()))

    def get_key(self, key) -> str:
        got = self._one(key, L.get_string())
        if got is None or not got["exists"]:
            raise NotFoundError(key)
        return got["value"]

    def get_key_type(self, key) -> str:
        got = self._one(key, L.get_key_type())
        if not got:
            raise NotFoundError(key)
        return got

    def get_bool(self, key) -> bool:
        return self._value(key, L.get_bool())

    def get_int(self, key) -> int:
        return self._value(key, L.get_integer())

    def get_long(self, key) -> int:
        return self._value(key, L.get_int64())

    def get_double(self, key) -> float:
        return self._value(key, L.get_double())

    def get_vector(self, key) -> list:
        got = self._one(key, L.get_vector())
        if not got:
            raise NotFoundError(key)
        return got

    def get_vector_size(self, key) -> int:
        return self._one(key, L.get_vector_size()) or 0

    def get_vector_item(self, key, index: int) -> str | None:
        return self._one(key, L.get_vector_item(index))

    def get_vector_float(self, key) -> list:
        got = self._one(key, L.get_float_vector())
        if not got:
            raise NotFoundError(key)
        return got

    def get_float_at_index(self, key, index: int) -> float:
        return self._one(key, L.get_float_at_index(index)) or 0.0

    def get_any(self, key):
        """The value by the type of its key."""
        getters = {"String": self.get_key, "StringList": self.get_vector, "Bool": self.get_bool, "Int64": self.get_long, "Double": self.get_double, "FloatList": self.get_vector_float}
        return getters[self.get_key_type(key)](key)

    def batch(self, probes: DataFrame, key: str = "key", rows: int | None = None) -> DataFrame:
        if self.frame is None:
            raise UninitializedError(self.name)
        return L.lookup(probes, self.frame, key, rows)

    def statistics(self) -> dict:
        if self.frame is None:
            raise UninitializedError(self.name)
        return dict(self.store.manifest(self.name, self.timestamp).header_info())


class Writer:
    """Collects text inserts on the driver in bounded chunks, then publishes.  Large inputs are loaded as files."""

    def __init__(self, spark: SparkSession, root: str, task: str, kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED, offset_bits: int = 35, max_load_factor: float = 0.5, number_of_key_slots: int = 0, chunk: int = 100_000):
        load_ops.check_config(kind, offset_bits, max_load_factor)
        self.spark, self.store, self.name = spark, SnapshotStore(spark, root), task.rpartition(".")[0] or task
        self.kind, self.offset_bits, self.max_load_factor, self.slots = kind, offset_bits, max_load_factor, number_of_key_slots
        self.chunk, self.rows, self.frames, self.count = chunk, [], [], 0
        self.words = D.DictionaryBuilder(kind)
        self.error, self.closed = "", False

    def _flush(self) -> None:
        if self.rows:
            schema = "key string, value string, key_type int, src_idx int, src_block bigint, src_ord bigint"
            self.frames.append(load_ops.insert_text(self.spark.createDataFrame(self.rows, schema)))
            self.rows = []

    def insert_key(self, key: bytes | str, value: bytes | str, key_type: int = 0) -> int:
        """0, or 1 with the text of ``last_error``."""
        if self.closed:
            self.error = "writer is closed"
            return ERROR
        text = [x.decode("utf-8", "surrogateescape") if isinstance(x, bytes) else x for x in (key, value)]
        if len(text[0].encode("utf-8", "surrogateescape")) > 65535 or len(text[1].encode("utf-8", "surrogateescape")) >= 16777215:
            self.error = "key or value too long"
            return ERROR
        self.rows.append((*text, key_type, 0, 0, self.count))
        self.count += 1
        if len(self.rows) >= self.chunk:
            self._flush()
        return OK

    def insert_many(self, rows: Iterable[tuple]) -> int:
        return max((self.insert_key(*r) for r in rows), default=OK)

    def add_duplicate_value(self, value: str, value_type: int = 0) -> int:
        return self.words.add(value, ValueType(value_type))

    def finish_add_duplicate_values(self) -> int:
        return self.words.finish()

    def last_error(self) -> str:
        """The last error's text; asking clears it."""
        text, self.error = self.error, ""
        return text

    def finish_cache_creation(self, timestamp: int | None = None) -> int:
        """Publish; returns the timestamp."""
        self._flush()
        if self.frames:
            pairs = self.frames[0]
            for f in self.frames[1:]:
                pairs = pairs.unionByName(f)
        else:
            pairs = load_ops.insert_text(self.spark.createDataFrame([], "key string, value string, key_type int, src_idx int, src_block bigint, src_ord bigint"))
        words = self.words.frame(self.spark) if self.words.finished else None
        ts = self.store.publish(self.name, pairs, self.kind, self.offset_bits, self.max_load_factor, self.slots, timestamp, words=words)
        self.closed = True
        return ts

    def finish_code(self) -> int:
        """``finish_cache_creation`` as a code: 0 ok, 2 offset bits, 3 key space full, 1 other."""
        try:
            self.finish_cache_creation()
            return OK
        except OffsetBitsError as e:
            self.error = str(e)
            return OFFSET_BITS
        except KeySpaceFullError as e:
            self.error = str(e)
            return KEY_SPACE_FULL
        except StoreError as e:
            self.error = str(e)
            return ERROR

    def close(self) -> None:
        self.rows, self.frames, self.closed = [], [], True
