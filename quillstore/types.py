"""The data model: value types, the canonical schema, limits, cache kinds and errors."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class ValueType(IntEnum):
    """Tags of stored values.  Int and Float are reserved: readable, never written.  StringNoNull is an input tag
    only: a String that ends at its first NUL."""

    String = 0
    StringList = 1
    Bool = 2
    Int64 = 3
    Double = 4
    Int = 5
    Float = 6
    FloatList = 7
    StringNoNull = 127


WRITABLE = (ValueType.String, ValueType.StringList, ValueType.Bool, ValueType.Int64, ValueType.Double, ValueType.FloatList)


class CacheKind(IntEnum):
    NONE = 0
    MAP = 1
    BUCKET_CHAIN = 2
    LINEAR_PROBE = 3
    LINEAR_PROBE_DEDUP = 4
    LINEAR_PROBE_DEDUP_TYPED = 5

    @property
    def typed_getters(self) -> bool:
        return self >= CacheKind.LINEAR_PROBE

    @property
    def has_dictionary(self) -> bool:
        return self >= CacheKind.LINEAR_PROBE_DEDUP


# Fixed values of the format.
MAX_KEY_BYTES = 65535
MAX_LIST_LENGTH = 65535
MAX_ELEMENT_BYTES = 65535
MAX_VALUE_BYTES = 16777215
MAX_DICTIONARY = 65536
MAX_LINEAR_LOAD_FACTOR = 0.8
OFFSET_BITS = (16, 38)
RECORD_SEPARATOR = "\x1e"
LIST_FLAG = "\x01"
LIST_SEPARATOR = "|"
FLOAT_SEPARATOR = ":"
COMPLETENESS_MARKER = "LAST_POPULATE"

#: One column per type; exactly one of the six payload columns of a row is not null.
PAYLOAD = T.StructType(
    [
        T.StructField("s", T.BinaryType()),
        T.StructField("sl", T.ArrayType(T.BinaryType())),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("fl", T.ArrayType(T.FloatType())),
    ]
)
PAYLOAD_COLUMNS = tuple(PAYLOAD.fieldNames())

#: A snapshot.
SNAPSHOT = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("query_id", T.LongType()), T.StructField("vtype", T.StringType()), *PAYLOAD.fields])

#: Load order: index of the source in the input list, file of a source that is a folder or a pattern, first byte of the
#: split, row number.
ORDER_COLUMNS = ("src_idx", "src_file", "src_block", "src_ord")


class StoreError(RuntimeError):
    """Any failure of a load, a publication or a lookup."""


class NotFoundError(StoreError, KeyError):
    """No such key."""


class UninitializedError(StoreError):
    """The reader has no snapshot, or was closed."""


class OffsetBitsError(StoreError):
    """The offset width is out of range, or the data outgrows it."""


class KeySpaceFullError(StoreError):
    """More distinct keys than slots times load factor."""


class LimitError(StoreError, ValueError):
    """A key, value, list or element is too long."""


class MalformedSnapshotError(StoreError):
    """A file is not a snapshot, or one of another kind or version."""
