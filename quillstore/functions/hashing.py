"""The function that no built-in expresses, as an Arrow UDF: XXH3-64."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _xxh3(values: pa.Array) -> pa.Array:
    import xxhash

    return pa.array([None if v is None else int.from_bytes(xxhash.xxh3_64_digest(v), "big", signed=True) for v in values.to_pylist()], pa.int64())


def xxh3_64(key) -> Column:
    """XXH3-64 of a binary key, as a signed 64-bit integer."""
    udf = F.arrow_udf(_xxh3, "bigint")
    return udf((F.col(key) if isinstance(key, str) else key).cast("binary"))


def found_hash(key, exists) -> Column:
    """The hash of a key that is there, else 0."""
    return F.when(exists, xxh3_64(key)).otherwise(F.lit(0).cast("bigint"))
