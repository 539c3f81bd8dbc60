"""Dictionary encoding of frequent values.

On disk Parquet has its own dictionaries; these operators give the explicit one: which values, their numbers, and
encode and decode as joins on a table of at most 65536 rows, a fixed bound that makes it safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import MAX_DICTIONARY, CacheKind, LimitError, StoreError, ValueType


def dictionary(spark: SparkSession, values: list) -> DataFrame:
    """(idx, value) of a list of values; equal values keep their first position."""
    if len(values) > MAX_DICTIONARY:
        raise LimitError(f"more than {MAX_DICTIONARY} dictionary values")
    raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(raw)), "idx int, value binary")
    return rows.groupBy("value").agg(F.min("idx").alias("idx")).select("idx", "value")


def top_values(rows: DataFrame, value: str, k: int = 256) -> DataFrame:
    """(value, count, score) of the k values that save most: more than once, by count times length, ties by value."""
    if k > MAX_DICTIONARY:
        raise LimitError(f"more than {MAX_DICTIONARY} dictionary values")
    counted = rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    scored = counted.withColumn("score", F.col("count") * F.octet_length("value"))
    return scored.orderBy(F.desc("score"), "value").limit(k)


def from_top(top: DataFrame) -> DataFrame:
    """A dictionary (idx, value) from ``top_values``, least score first."""
    from pyspark.sql import Window as W

    return top.select((F.row_number().over(W.orderBy("score", "value")) - 1).alias("idx"), "value")


def encode(rows: DataFrame, words: DataFrame, value: str) -> DataFrame:
    """Replace values that are in the dictionary by their number: adds ``idx`` and ``rest`` (one of them is null)."""
    d = words.select(F.col("value").alias("__value"), "idx")
    joined = rows.join(F.broadcast(d), rows[value] == d["__value"], "left").drop("__value")
    return joined.withColumn("rest", F.when(F.col("idx").isNull(), F.col(value))).drop(value)


def decode(encoded: DataFrame, words: DataFrame, value: str) -> DataFrame:
    """The inverse of ``encode``."""
    d = words.select(F.col("idx").alias("__idx"), F.col("value").alias("__value"))
    joined = encoded.join(F.broadcast(d), encoded["idx"] == d["__idx"], "left")
    return joined.withColumn(value, F.coalesce("__value", "rest")).drop("__idx", "__value", "idx", "rest")


def index_bytes(words_count: int) -> int:
    """Bytes of a dictionary number: one up to 256 words, else two."""
    return 1 if words_count <= 256 else 2


def values_of(words: DataFrame) -> list[bytes]:
    return [bytes(r[0]) for r in words.orderBy("idx").select("value").collect()]  # at most 65536 rows


class DictionaryBuilder:
    """Collects values one by one, as typed text, for a dedup kind."""

    def __init__(self, kind: CacheKind):
        self.kind, self.values, self.finished = kind, [], False

    def add(self, value: str, vtype: ValueType = ValueType.String) -> int:
        """0, or 1 for a kind without dictionary or after the end."""
        if not self.kind.has_dictionary or self.finished:
            return 1
        self.values.append((value, int(vtype)))
        return 0

    def finish(self) -> int:
        if not self.kind.has_dictionary or self.finished:
            return 1
        if len(self.values) > MAX_DICTIONARY:
            raise LimitError(f"more than {MAX_DICTIONARY} dictionary values")
        self.finished = True
        return 0

    def frame(self, spark: SparkSession) -> DataFrame:
        """(idx, s, fl): Strings as bytes and float lists as floats, for matching in their own columns."""
        if not self.finished:
            raise StoreError("the dictionary is not finished")
        first = dict.fromkeys(self.values)  # equal values keep their first position
        rows = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(first)], "idx int, text string, t int")
        floats = F.col("t") == int(ValueType.FloatList)
        return rows.select("idx", F.when(~floats, F.col("text").cast("binary")).alias("s"), F.when(floats, S.dictionary_floats("text")).alias("fl"))
