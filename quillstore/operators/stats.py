"""Scan statistics, splits, comparison of a source with a snapshot, and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import lookup as L


def scan_stats(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: keys, key_bytes, value_bytes and the least and greatest lengths of both."""
    k, v = F.octet_length(key), F.octet_length(value)
    return rows.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias("key_bytes"),
        F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias("value_bytes"),
        F.min(k).alias("min_key"),
        F.max(k).alias("max_key"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def distinct_query_ids(rows: DataFrame, key: str = "key") -> DataFrame:
    return rows.select(S.query_id(F.col(key).cast("string")).alias("query_id")).distinct().orderBy("query_id")


def duplicate_histogram(rows: DataFrame, key: str = "key") -> DataFrame:
    """(duplicates, keys): how many keys were put so many times more than once, ascending."""
    per_key = rows.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("duplicates"))
    return per_key.groupBy("duplicates").agg(F.count(F.lit(1)).alias("keys")).orderBy("duplicates")


def split_by_query_id(rows: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """One folder of ``key=value`` lines per query id.  Rows are dealt by id and a hash of the key, so a large id has
    several files and writers."""
    lines = rows.select(S.query_id(F.col(key).cast("string")).alias("query_id"), F.concat(F.col(key).cast("string"), F.lit("="), F.col(value).cast("string")).alias("line"), F.pmod(F.hash(key), F.lit(64)).alias("__part"))
    dealt = lines.repartition("query_id", "__part").drop("__part")
    dealt.write.mode("overwrite").partitionBy("query_id").text(path)


def comparison(scanned: Column | str = "value") -> Column:
    """Status of a scanned text value against the joined snapshot row: equal, different, or missing.

    Lists are compared over the snapshot's length, float lists by length and 32-bit values; a Bool or an unknown type
    counts as different.
    """
    v = S.col(scanned)
    parts = S.file_list(v)
    held = F.col("sl").cast("array<string>")
    same_list = F.forall(F.arrays_zip(held.alias("a"), F.slice(parts, F.lit(1), F.greatest(F.size(held), F.lit(1))).alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    floats = S.float_vector(v)
    same = (
        F.when(F.col("vtype") == "String", F.col("s") == v.cast("binary"))
        .when(F.col("vtype") == "StringList", (F.size(held) == 0) | same_list)
        .when(F.col("vtype") == "Int64", F.col("i") == S.to_long(v))
        .when(F.col("vtype") == "Double", F.col("d") == S.to_double(v))
        .when(F.col("vtype") == "FloatList", F.col("fl") == floats)
        .otherwise(False)
    )
    return F.when(~L.contains(), "missing").when(F.coalesce(same, F.lit(False)), "equal").otherwise("different")


def compare(scanned: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows (key, value) of a source with their status against a snapshot."""
    return L.lookup(scanned.select("key", "value"), snapshot).select("key", "value", comparison().alias("status"))


def comparison_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def text_lines(snapshot: DataFrame) -> DataFrame:
    """The text dump: ``key=value`` lines, lists joined by bars; Strings and lists only."""
    value = F.coalesce(F.col("s").cast("string"), S.join_list(F.col("sl").cast("array<string>")))
    kept = snapshot.where(F.col("vtype").isin("String", "StringList"))
    return kept.select(F.col("vtype"), F.concat(F.col("key").cast("string"), F.lit("="), value).alias("value"))


def write_text(snapshot: DataFrame, path: str) -> None:
    """Write the text dump, Strings before lists."""
    lines = text_lines(snapshot)
    lines.repartitionByRange(F.when(F.col("vtype") == "String", 0).otherwise(1), "value").sortWithinPartitions(F.col("vtype").asc(), "value").select("value").write.mode("overwrite").text(path)


def debug_json() -> Column:
    """One snapshot row as ``"key":{"type":"T", "value":v}``; doubles and floats have six decimals."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    shown = (
        F.when(F.col("vtype") == "String", quote(F.col("s").cast("string")))
        .when(F.col("vtype") == "StringList", F.concat(F.lit("["), F.array_join(F.transform(F.col("sl").cast("array<string>"), quote), ","), F.lit("]")))
        .when(F.col("vtype") == "Bool", F.col("b").cast("string"))
        .when(F.col("vtype") == "Int64", F.col("i").cast("string"))
        .when(F.col("vtype") == "Double", F.format_string("%f", "d"))
        .when(F.col("vtype") == "FloatList", F.concat(F.lit("["), F.array_join(F.transform("fl", lambda x: F.format_string("%f", x.cast("double"))), ","), F.lit("]")))
    )
    return F.concat(quote(F.col("key").cast("string")), F.lit(':{"type":"'), F.col("vtype"), F.lit('", "value":'), shown, F.lit("}"))


def same_value(a: str, b: str) -> Column:
    """Equality of two struct columns of canonical rows: same type and same payload."""
    same = F.col(a)["vtype"].eqNullSafe(F.col(b)["vtype"])
    for c in ("s", "sl", "b", "i", "d", "fl"):
        same = same & F.col(a)[c].eqNullSafe(F.col(b)[c])
    return same

