"""Typed key/value relations derived from the driver's tables, in the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.load import put
from .types import ValueType


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefixed(prefix: str, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string") if isinstance(column, str) else column)


def strings(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(prefixed("267.", "c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    return t.select(*put("key", "v", ValueType.String))


def bools(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(prefixed("992.", "doc_id").alias("key"), (F.col("toxic") != 0).alias("v"))
    return t.select(*put("key", "v", ValueType.Bool))


def int64s(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(prefixed("1690.", "o_orderkey").alias("key"), F.col("o_custkey").alias("v"))
    return t.select(*put("key", "v", ValueType.Int64))


def doubles(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(prefixed("1401.", "p_partkey").alias("key"), F.col("p_retailprice").alias("v"))
    return t.select(*put("key", "v", ValueType.Double))


def string_lists(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("v"))
    return t.select(prefixed("999.", "o_custkey").alias("key"), "v").select(*put("key", "v", ValueType.StringList))


def float_lists(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select(prefixed("1909.", "vec_id").alias("key"), F.col("embedding").alias("v"))
    return t.select(*put("key", "v", ValueType.FloatList))


def all_types(spark, sf_dir):
    out = strings(spark, sf_dir)
    for f in (bools, int64s, doubles, string_lists, float_lists):
        out = out.unionByName(f(spark, sf_dir))
    return out


def puts(spark, sf_dir):
    """Repeated puts of Strings with a total order."""
    t = table(spark, sf_dir, "events").select(prefixed("267.", "user_id").alias("key"), F.col("event_type").alias("v"), F.col("event_id").alias("src_ord"))
    return t.select(*put("key", "v", ValueType.String), "src_ord")
