"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import trim_memory


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may live in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.  Where none is named, a local one will do only if all runs in this
    process (tests); a cluster's executors would not see it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillstore-checkpoints"))


ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have 8 MB at most (a longer row is alone): long texts would else fill a
    Python worker, as batches are bounded by rows first."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", spark.conf.get(key).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise a slim frame in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that have been cut: it waits for the driver's garbage
    collection, which a driver with little to do may not come to for long."""
    gc.collect()
    trim_memory()
    spark.sparkContext._jvm.System.gc()


# Largest table, in bytes as Spark estimates or as the caller has proved, that may be broadcast.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast only when ``rows * row_bytes`` (a proved bound) is below the limit; else leave the choice to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


# Of a total, the part from which a key counts as hot: so there are at most this many hot keys.
HOT_KEYS = 1000


def broadcast_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, total, most, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and, as ``size``, how much of ``left`` the key holds.

    total, most: sum and maximum of ``size``.  Keys that hold more than a thousandth of all, a thousand at most, are
    broadcast, so their rows stay where they are; the rest is left to Spark."""
    if not total or most * HOT_KEYS <= total or most < HOT_KEYS:
        return left.join(right, keys, how)
    hot = F.col(size) * HOT_KEYS > total
    near = left.join(F.broadcast(right.where(hot)), keys)
    far = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys, how)
    return near.unionByName(far)


# Bits of the largest table that maybe_among broadcasts (as 2**18 rows of 64 bits).
TABLE_BITS = 1 << 24


def maybe_among(df: DataFrame, hashed, keys: DataFrame, n: int, rest: bool = False):
    """The rows of ``df`` whose 64-bit number ``hashed`` may be among the n of ``keys`` (one column, h), and no fewer.

    A table of bits, sized by n up to a fixed bound, is broadcast; the more keys beyond it, the more rows pass.
    rest: give (those rows, all other rows)."""
    bits = 1 << min(TABLE_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))
    place = lambda h: F.shiftright(h.bitwiseAND(bits - 1), 6)
    words = keys.select(place(F.col("h")).alias("t_word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("t_bit")).groupBy("t_word").agg(F.bit_or("t_bit").alias("t_bits"))
    looked = df.withColumn("t_h", hashed).withColumn("t_at", place(F.col("t_h"))).join(F.broadcast(words), F.col("t_at") == F.col("t_word"), "left" if rest else "inner")
    held = F.expr("coalesce(shiftright(t_bits, cast(t_h & 63 as int)) & 1L, 0L) = 1L")
    if not rest:
        return looked.where(held).select(df.columns)
    return looked.where(held).select(df.columns), looked.where(~held).select(df.columns)


def drop_keys(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose (id, 64-bit hash of the text, null apart) is not among ``keys``
    (f_id, f_key).  Rows that cannot be are not shuffled."""
    names, keys = docs.columns, cut(keys)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.col(f"c{names.index(text_col)}")
    plain = plain.withColumn("d_id", F.col(f"c{names.index(id_col)}")).withColumn("d_key", F.xxhash64(text, text.isNull()))
    maybe, sure = maybe_among(plain, F.xxhash64("d_id", "d_key"), keys.select(F.xxhash64("f_id", "f_key").alias("h")), keys.count(), rest=True)
    left = maybe.join(keys, maybe["d_id"].eqNullSafe(keys["f_id"]) & (maybe["d_key"] == keys["f_key"]), "left_anti")
    return sure.unionByName(left).drop("d_id", "d_key").toDF(*names)


def discard(df: DataFrame) -> None:
    """Remove the checkpoint of a frame made by ``cut`` that no other frame needs any more."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    file = rdd.getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data, in any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def filter_rows(docs: DataFrame, text_col: str, verdicts) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, for which ``verdicts`` (text column of a batch to booleans) is true.

    Columns may have any names: they are numbered on the way through Python."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
