"""Gapless numbers within groups, without one task per group.

Rows get an id that is fixed by writing it to the shared checkpoint folder.
A group is split by the input partition of its rows; only counts per split are
summed up to offsets, so a group with a third of all rows is spread like any
other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

ROW, PART = "__row", "__part"
#: Least and most splits of a group.
SPLITS = (64, 4096)


def splits_of(df: DataFrame) -> int:
    """A group has as many splits as the input has partitions, within the bounds."""
    return min(SPLITS[1], max(SPLITS[0], df._jdf.queryExecution().toRdd().getNumPartitions()))


def fix_rows(slim: DataFrame) -> DataFrame:
    """Add a unique row id and its split, then materialise: after this, a lost executor cannot renumber rows."""
    fixed = cut(slim.withColumn(ROW, F.monotonically_increasing_id()))
    return fixed.withColumn(PART, (F.shiftrightunsigned(ROW, 33) % splits_of(fixed)).cast("int"))


def number(fixed: DataFrame, group: str, out: str, group_bound: int, order: tuple = ()) -> DataFrame:
    """Add ``out``: 0, 1, ... within each value of ``group``, by split, then ``order``, then row id.

    group_bound: a proved upper bound on the number of groups, by which the offsets may be broadcast.
    """
    counts = fixed.groupBy(group, PART).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__group"), F.col(PART).alias("__split"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    offsets = broadcast_if_small(offsets, group_bound * splits_of(fixed), 32)
    inside = F.row_number().over(W.partitionBy(group, PART).orderBy(*order, ROW)) - 1
    ranked = fixed.withColumn("__inside", inside)
    joined = ranked.join(offsets, ranked[group].eqNullSafe(offsets["__group"]) & (ranked[PART] == offsets["__split"]))
    return joined.withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__group", "__split", "__before", "__inside")
