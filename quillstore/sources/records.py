"""Record files as DataFrames.

A scan keeps the load order explicit, because the order in which partitions are scheduled is not the order of files:
(index of the source in the input list, path of the file where a source is a folder or a pattern, first byte of the
split, row number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.files import Files
from ..types import ORDER_COLUMNS, RECORD_SEPARATOR, StoreError, ValueType

ON_INVALID = ("empty_key", "error", "drop")


def scan_records(spark: SparkSession, paths: Sequence[str] | str, separator: str = RECORD_SEPARATOR) -> DataFrame:
    """Raw records with their load order; blank records and an unterminated last one are kept.  A missing file raises
    when the plan is made.  Splits of large files are read in parallel; files of a folder or a pattern follow each other
    by path."""
    files = Files(spark, "")
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for i, path in enumerate(paths):  # one small relation per listed source, united: the list is the user's own
        raw = spark.read.option("lineSep", separator).text(path)
        frames.append(
            raw.select(
                F.col("value").alias("record"),
                F.lit(i).alias("src_idx"),
                (F.lit("") if files.is_file(path) else F.col("_metadata.file_path")).alias("src_file"),
                F.col("_metadata.file_block_start").alias("src_block"),
                F.monotonically_increasing_id().alias("src_ord"),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def parse_records(records: DataFrame, on_invalid: str = "empty_key") -> DataFrame:
    """key, query_id, vtype, value (text), load order.

    on_invalid, for records without ``=``: ``empty_key`` gives an empty key with an empty value, ``error`` raises,
    ``drop`` leaves them out.
    """
    if on_invalid not in ON_INVALID:
        raise StoreError(f"on_invalid must be one of {ON_INVALID}")
    record = F.col("record")
    if on_invalid == "drop":
        records = records.where(S.has_equals(record))
    elif on_invalid == "error":
        records = records.withColumn("record", F.when(S.has_equals(record), record).otherwise(F.raise_error(F.concat(F.lit("record without '=': "), record))))
    order = [c for c in ORDER_COLUMNS if c in records.columns]
    # A flag counts only in a valid record.
    listed = S.has_equals(record) & S.is_list_key(record)
    key = S.record_key(record)
    return records.select(
        key.alias("key"),
        S.query_id(key).alias("query_id"),
        F.when(listed, ValueType.StringList.name).otherwise(ValueType.String.name).alias("vtype"),
        S.record_value(record).alias("value"),
        *order,
    )


def typed_payload(value, vtype, list_parser=S.file_list):
    """The six payload columns of a text value under a type name."""
    v = S.col(value)
    t = S.col(vtype)
    return [
        F.when(t == "String", v.cast("binary")).alias("s"),
        F.when(t == "StringList", list_parser(v)).cast("array<binary>").alias("sl"),
        F.when(t == "Bool", S.to_bool(v)).alias("b"),
        F.when(t == "Int64", S.to_long(v)).alias("i"),
        F.when(t == "Double", S.to_double(v)).alias("d"),
        F.when(t == "FloatList", S.float_vector(v)).alias("fl"),
    ]


def to_pairs(parsed: DataFrame, list_parser=S.file_list) -> DataFrame:
    """Parsed text values to the canonical columns plus load order."""
    order = [c for c in ORDER_COLUMNS if c in parsed.columns]
    return parsed.select(F.col("key").cast("binary").alias("key"), "query_id", "vtype", *typed_payload("value", "vtype", list_parser), *order)


def read_pairs(spark: SparkSession, paths, separator: str = RECORD_SEPARATOR, on_invalid: str = "empty_key") -> DataFrame:
    return to_pairs(parse_records(scan_records(spark, paths, separator), on_invalid))


def parse_type_header(line: str) -> dict[int, str]:
    """``id=Type|id=Type...``; unknown types are left out."""
    known = {v.name for v in ValueType if v.value < 127}
    out = {}
    for part in line.split("|"):
        name, _, kind = part.partition("=")
        if kind.strip() in known and name.strip().lstrip("+-").isdigit():
            out[int(name.strip())] = kind.strip()
    return out


def read_typed_text(spark: SparkSession, path: str) -> DataFrame:
    """A typed text file: the first line maps query ids to types, the others are ``key=value``.

    Blank lines are skipped and blanks around lines trimmed; a line with other than one ``=`` raises; ids that the
    header does not list are Strings.  The header is one line, read by the driver.
    """
    lines = scan_records(spark, path, "\n").withColumn("record", S.trim("record"))
    first = lines.orderBy("src_block", "src_ord").select("record").first()
    types = parse_type_header(first[0] if first else "")
    rest = lines.where((F.col("record") != "") & ~((F.col("src_block") == 0) & (F.col("src_ord") == 0)))
    parts = S.split_parts("record", "=")
    checked = F.when(F.size(parts) == 2, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("not one '=': "), F.col("record"))))
    records = rest.withColumn("record", checked)
    return to_pairs(with_types(parse_records(records, "error"), types), S.text_list)


def with_types(parsed: DataFrame, types: dict[int, str]) -> DataFrame:
    """Set vtype by query id: String where ``types`` says nothing.  The map is folded into the plan."""
    if not types:
        return parsed.withColumn("vtype", F.lit("String"))
    names = F.create_map(*(F.lit(x) for k, v in types.items() for x in (int(k), v)))
    return parsed.withColumn("vtype", F.coalesce(F.try_element_at(names, F.col("query_id").cast("int")), F.lit("String")))
