"""Load semantics: first write wins, duplicate accounting, limits and capacity.

A load is scan, parse, one shuffle on the key, write.  The winner of a key is found by an aggregate with partial
results on the map side, so a key with a third of all records costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import (
    COMPLETENESS_MARKER,
    LIST_FLAG,
    MAX_ELEMENT_BYTES,
    MAX_KEY_BYTES,
    MAX_LINEAR_LOAD_FACTOR,
    MAX_LIST_LENGTH,
    MAX_VALUE_BYTES,
    OFFSET_BITS,
    ORDER_COLUMNS,
    PAYLOAD_COLUMNS,
    CacheKind,
    KeySpaceFullError,
    LimitError,
    OffsetBitsError,
    StoreError,
    ValueType,
)


def load_order(df: DataFrame) -> Column:
    """The explicit load order of a scan."""
    return F.struct(*(c for c in ORDER_COLUMNS if c in df.columns))


def put(key, value, vtype: ValueType) -> list[Column]:
    """The canonical columns of a put of one typed value (``value``: a column of the type's Spark form)."""
    k, v = S.col(key).cast("binary"), S.col(value)
    kinds = dict(zip(PAYLOAD_COLUMNS, ("binary", "array<binary>", "boolean", "bigint", "double", "array<float>"), strict=True))
    target = {"String": "s", "StringList": "sl", "Bool": "b", "Int64": "i", "Double": "d", "FloatList": "fl"}
    if ValueType(vtype).name not in target:
        raise StoreError(f"values of type {ValueType(vtype).name} cannot be written")
    at = target[ValueType(vtype).name]
    columns = [(v if c == at else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return [k.alias("key"), S.query_id(k.cast("string")).alias("query_id"), F.lit(ValueType(vtype).name).alias("vtype"), *columns]


def first_wins(pairs: DataFrame, order: Column | None = None, keys: tuple = ("key",)) -> DataFrame:
    """The first record of each key in load order."""
    rest = [c for c in pairs.columns if c not in keys and c not in ORDER_COLUMNS]
    order = load_order(pairs) if order is None else order
    won = pairs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("won"))
    return won.select(*(F.col(c) if c in keys else F.col("won")[c].alias(c) for c in pairs.columns if c not in ORDER_COLUMNS))


def insert(pairs: DataFrame, kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED, order: Column | None = None) -> DataFrame:
    """The records that a cache of that kind answers with.

    MAP keeps Strings and lists apart and takes no other type, so a key may have one of each.
    """
    if kind == CacheKind.NONE:
        raise StoreError("no cache of kind NONE")
    if kind == CacheKind.MAP:
        taken = pairs.where(F.col("vtype").isin("String", "StringList"))
        return first_wins(taken, order, ("key", "vtype"))
    return first_wins(pairs, order)


def put_report(pairs: DataFrame, kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED) -> DataFrame:
    """Per key: attempts, inserted, rejected and entries.  A chained cache reports every put as inserted."""
    keys = ("key", "vtype") if kind == CacheKind.MAP else ("key",)
    inserted = F.col("attempts") if kind == CacheKind.BUCKET_CHAIN else F.lit(1).cast("bigint")
    if kind == CacheKind.MAP:
        inserted = F.when(F.col("vtype").isin("String", "StringList"), inserted).otherwise(F.lit(0).cast("bigint"))
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.select(*keys, "attempts", inserted.alias("inserted"), (F.col("attempts") - inserted).alias("rejected"))


def load_totals(pairs: DataFrame) -> DataFrame:
    """One row: total_keys (records), unique_keys, duplicate_keys."""
    per_key = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_keys"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_keys"),
    )


# --- limits ------------------------------------------------------------------------------------------------------


def encoded_bytes() -> Column:
    """Size of the encoded value: Strings have a trailing NUL, list elements two bytes of length and a NUL each."""
    listed = F.lit(2) + F.aggregate(F.transform("sl", lambda x: F.octet_length(x) + 3), F.lit(0), lambda a, x: a + x)
    return (
        F.when(F.col("vtype") == "String", F.octet_length("s") + 1)
        .when(F.col("vtype") == "StringList", listed)
        .when(F.col("vtype") == "Bool", F.lit(1))
        .when(F.col("vtype") == "FloatList", 4 * F.size("fl"))
        .otherwise(F.lit(8))
    )


def violation() -> Column:
    """Why a record is over a limit; null if it is not."""
    longest = F.array_max(F.transform("sl", lambda x: F.octet_length(x)))
    return (
        F.when(F.octet_length("key") > MAX_KEY_BYTES, "key too long")
        .when(F.size("sl") > MAX_LIST_LENGTH, "list too long")
        .when(longest > MAX_ELEMENT_BYTES, "list element too long")
        .when(encoded_bytes() > MAX_VALUE_BYTES, "value too long")
        .when(~F.col("vtype").isin("String", "StringList", "Bool", "Int64", "Double", "FloatList"), "type cannot be written")
    )


def split_by_limits(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records within the limits, rejected records with their reason)."""
    return pairs.where(violation().isNull()), pairs.withColumn("reason", violation()).where(F.col("reason").isNotNull())


def enforce_limits(pairs: DataFrame) -> DataFrame:
    """Raise when a record is over a limit."""
    bad = violation()
    return pairs.withColumn("key", F.when(bad.isNull(), F.col("key")).otherwise(F.raise_error(bad).cast("binary")))


def check_config(kind: CacheKind, offset_bits: int, max_load_factor: float) -> None:
    """Raise for settings that no cache takes."""
    if kind == CacheKind.NONE:
        raise StoreError("no cache of kind NONE")
    if not OFFSET_BITS[0] <= offset_bits <= OFFSET_BITS[1]:
        raise OffsetBitsError(f"offset bits {offset_bits} out of range")
    if kind >= CacheKind.LINEAR_PROBE and max_load_factor > MAX_LINEAR_LOAD_FACTOR:
        raise LimitError(f"load factor {max_load_factor} is more than {MAX_LINEAR_LOAD_FACTOR}")


def ranged(rows: DataFrame, order: Column, **per_range: Column) -> tuple[DataFrame, list]:
    """(rows with ``__at``, their order, and ``__range``, the number of a range of it; one summary per range that has rows,
    ascending: __range, least, n and what ``per_range`` aggregates).

    The bounds are values of the order, chosen by Spark's range partitioning and fixed before the rows are dealt, so a
    lost task deals them alike.  The driver holds one summary per range, as many as the session has shuffle partitions.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = rows.select("*", order.alias("__at"))
    dealt = at.repartitionByRange(n, "__at").withColumn("__range", F.spark_partition_id())
    found = dealt.groupBy("__range").agg(F.min("__at").alias("least"), F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in per_range.items())).orderBy("least").collect()
    # Null orders come first and stay in the first range.
    bounds = [r["least"] for r in found[1:]]
    if not bounds:
        return at.withColumn("__range", F.lit(0)), found
    kind = at.schema["__at"].dataType
    literals = F.array(*(_literal(b, kind) for b in bounds))
    return at.withColumn("__range", F.coalesce(F.size(F.filter(literals, lambda b: b <= F.col("__at"))), F.lit(0))), found


def _literal(value, kind) -> Column:
    if hasattr(kind, "fields"):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    return F.lit(value).cast(kind)


def _carried(rows: DataFrame, values: list, schema: str) -> DataFrame:
    """Rows joined with one value per range, a table of as many rows as there are ranges."""
    table = rows.sparkSession.createDataFrame(list(enumerate(values)), f"__range int, {schema}")
    return rows.join(F.broadcast(table), "__range", "left")


def within_capacity(pairs: DataFrame, slots: int, max_load_factor: float, order: Column | None = None) -> DataFrame:
    """Records that arrive before the key space is full; the check comes before the duplicate check, so once it is full
    duplicates are refused too.

    The full point is the load-order position of the last key that fits: first positions of keys are counted by range
    of the order, and only the range in which the space fills up is sorted.
    """
    capacity = int(slots * max_load_factor)
    if capacity <= 0:
        return pairs.limit(0)
    order = load_order(pairs) if order is None else order
    at = pairs.select("*", order.alias("__at"))
    firsts = at.groupBy("key").agg(F.min("__at").alias("__first"))
    dealt, found = ranged(firsts.select("__first"), F.col("__first"))
    before = 0
    for number, r in enumerate(found):
        if before + r["n"] >= capacity:
            last = dealt.where(F.col("__range") == number).orderBy("__first").limit(capacity - before).agg(F.max("__first").alias("__last"))
            return at.join(F.broadcast(last), F.col("__at") <= F.col("__last")).drop("__at", "__last")
        before += r["n"]
    return pairs


def require_capacity(pairs: DataFrame, slots: int, max_load_factor: float) -> None:
    """Raise if the distinct keys outgrow the key space (an action)."""
    if pairs.select("key").distinct().count() > int(slots * max_load_factor):
        raise KeySpaceFullError("keySpace is full")


def check_offset_bits(size: int, offset_bits: int, slots: int) -> None:
    """Raise if that many bytes of records, with a slot of eight bytes each, outgrow the offset width."""
    if size + slots * 8 >= 1 << offset_bits:
        raise OffsetBitsError(f"offset bits {offset_bits} too short")


# --- typed insertion ---------------------------------------------------------------------------------------------


def insert_text(rows: DataFrame, key="key", value="value", key_type="key_type") -> DataFrame:
    """Text values under a numeric type tag.

    A key that begins with the list flag loses it and its value is a sorted list; else the tag decides: Bool, Int64,
    Double (strict), FloatList (by colons); 127 cuts a String, or each element after sorting, at its first NUL;
    unknown tags are Strings.
    """
    k, v, t = S.col(key), S.col(value), S.col(key_type)
    listed = S.is_list_key(k)
    cut = t == int(ValueType.StringNoNull)
    name = (
        F.when(listed, "StringList")
        .when(t == int(ValueType.Bool), "Bool")
        .when(t == int(ValueType.Int64), "Int64")
        .when(t == int(ValueType.Double), "Double")
        .when(t == int(ValueType.FloatList), "FloatList")
        .otherwise("String")
    )
    bare = F.when(listed, F.substr(k, F.lit(len(LIST_FLAG) + 1))).otherwise(k)
    order = [c for c in ORDER_COLUMNS if c in rows.columns]
    named = rows.select(bare.alias("key"), v.alias("value"), name.alias("vtype"), cut.alias("cut"), *order)
    vt = F.col("vtype")
    value = F.col("value")
    return named.select(
        F.col("key").cast("binary").alias("key"),
        S.query_id("key").alias("query_id"),
        "vtype",
        F.when(vt == "String", F.when(F.col("cut"), S.until_nul(value)).otherwise(value).cast("binary")).alias("s"),
        F.when(vt == "StringList", F.when(F.col("cut"), S.inserted_list(value, True)).otherwise(S.inserted_list(value))).cast("array<binary>").alias("sl"),
        F.when(vt == "Bool", S.to_bool(value)).alias("b"),
        F.when(vt == "Int64", S.to_long(value)).alias("i"),
        F.when(vt == "Double", S.to_double(value)).alias("d"),
        F.when(vt == "FloatList", S.float_vector(value)).alias("fl"),
        *order,
    )


def drop_consecutive(rows: DataFrame, order: Column, key: str = "key", within: str | None = None) -> DataFrame:
    """Leave out a record whose key equals that of the record before it.

    Records are compared inside ``within`` (such as a source), or over the whole input.  That is dealt by ranges of the
    order, and each range gets the key that the one before ends with.
    """
    if within:
        w = W.partitionBy(within).orderBy(order)
        before = F.lag(F.struct(key)).over(w)
        return rows.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before")[key].eqNullSafe(F.col(key))).drop("__before")
    dealt, found = ranged(rows, order, last=F.max_by(F.struct(F.col(key).alias("k")), "__at"))
    ends = [None, *(tuple(r["last"]) for r in found[:-1])] if found else []
    dealt = _carried(dealt, ends, f"__end struct<k:{dict(rows.dtypes)[key]}>")
    before = F.coalesce(F.lag(F.struct(F.col(key).alias("k"))).over(W.partitionBy("__range").orderBy("__at")), F.col("__end"))
    marked = dealt.withColumn("__before", before)
    return marked.where(F.col("__before").isNull() | ~F.col("__before")["k"].eqNullSafe(F.col(key))).select(rows.columns)


def drop_empty_typed(rows: DataFrame, value: str = "value", vtype: str = "vtype") -> DataFrame:
    """Leave out empty values of types other than String."""
    return rows.where(~((F.col(vtype) != "String") & (F.col(value) == "")))


def is_complete(rows: DataFrame, marker: str = COMPLETENESS_MARKER) -> bool:
    """Whether any key begins with the completeness marker (an action; stops at the first)."""
    return bool(rows.where(F.startswith(F.col("key").cast("string"), F.lit(marker))).limit(1).count())


def insert_all(parsed: DataFrame, order: Column, marker: str | None = COMPLETENESS_MARKER, within: str | None = None) -> DataFrame:
    """A whole file: without consecutive repeats and empty typed values; raises unless the marker is there."""
    if marker and not is_complete(parsed, marker):
        raise StoreError(f"no key begins with {marker}")
    return drop_empty_typed(drop_consecutive(parsed, order, within=within))


def dedup_runs(rows: DataFrame, order: Column, key: str = "key", prefix: Column | None = None, within: str | None = None) -> DataFrame:
    """Scanner de-duplication.

    Keys without a dot are unique over the input.  Keys with an empty prefix are never dropped.  Others are unique
    within each run of consecutive records of one raw prefix, list flag included; records of the first two sorts do not
    end a run.
    """
    k = F.col(key).cast("string")
    prefix = F.substring_index(k, ".", 1) if prefix is None else prefix
    dotted = F.instr(k, ".") > 0
    sort = F.when(~dotted, "global").when(prefix == "", "never").otherwise("run")
    tagged = rows.select("*", order.alias("__at"), sort.alias("__sort"), prefix.alias("__prefix"))
    runs = tagged.where("__sort = 'run'")
    extra = [within] if within else ["__range"]
    if within:
        numbered = _run_starts(runs, extra, F.col("__at"))
    else:
        # Runs may cross ranges: each range gets the prefix that the one before ends with and where that run began.
        dealt, _ = ranged(runs.drop("__at"), order)
        local = _run_starts(dealt, extra, F.col("__at"))
        ends = local.groupBy("__range").agg(
            F.min_by("__prefix", "__at").alias("first"), F.max_by("__prefix", "__at").alias("last"), F.max("__run").alias("began"), F.countDistinct("__run").alias("runs"), F.max("__range").alias("r")
        )
        carry, last, began = {}, None, None
        for r in sorted(ends.collect(), key=lambda r: r["r"]):
            carry[r["r"]] = (last, began)
            if r["runs"] > 1 or last is None or r["first"] != last:
                began = r["began"]
            last = r["last"]
        known = [carry.get(i, (None, None)) for i in range(max(carry, default=-1) + 1)]
        kind = local.schema["__at"].dataType.simpleString()
        carried = _carried(dealt, [(p, None if a is None else a) for p, a in known], f"__end struct<p:string,a:{kind}>")
        numbered = _run_starts(carried, extra, F.when(F.col("__end")["p"].eqNullSafe(F.col("__prefix")), F.col("__end")["a"]).otherwise(F.col("__at"))).drop("__end")
    one = W.partitionBy(*([within] if within else []), "__run", key).orderBy("__at")
    kept = numbered.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    plain = tagged.where("__sort = 'global'")
    first = plain.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("__at"))).where("__n = 1")
    return kept.select(rows.columns).unionByName(first.select(rows.columns)).unionByName(tagged.where("__sort = 'never'").select(rows.columns))


def _run_starts(rows: DataFrame, groups: list[str], carried: Column) -> DataFrame:
    """Adds ``__run``: where the run of a record begins.  carried: where the run of a group's first record begins, which may
    be before the group."""
    over = W.partitionBy(*groups).orderBy("__at")
    first = F.row_number().over(over) == 1
    begin = F.when(first, carried).when(~F.lag("__prefix").over(over).eqNullSafe(F.col("__prefix")), F.col("__at"))
    marked = rows.withColumn("__begin", begin)
    return marked.withColumn("__run", F.last("__begin", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, 0))).drop("__begin")
