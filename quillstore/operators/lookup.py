"""Lookups: a batch is one left join, each getter a projection over it.

All getters share the join, so a batch that asks for several of them shuffles once; a batch that is small by a checked
size is broadcast, and a single key is a filter that partition pruning and Parquet statistics can use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import scalars as S
from ..types import PAYLOAD_COLUMNS, CacheKind

#: Largest probe side, in bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def lookup(probes: DataFrame, snapshot: DataFrame, key: str = "key", rows: int | None = None, key_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per probe: its columns, ``exists`` and the canonical payload, null when the key is absent.

    rows: a known upper bound of the number of probes; under the limit, matches are found with the probes broadcast
    and only those are joined back, so the snapshot is not shuffled.  Probe columns that are named like a payload
    column get the prefix ``probe_``.
    """
    for c in set(probes.columns) & {"vtype", "exists", *PAYLOAD_COLUMNS}:
        probes = probes.withColumnRenamed(c, f"probe_{c}")
    right = snapshot.select(F.col("key").alias("__key"), "vtype", *(c for c in snapshot.columns if c not in ("key", "query_id", "vtype")))
    k = probes[key].cast("binary")
    if rows is not None and rows * (key_bytes + ROW_BYTES) <= BROADCAST_BYTES:
        wanted = F.broadcast(probes.select(k.alias("__probe")).distinct())
        right = right.join(wanted, right["__key"] == wanted["__probe"], "left_semi")
    joined = probes.join(right, k == right["__key"], "left")
    return joined.withColumn("exists", F.col("__key").isNotNull()).drop("__key")


def point(snapshot: DataFrame, key: bytes | str) -> DataFrame:
    """The row of one key.  Its query id is derived from the literal, so that partitions can be pruned."""
    raw = key.encode() if isinstance(key, str) else key
    found = snapshot.where(F.col("key") == F.lit(raw))
    if "query_id" in snapshot.columns:
        found = found.where(F.col("query_id") == S.query_id_literal(raw))
    return found


def contained(probes: DataFrame, snapshot: DataFrame, key: str = "key") -> DataFrame:
    return probes.join(snapshot.select("key").withColumnRenamed("key", "__key"), probes[key].cast("binary") == F.col("__key"), "left_semi")


def missing(probes: DataFrame, snapshot: DataFrame, key: str = "key") -> DataFrame:
    return probes.join(snapshot.select("key").withColumnRenamed("key", "__key"), probes[key].cast("binary") == F.col("__key"), "left_anti")


def _is(name: str) -> Column:
    return F.col("vtype") == name


def _text() -> Column:
    return F.col("s").cast("string")


def _texts() -> Column:
    return F.col("sl").cast("array<string>")


def _result(value: Column, exists: Column, default) -> Column:
    found = F.coalesce(exists, F.lit(False))
    return F.struct(F.when(found, value).otherwise(default).alias("value"), found.alias("exists"))


def contains() -> Column:
    return F.coalesce(F.col("exists"), F.lit(False))


def get(default: str = "") -> Column:
    """The String; the default when the key is absent, of another type, or holds an empty String."""
    return F.coalesce(F.nullif(F.when(_is("String"), _text()), F.lit("")), F.lit(default))


def get_string(default: str = "") -> Column:
    """(value, exists); a stored empty String is there."""
    return _result(_text(), _is("String"), F.lit(default))


def get_vector(default: list | None = None) -> Column:
    """The list; the default when the key is absent, of another type, or holds an empty list."""
    other = F.array(*map(F.lit, default or [])).cast("array<string>")
    return F.when(_is("StringList") & (F.size("sl") > 0), _texts()).otherwise(other)


def get_bool(default: bool = False) -> Column:
    """A Bool as it is, an Int64 by whether it is not 0, a String by its text; else the default.  An empty String does
    not count."""
    value = F.when(_is("Bool"), F.col("b")).when(_is("Int64"), F.col("i") != 0).when(_is("String") & (F.length(_text()) > 0), S.to_bool(_text()))
    return _result(value, value.isNotNull(), F.lit(default))


def get_int64(default: int = 0) -> Column:
    value = F.when(_is("Int64"), F.col("i")).when(_is("String") & (F.length(_text()) > 0), S.to_long(_text()))
    return _result(value, value.isNotNull(), F.lit(default).cast("bigint"))


def get_integer(default: int = 0) -> Column:
    """The 64-bit value cut to its low 32 bits."""
    got = get_int64(default)
    return F.struct(S.wrap32(got["value"]).alias("value"), got["exists"].alias("exists"))


def get_double(default: float = 0.0) -> Column:
    """A Double as it is, a String by the lenient grammar; an Int64 is another type."""
    value = F.when(_is("Double"), F.col("d")).when(_is("String") & (F.length(_text()) > 0), S.to_double_lenient(_text()))
    return _result(value, value.isNotNull(), F.lit(float(default)))


def _no_floats() -> Column:
    return F.array().cast("array<float>")


def get_float_vector(strict: bool = False) -> Column:
    """The floats of a FloatList or of a String; of anything else none.  strict: a bad or empty token raises."""
    text = S.float_vector(_text(), strict)
    if strict:
        text = F.when(F.length(_text()) == 0, F.raise_error(F.lit("not a number: ")).cast("array<float>")).otherwise(text)
    return F.when(_is("FloatList"), F.col("fl")).when(_is("String"), text).otherwise(_no_floats())


def get_float_span(strict: bool = False) -> Column:
    """The floats of a FloatList only; strict: a String raises."""
    other = F.when(_is("String"), F.raise_error(F.lit("a String has no float span")).cast("array<float>")).otherwise(_no_floats()) if strict else _no_floats()
    return F.when(_is("FloatList"), F.col("fl")).otherwise(other)


def get_float_at_index(index) -> Column:
    """0 when the key is absent, of another type, or the index is out of range or negative."""
    at = F.lit(index) if isinstance(index, int) else S.col(index)
    return F.coalesce(F.when(at >= 0, F.get(F.col("fl"), at)), F.lit(0.0).cast("float"))


def get_float_at_indices(indices) -> Column:
    at = F.array(*map(F.lit, indices)) if isinstance(indices, (list, tuple)) else S.col(indices)
    return F.transform(at, lambda x: F.coalesce(F.get(F.col("fl"), x), F.lit(0.0).cast("float")))


def get_key_type() -> Column:
    """The type's name; empty when the key is absent or holds an empty FloatList."""
    return F.when(_is("FloatList") & (F.size("fl") == 0), "").otherwise(F.coalesce("vtype", F.lit("")))


def get_with_type() -> Column:
    """(payload, type): the bytes of a String, empty bytes for a list, the typed columns for the rest."""
    return F.struct(
        F.when(_is("String"), F.col("s")).when(_is("StringList"), F.lit(b"")).alias("bytes"), F.col("b").alias("b"), F.col("i").alias("i"), F.col("d").alias("d"), F.col("fl").alias("fl"), F.coalesce("vtype", F.lit("")).alias("vtype")
    )


def read_key() -> Column:
    """A String, or the element of a list of one; else empty."""
    return F.when(_is("String"), _text()).when(_is("StringList") & (F.size("sl") == 1), F.get(_texts(), F.lit(0))).otherwise("")


def read_keys() -> Column:
    """A String as a list of one, even if it is empty, or a list; else empty."""
    return F.when(_is("String"), F.array(_text())).when(_is("StringList"), _texts()).otherwise(F.array().cast("array<string>"))


def get_vector_item(index) -> Column:
    """The element, or null when out of range (also below)."""
    at = F.lit(index) if isinstance(index, int) else S.col(index)
    return F.when(_is("StringList") & (at >= 0), F.get(_texts(), at))


def get_vector_size() -> Column:
    return F.coalesce(F.when(_is("StringList"), F.size("sl")), F.lit(0))


def found_hash(key: str = "key", kind: CacheKind = CacheKind.LINEAR_PROBE) -> Column:
    """XXH3-64 of a key that is there, whatever its type, else 0; a chained cache gives the hash always."""
    if kind == CacheKind.BUCKET_CHAIN:
        return hashing.xxh3_64(key)
    return hashing.found_hash(key, contains())


def gated(getter: Column, kind: CacheKind) -> Column:
    """A typed getter on a kind that has none: the type's zero and not there, whatever the default."""
    if kind.typed_getters:
        return getter
    zero = getter["value"]
    return F.struct(F.when(F.lit(False), zero).alias("value"), F.lit(False).alias("exists"))


#: Getters of the command scan.  Each gives text.
def command_output(command: str = "command", index: str = "idx") -> Column:
    """The answer to ``GET``-style commands joined to the snapshot: a text per row, null for an unknown command."""
    c = F.upper(F.col(command))
    at = F.coalesce(F.col(index), F.lit(0))
    shown = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return (
        F.when(c == "GET", get())
        .when(c == "GETBOOL", get_bool()["value"].cast("string"))
        .when(c == "GETVECTOR", F.array_join(get_vector(), ","))
        .when(c == "GETINTEGER", get_integer()["value"].cast("string"))
        .when(c.isin("GETLONG", "GETINT64"), get_int64()["value"].cast("string"))
        .when(c == "GETDOUBLE", get_double()["value"].cast("string"))
        .when(c == "GETFLOATVECTOR", shown(get_float_vector()))
        .when(c == "GETFLOATSPAN", shown(get_float_span()))
        .when(c == "GETFLOATATINDEX", get_float_at_index(at).cast("string"))
    )


def run_commands(commands: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(command, key, idx) rows with their answers."""
    return lookup(commands, snapshot).select(*commands.columns, command_output().alias("answer"))
