"""Registered queries over the driver's tables, with their SQL.

Each query applies an operator of this library to relations derived from the tables (``relations``); the SQL states
the same result independently.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from . import relations as R
from .functions import scalars as S
from .operators import dictionary as D
from .operators import load as load_ops
from .operators import lookup as L
from .operators import stats
from .plans.store import SnapshotStore
from .relations import prefixed, table
from .sources.properties import write_properties
from .sources.records import parse_records, read_pairs, to_pairs
from .types import MAX_ELEMENT_BYTES, MAX_KEY_BYTES, MAX_LIST_LENGTH, MAX_VALUE_BYTES, RECORD_SEPARATOR, CacheKind, StoreError

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


def text(name):
    return F.col(name).cast("string").alias(name)


# --- load --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def kv_first_wins_events(spark, sf_dir):
    """First-wins load keyed by user, then a batch lookup of all users."""
    snapshot = load_ops.insert(R.puts(spark, sf_dir))
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("key", prefixed("267.", "user_id"))
    return L.lookup(users, snapshot).select("user_id", L.get_string()["value"].alias("event_type"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def kv_first_wins_full_row(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return load_ops.first_wins(events, F.col("event_id"), ("user_id",))


PUTS = "(SELECT '267.' || user_id AS key, event_type AS v, event_id AS ord FROM events)"


@query(f"SELECT key, count(*) AS attempts, CAST(1 AS BIGINT) AS inserted, count(*) - 1 AS rejected FROM {PUTS} GROUP BY key")
def kv_put_duplicate_report(spark, sf_dir):
    return load_ops.put_report(R.puts(spark, sf_dir)).withColumn("key", text("key"))


@query(f"SELECT key, count(*) AS attempts, count(*) AS inserted, CAST(0 AS BIGINT) AS rejected FROM {PUTS} GROUP BY key")
def kv_put_chained_report(spark, sf_dir):
    return load_ops.put_report(R.puts(spark, sf_dir), CacheKind.BUCKET_CHAIN).withColumn("key", text("key"))


@query(
    """WITH u AS (SELECT '267.' || user_id AS key, 'String' AS vtype, event_type AS v, event_id AS ord FROM events
       UNION ALL SELECT '267.' || user_id, 'StringList', event_type, event_id FROM events WHERE event_id % 2 = 0)
       SELECT key, vtype, arg_min(v, ord) AS v FROM u GROUP BY key, vtype"""
)
def kv_map_insert(spark, sf_dir):
    """A map cache keeps a String and a list of one key apart."""
    p = R.puts(spark, sf_dir)
    lists = p.where("src_ord % 2 = 0").select("key", "query_id", F.lit("StringList").alias("vtype"), F.lit(None).cast("binary").alias("s"), F.array("s").alias("sl"), "b", "i", "d", "fl", "src_ord")
    ints = p.select("key", "query_id", F.lit("Int64").alias("vtype"), F.lit(None).cast("binary").alias("s"), "sl", "b", F.lit(1).cast("bigint").alias("i"), "d", "fl", "src_ord")
    got = load_ops.insert(p.unionByName(lists).unionByName(ints), CacheKind.MAP)
    return got.select(text("key"), "vtype", F.coalesce(F.col("s").cast("string"), F.get("sl", F.lit(0)).cast("string")).alias("v"))


@query("SELECT count(*) AS total_keys, count(DISTINCT user_id) AS unique_keys, count(*) - count(DISTINCT user_id) AS duplicate_keys FROM events")
def kv_load_totals(spark, sf_dir):
    return load_ops.load_totals(R.puts(spark, sf_dir))


@query(
    f"""WITH f AS (SELECT key, min(ord) AS o FROM {PUTS} GROUP BY key ORDER BY o LIMIT 20), e AS (SELECT max(o) AS last, count(*) AS n FROM f)
        SELECT key, count(*) AS n FROM {PUTS} AS p, e WHERE n < 20 OR ord <= last GROUP BY key"""
)
def kv_capacity_guard(spark, sf_dir):
    """Puts that are taken before 20 keys fill 40 slots."""
    kept = load_ops.within_capacity(R.puts(spark, sf_dir), 40, 0.5)
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("key", text("key"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'key too long' WHEN 1 THEN 'list too long' WHEN 2 THEN 'list element too long' WHEN 3 THEN 'value too long' ELSE 'taken' END AS reason
       FROM orders WHERE o_orderkey <= 50"""
)
def kv_limits(spark, sf_dir):
    """Keys, lists, elements and values one over their limits, and some that are just inside."""
    o = table(spark, sf_dir, "orders").where("o_orderkey <= 50").select("o_orderkey", (F.col("o_orderkey") % 5).alias("m"))
    text = F.repeat(F.lit("x"), F.when(F.col("m") == 3, MAX_VALUE_BYTES).otherwise(10).cast("int")).cast("binary")
    items = F.when(F.col("m") == 1, F.array_repeat(F.lit(b""), MAX_LIST_LENGTH + 1)).when(F.col("m") == 2, F.array(F.repeat(F.lit("x"), F.lit(MAX_ELEMENT_BYTES + 1)).cast("binary")))
    key = F.repeat(F.lit("k"), F.when(F.col("m") == 0, MAX_KEY_BYTES + 1).otherwise(MAX_KEY_BYTES).cast("int")).cast("binary")
    pairs = o.select("o_orderkey", key.alias("key"), F.when(items.isNull(), "String").otherwise("StringList").alias("vtype"), F.when(items.isNull(), text).alias("s"), items.alias("sl"), *(F.lit(None).cast(t).alias(c) for c, t in (("b", "boolean"), ("i", "bigint"), ("d", "double"), ("fl", "array<float>"))))
    taken, refused = load_ops.split_by_limits(pairs)
    return taken.select("o_orderkey", F.lit("taken").alias("reason")).unionByName(refused.select("o_orderkey", "reason"))


@query("SELECT event_id, event_type, user_id FROM events QUALIFY lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type")
def kv_consecutive_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), "user_id")
    return load_ops.drop_consecutive(rows, F.col("event_id")).withColumnRenamed("key", "event_type")


@query(
    """WITH e AS (SELECT event_id, event_type || '.' || (user_id % 3) AS key, event_type AS p FROM events),
       n AS (SELECT *, CASE WHEN lag(p) OVER (ORDER BY event_id) IS NOT DISTINCT FROM p THEN 0 ELSE 1 END AS new FROM e),
       r AS (SELECT *, sum(new) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM n)
       SELECT event_id, key FROM r QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY event_id) = 1"""
)
def kv_run_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("."), (F.col("user_id") % 3).cast("string")).alias("key"))
    return load_ops.dedup_runs(rows, F.col("event_id"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS v, CASE WHEN o_orderstatus = 'F' THEN 'Int64' ELSE 'String' END AS t FROM orders)
       SELECT o_orderkey, t AS vtype, CASE WHEN t = 'Int64' THEN NULL ELSE v END AS s,
       CASE WHEN t = 'Int64' THEN CAST(regexp_extract(v, '^-?[0-9]+') AS BIGINT) END AS i FROM r"""
)
def kv_insert_typed_text(spark, sf_dir):
    """Text inserted under a numeric type tag."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(0).alias("key_type"))
    got = load_ops.insert_text(rows)
    return got.select(F.col("key").cast("string").cast("bigint").alias("o_orderkey"), "vtype", text("s"), "i")


# --- lookup ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def kv_contains_semi(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select("c_custkey", prefixed("999.", "c_custkey").alias("key"))
    return L.contained(probes, R.string_lists(spark, sf_dir)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def kv_missing_anti(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select("c_custkey", prefixed("999.", "c_custkey").alias("key"))
    return L.missing(probes, R.string_lists(spark, sf_dir)).select("c_custkey")


def probes(spark, sf_dir, prefix):
    """Keys of users, half of which exist as customers or orders."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 13).alias("id")).withColumn("key", prefixed(prefix, "id"))


@query("SELECT event_id, coalesce(nullif(c_mktsegment, ''), 'none') AS v FROM events LEFT JOIN customer ON c_custkey = user_id * 13")
def kv_get_default(spark, sf_dir):
    return L.lookup(probes(spark, sf_dir, "267."), R.strings(spark, sf_dir)).select("event_id", L.get("none").alias("v"))


@query("SELECT event_id, coalesce(c_mktsegment, 'none') AS v, c_custkey IS NOT NULL AS found FROM events LEFT JOIN customer ON c_custkey = user_id * 13")
def kv_get_string_exists(spark, sf_dir):
    got = L.get_string("none")
    return L.lookup(probes(spark, sf_dir, "267."), R.strings(spark, sf_dir)).select("event_id", got["value"].alias("v"), got["exists"].alias("found"))


@query("SELECT doc_id, coalesce(toxic <> 0, false) AS v, toxic IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)")
def kv_get_bool(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", prefixed("992.", "doc_id").alias("key"))
    got = L.get_bool()
    return L.lookup(p, R.bools(spark, sf_dir)).select("doc_id", got["value"].alias("v"), got["exists"].alias("found"))


@query("SELECT o_orderkey, o_custkey % 2 <> 0 AS v FROM orders")
def kv_get_bool_from_int(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    snapshot = orders.select(*load_ops.put(prefixed("1690.", "o_orderkey"), F.col("o_custkey") % 2, 3))
    return L.lookup(orders.select("o_orderkey", prefixed("1690.", "o_orderkey").alias("key")), snapshot).select("o_orderkey", L.get_bool()["value"].alias("v"))


BOOL_WORDS = "CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'yes' WHEN 4 THEN '0' WHEN 5 THEN 't' ELSE '1.0' END"


@query("SELECT o_orderkey, o_orderkey % 7 < 3 AS v FROM orders")
def kv_get_bool_from_string(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", prefixed("1690.", "o_orderkey").alias("key"), F.expr(BOOL_WORDS).alias("t"))
    return L.lookup(orders.select("o_orderkey", "key"), orders.select(*load_ops.put("key", "t", 0))).select("o_orderkey", L.get_bool()["value"].alias("v"))


@query("SELECT event_id, coalesce(o_custkey, CAST(-1 AS BIGINT)) AS v, o_custkey IS NOT NULL AS found FROM events LEFT JOIN orders ON o_orderkey = user_id * 13")
def kv_get_int64(spark, sf_dir):
    got = L.get_int64(-1)
    return L.lookup(probes(spark, sf_dir, "1690."), R.int64s(spark, sf_dir)).select("event_id", got["value"].alias("v"), got["exists"].alias("found"))


@query("SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(replace(p_brand, 'Brand#', ''), '^-?[0-9]+'), '') AS BIGINT), 0) AS v FROM part")
def kv_get_int64_from_string(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", prefixed("1401.", "p_partkey").alias("key"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("t"))
    return L.lookup(part.select("p_partkey", "key"), part.select(*load_ops.put("key", "t", 0))).select("p_partkey", L.get_int64()["value"].alias("v"))


@query("SELECT o_orderkey, CAST(CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END AS INTEGER) AS v FROM (SELECT o_orderkey, (o_orderkey * 1000003) % 4294967296 AS m FROM orders)")
def kv_get_integer_wrap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", prefixed("1690.", "o_orderkey").alias("key"), (F.col("o_orderkey") * 1000003).alias("n"))
    return L.lookup(orders.select("o_orderkey", "key"), orders.select(*load_ops.put("key", "n", 3))).select("o_orderkey", L.get_integer()["value"].alias("v"))


@query("SELECT event_id, coalesce(p_retailprice, -1.0::DOUBLE) AS v, p_retailprice IS NOT NULL AS found FROM events LEFT JOIN part ON p_partkey = user_id * 13")
def kv_get_double(spark, sf_dir):
    got = L.get_double(-1.0)
    return L.lookup(probes(spark, sf_dir, "1401."), R.doubles(spark, sf_dir)).select("event_id", got["value"].alias("v"), got["exists"].alias("found"))


#: Text numbers, what the strict grammar gives, and what the lenient one gives.
NUMBERS = [
    ("1.5d", 0.0, 0.0), ("1.5f", 0.0, 0.0), (" 12.5", 0.0, 12.5), ("+12.5", 0.0, 12.5), ("12.5 ", 0.0, 0.0), ("12.5x", 0.0, 0.0),
    (".5", 0.5, 0.5), ("5.", 5.0, 5.0), ("-.5", -0.5, -0.5), (".", 0.0, 0.0), ("-", 0.0, 0.0), ("1e", 0.0, 0.0), ("e5", 0.0, 0.0),
    ("1E+10", 1e10, 1e10), ("1e-9999", 0.0, 0.0), ("0x1.8p1", 0.0, 3.0), ("0x10", 0.0, 16.0), (" -0X1f", 0.0, -31.0), ("0x.8", 0.0, 0.5), ("12", 12.0, 12.0), ("1_0", 0.0, 0.0),
]


def _numbers(at: int) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', CAST({r[at]} AS DOUBLE))" for r in NUMBERS) + ") AS t(t, v)"


def numbers(spark):
    return spark.range(1).select(F.explode(F.array(*(F.lit(r[0]) for r in NUMBERS))).alias("t"))


@query(_numbers(1))
def kv_double_strict(spark, sf_dir):
    return numbers(spark).select("t", S.to_double("t").alias("v"))


@query(_numbers(2))
def kv_get_double_lenient(spark, sf_dir):
    rows = numbers(spark).withColumn("key", prefixed("1.", "t"))
    return L.lookup(rows, rows.select(*load_ops.put("key", "t", 0))).select("t", L.get_double()["value"].alias("v"))


CUSTOMER_LISTS = "SELECT c_custkey, l FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(o_orderpriority)) AS l FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"


def customer_lists(spark, sf_dir):
    return L.lookup(table(spark, sf_dir, "customer").select("c_custkey", prefixed("999.", "c_custkey").alias("key")), R.string_lists(spark, sf_dir))


@query(f"SELECT c_custkey, coalesce(array_to_string(l, '|'), 'none') AS v FROM ({CUSTOMER_LISTS})")
def kv_get_vector(spark, sf_dir):
    return customer_lists(spark, sf_dir).select("c_custkey", S.join_list(L.get_vector(["none"])).alias("v"))


@query(f"SELECT c_custkey, CAST(coalesce(len(l), 0) AS INTEGER) AS n FROM ({CUSTOMER_LISTS})")
def kv_vector_size(spark, sf_dir):
    return customer_lists(spark, sf_dir).select("c_custkey", L.get_vector_size().alias("n"))


@query(f"SELECT c_custkey, l[2] AS second, l[101] AS beyond FROM ({CUSTOMER_LISTS})")
def kv_vector_item(spark, sf_dir):
    return customer_lists(spark, sf_dir).select("c_custkey", L.get_vector_item(1).alias("second"), L.get_vector_item(100).alias("beyond"))


@query(f"SELECT c_custkey, CASE WHEN len(l) = 1 THEN l[1] ELSE '' END AS v FROM ({CUSTOMER_LISTS})")
def kv_read_key(spark, sf_dir):
    return customer_lists(spark, sf_dir).select("c_custkey", L.read_key().alias("v"))


@query(f"SELECT c_custkey, coalesce(array_to_string(l, '|'), '') AS v FROM ({CUSTOMER_LISTS}) UNION ALL SELECT -c_custkey, c_mktsegment FROM customer")
def kv_read_keys(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("c_custkey"), prefixed("267.", "c_custkey").alias("key"))
    both = customer_lists(spark, sf_dir).unionByName(L.lookup(p, R.strings(spark, sf_dir)))
    return both.select("c_custkey", S.join_list(L.read_keys()).alias("v"))


@query("SELECT vec_id, coalesce(embedding[1], 0) AS f0, coalesce(embedding[6], 0) AS f5, CAST(0 AS FLOAT) AS below, coalesce(embedding[65], 0) AS beyond FROM embeddings")
def kv_float_at_index(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", prefixed("1909.", "vec_id").alias("key"))
    at = L.get_float_at_index
    return L.lookup(p, R.float_lists(spark, sf_dir)).select("vec_id", at(0).alias("f0"), at(5).alias("f5"), at(-1).alias("below"), at(64).alias("beyond"))


@query("SELECT vec_id, unnest([1, 2, 3]) AS place, unnest([coalesce(embedding[4], 0), coalesce(embedding[64], 0), coalesce(embedding[1000], 0)]) AS v FROM embeddings")
def kv_float_gather(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", prefixed("1909.", "vec_id").alias("key"))
    got = L.lookup(p, R.float_lists(spark, sf_dir)).select("vec_id", F.posexplode(L.get_float_at_indices([3, 63, 999])).alias("place", "v"))
    return got.select("vec_id", (F.col("place") + 1).alias("place"), "v")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first FROM embeddings")
def kv_float_span(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", prefixed("1909.", "vec_id").alias("key"))
    span = L.get_float_span()
    return L.lookup(p, R.float_lists(spark, sf_dir)).select("vec_id", F.size(span).alias("n"), F.get(span, F.lit(0)).alias("first"))


@query(
    """SELECT vtype, count(*) AS n FROM (SELECT 'String' AS vtype FROM customer UNION ALL SELECT 'Bool' FROM labels UNION ALL SELECT 'Int64' FROM orders
       UNION ALL SELECT 'Double' FROM part
       UNION ALL SELECT 'StringList' FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT 'FloatList' FROM embeddings) GROUP BY vtype"""
)
def kv_key_type(spark, sf_dir):
    every = R.all_types(spark, sf_dir)
    return L.lookup(every.select("key"), every).select(L.get_key_type().alias("vtype")).groupBy("vtype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, 3 AS n, CAST(vec_id AS FLOAT) AS a, CAST(0.5 AS FLOAT) AS b, CAST(-2 AS FLOAT) AS c FROM embeddings")
def kv_float_list_parse(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(": .5 :-2")).alias("t"))
    got = e.select("vec_id", S.float_vector("t").alias("f"))
    return got.select("vec_id", F.size("f").alias("n"), F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b"), F.get("f", F.lit(2)).alias("c"))


@query("SELECT o_orderkey, o_orderkey % 2 = 1 AS there FROM orders")
def kv_found_hash(spark, sf_dir):
    """XXH3 of keys that are there, else 0."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", prefixed("1690.", "o_orderkey").alias("key"))
    snapshot = orders.where("o_orderkey % 2 = 1").select(*load_ops.put("key", "o_orderkey", 3))
    return L.lookup(orders, snapshot).select("o_orderkey", (L.found_hash() != 0).alias("there"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN coalesce(nullif(c_mktsegment, ''), '') WHEN 1 THEN 'false' WHEN 2 THEN '0' ELSE '' END AS answer
       FROM events LEFT JOIN customer ON c_custkey = user_id * 13"""
)
def kv_commands(spark, sf_dir):
    """A command table: GET, GETBOOL, GETINT64 and GETVECTOR on Strings."""
    c = probes(spark, sf_dir, "267.").withColumn("command", F.expr("CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'GETBOOL' WHEN 2 THEN 'GETINT64' ELSE 'GETVECTOR' END")).withColumn("idx", F.lit(0))
    return L.run_commands(c, R.strings(spark, sf_dir)).select("event_id", "answer")


# --- records, statistics, dictionary -------------------------------------------------------------------------------


def records(spark, sf_dir):
    """Text records: plain, with several ``=``, flagged lists, and some without ``=``."""
    e = F.expr("CASE event_id % 4 WHEN 0 THEN concat(user_id, '.k=', event_type, '=x') WHEN 1 THEN concat(chr(1), user_id, '.l=b|a|') WHEN 2 THEN event_type ELSE concat(user_id, '=') END")
    return table(spark, sf_dir, "events").select("event_id", e.alias("record"))


RECORDS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || '.k' WHEN 1 THEN user_id || '.l' WHEN 2 THEN '' ELSE user_id || '' END AS key,
 CASE event_id % 4 WHEN 0 THEN event_type || '=x' WHEN 1 THEN 'b|a|' ELSE '' END AS value, CASE event_id % 4 WHEN 1 THEN 'StringList' ELSE 'String' END AS vtype,
 CASE WHEN event_id % 4 < 2 THEN user_id ELSE 0 END AS query_id FROM events"""


@query(RECORDS)
def kv_record_parse(spark, sf_dir):
    r = records(spark, sf_dir).withColumnRenamed("event_id", "src_ord")
    return parse_records(r).select(F.col("src_ord").alias("event_id"), "key", "value", "vtype", "query_id")


@query("SELECT event_id, '|a|b' AS v FROM events WHERE event_id % 4 = 1")
def kv_record_lists(spark, sf_dir):
    """List values of a record file keep empty parts and are sorted by bytes."""
    r = to_pairs(parse_records(records(spark, sf_dir).withColumnRenamed("event_id", "src_ord"))).where("vtype = 'StringList'")
    return r.select(F.col("src_ord").alias("event_id"), S.join_list(F.col("sl").cast("array<string>")).alias("v"))


EVERY_KEY = "SELECT '267.' || c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL SELECT '1690.' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT event_type, '' FROM events"


def every_key(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(prefixed("267.", "c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    b = table(spark, sf_dir, "orders").select(prefixed("1690.", "o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit("").alias("value"))
    return a.unionAll(b).unionAll(c)


@query(f"SELECT k AS key, coalesce(TRY_CAST(nullif(regexp_extract(k, '^([+-]?[0-9]+)[.]', 1), '') AS BIGINT), 0) AS query_id FROM ({EVERY_KEY})")
def kv_query_id(spark, sf_dir):
    return every_key(spark, sf_dir).select("key", S.query_id("key").alias("query_id"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT)), (267), (1690)) AS t(query_id)")
def kv_distinct_query_ids(spark, sf_dir):
    return stats.distinct_query_ids(every_key(spark, sf_dir))


@query(
    f"""SELECT count(*) AS keys, CAST(sum(strlen(k)) AS BIGINT) AS key_bytes, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes, CAST(min(strlen(k)) AS INTEGER) AS min_key,
        CAST(max(strlen(k)) AS INTEGER) AS max_key, CAST(min(strlen(v)) AS INTEGER) AS min_value, CAST(max(strlen(v)) AS INTEGER) AS max_value FROM ({EVERY_KEY})"""
)
def kv_scan_stats(spark, sf_dir):
    return stats.scan_stats(every_key(spark, sf_dir))


@query(f"SELECT coalesce(TRY_CAST(nullif(regexp_extract(k, '^([+-]?[0-9]+)[.]', 1), '') AS BIGINT), 0) AS query_id, count(*) AS n FROM ({EVERY_KEY}) GROUP BY 1")
def kv_split_counts(spark, sf_dir):
    """Lines per query id, read back from the folders that a split writes."""
    folder = shared_folder(spark)
    stats.split_by_query_id(every_key(spark, sf_dir), folder)
    return spark.read.text(folder).groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))


TOP = """SELECT event_type AS v FROM events UNION ALL SELECT p_name FROM part UNION ALL SELECT c_mktsegment FROM customer"""


@query(f"SELECT v AS value, count(*) AS count, count(*) * CAST(strlen(v) AS BIGINT) AS score FROM ({TOP}) GROUP BY v HAVING count(*) > 1 ORDER BY score DESC, value LIMIT 16")
def kv_top_values(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("v")).unionAll(table(spark, sf_dir, "part").select("p_name")).unionAll(table(spark, sf_dir, "customer").select("c_mktsegment"))
    return D.top_values(t, "v", 16)


def part_words(spark, sf_dir):
    return D.from_top(D.top_values(table(spark, sf_dir, "part"), "p_type", 8))


@query(
    """WITH s AS (SELECT p_type AS v, count(*) * strlen(p_type) AS score FROM part GROUP BY p_type HAVING count(*) > 1 ORDER BY score DESC, v LIMIT 8),
       d AS (SELECT CAST(row_number() OVER (ORDER BY score, v) - 1 AS INTEGER) AS idx, v FROM s)
       SELECT p_partkey, idx, CASE WHEN idx IS NULL THEN p_type END AS rest FROM part LEFT JOIN d ON v = p_type"""
)
def kv_dict_encode(spark, sf_dir):
    return D.encode(table(spark, sf_dir, "part").select("p_partkey", "p_type"), part_words(spark, sf_dir), "p_type")


@query("SELECT p_partkey, p_type FROM part")
def kv_dict_roundtrip(spark, sf_dir):
    words = part_words(spark, sf_dir)
    return D.decode(D.encode(table(spark, sf_dir, "part").select("p_partkey", "p_type"), words, "p_type"), words, "p_type")


@query("SELECT n - 1 AS duplicates, count(*) AS keys FROM (SELECT count(*) AS n FROM events GROUP BY user_id) GROUP BY 1")
def kv_duplicate_histogram(spark, sf_dir):
    return stats.duplicate_histogram(R.puts(spark, sf_dir))


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'different' ELSE 'equal' END AS status FROM orders) GROUP BY status"""
)
def kv_compare_snapshots(spark, sf_dir):
    """A text source against a snapshot that lacks some keys and differs in others."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", prefixed("1690.", "o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    held = orders.where("o_orderkey % 5 <> 0").select(*load_ops.put("key", F.col("value").cast("bigint") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0), 3))
    return stats.comparison_counts(stats.compare(orders.select("key", "value"), held))


def shared_folder(spark) -> str:
    """A new folder that the driver and all executors see: under the cluster's checkpoint folder, else, where all runs in
    this process, under the temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise StoreError("spark.checkpoint.dir must name a shared folder")
    return f"{base or tempfile.gettempdir()}/catalog-{uuid.uuid4().hex}"


def published(spark, sf_dir, **options) -> SnapshotStore:
    """A store with one version of ``events`` per event type; its time is the first event of the type."""
    store = SnapshotStore(spark, shared_folder(spark))
    events = table(spark, sf_dir, "events")
    firsts = sorted((r[1], r[0]) for r in events.groupBy("event_type").agg(F.min("event_id")).collect())  # five types
    pairs = R.puts(spark, sf_dir)
    for ts, kind in firsts:
        store.publish("events", pairs.where(F.col("s") == F.lit(kind.encode())), timestamp=int(ts), **options)
    return store


VERSIONS = "(SELECT min(event_id) AS ts, count(DISTINCT user_id) AS entries, count(*) AS puts, event_type FROM events GROUP BY event_type)"


@query(f"SELECT max(ts) AS ts, arg_max(entries, ts) AS entries, arg_max(event_type, ts) AS v FROM {VERSIONS}")
def kv_latest_snapshot(spark, sf_dir):
    """Publish versions, then open the latest one."""
    store = published(spark, sf_dir)
    ts = store.latest_timestamp("events")
    return store.open("events").agg(F.count(F.lit(1)).alias("entries"), F.max(F.col("s").cast("string")).alias("v")).select(F.lit(ts).cast("bigint").alias("ts"), "entries", "v")


@query(f"SELECT ts, entries FROM {VERSIONS} QUALIFY row_number() OVER (ORDER BY ts DESC) <= 2")
def kv_retention(spark, sf_dir):
    """Versions that are left after all but the newest two are removed, by their manifests."""
    store = published(spark, sf_dir)
    store.retain("events", 2)
    return store.manifests("events").select(F.col("creation_time_ms").alias("ts"), F.col("number_of_entries").alias("entries"))


@query(f"SELECT ts, entries AS number_of_entries, entries AS unique_keys, (SELECT max(n) - 1 FROM (SELECT count(*) AS n FROM events e WHERE e.event_type = v.event_type GROUP BY user_id)) AS max_collisions FROM {VERSIONS} v")
def kv_manifests(spark, sf_dir):
    return published(spark, sf_dir).manifests("events").select(F.col("creation_time_ms").alias("ts"), "number_of_entries", "unique_keys", "max_collisions")


@query(f"SELECT arg_max(ts, ts) AS ts, arg_max(entries, ts) AS entries FROM {VERSIONS} WHERE ts <= (SELECT ts FROM {VERSIONS} ORDER BY ts LIMIT 1 OFFSET 2)")
def kv_open_as_of(spark, sf_dir):
    """The version at the time of the third one."""
    store = published(spark, sf_dir)
    ts = store.timestamps("events")[2]
    return store.open_as_of("events", ts).agg(F.count(F.lit(1)).alias("entries")).select(F.lit(ts).cast("bigint").alias("ts"), "entries")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS idx, r_name AS v FROM region")
def kv_publish_dictionary(spark, sf_dir):
    """The explicit dictionary of a published version, read back."""
    words = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("idx"), F.col("r_name").cast("binary").alias("s"), F.lit(None).cast("array<float>").alias("fl"))
    store = SnapshotStore(spark, shared_folder(spark))
    store.publish("customers", R.strings(spark, sf_dir).limit(0), words=words, timestamp=1)
    return store.dictionary("customers").select(F.col("idx").cast("bigint").alias("idx"), F.col("s").cast("string").alias("v"))


@query("SELECT user_id, arg_min(event_type, (event_type, event_id)) AS v FROM events GROUP BY user_id")
def kv_folder_first_wins(spark, sf_dir):
    """First-wins over a folder of record files, which follow each other by name."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat_ws("=", F.concat(F.lit("267."), "user_id"), "event_type").alias("record"))
    for (kind,) in sorted(events.select("event_type").distinct().collect()):  # five types, a file each
        lines = events.where(F.col("event_type") == kind).orderBy("event_id").coalesce(1).select("record")
        lines.write.option("lineSep", RECORD_SEPARATOR).text(f"{folder}/{kind}")
    got = load_ops.insert(read_pairs(spark, f"{folder}/*"))
    return got.select(F.substring_index(F.col("key").cast("string"), ".", -1).cast("bigint").alias("user_id"), F.col("s").cast("string").alias("v"))


@query(
    """SELECT '267.' || c_custkey || '=' || c_mktsegment AS value, 'String' AS vtype FROM customer
       UNION ALL SELECT '999.' || o_custkey || '=' || array_to_string(list_sort(list(o_orderpriority)), '|'), 'StringList' FROM orders GROUP BY o_custkey"""
)
def kv_text_dump(spark, sf_dir):
    return stats.text_lines(R.strings(spark, sf_dir).unionByName(R.string_lists(spark, sf_dir)).unionByName(R.int64s(spark, sf_dir)))


@query("""SELECT '"267.' || c_custkey || '":{"type":"String", "value":"' || c_mktsegment || '"}' AS line FROM customer UNION ALL SELECT '"1690.' || o_orderkey || '":{"type":"Int64", "value":' || o_custkey || '}' FROM orders""")
def kv_debug_json(spark, sf_dir):
    return R.strings(spark, sf_dir).unionByName(R.int64s(spark, sf_dir)).select(stats.debug_json().alias("line"))


@query("SELECT n_name || '=' || n_regionkey AS line FROM nation ORDER BY line")
def kv_properties_sorted(spark, sf_dir):
    """A property file of the nations (25 rows), written and read back line by line."""
    with tempfile.TemporaryDirectory() as folder:  # a property file is the driver's own
        write_properties(f"{folder}/nations", {r[0]: r[1] for r in table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()})
        with open(f"{folder}/nations", encoding="utf-8") as f:
            lines = f.read().splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT vec_id, 3 AS n, CAST(vec_id AS FLOAT) AS a, CAST(-2 AS FLOAT) AS c FROM embeddings")
def kv_get_float_vector(spark, sf_dir):
    """The float-list getter on Strings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", prefixed("1.", "vec_id").alias("key"), F.concat(F.col("vec_id").cast("string"), F.lit(": .5 :-2")).alias("t"))
    got = L.lookup(e.select("vec_id", "key"), e.select(*load_ops.put("key", "t", 0))).select("vec_id", L.get_float_vector().alias("f"))
    return got.select("vec_id", F.size("f").alias("n"), F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(2)).alias("c"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS text, CASE WHEN c_custkey % 2 = 0 THEN 'String' ELSE '' END AS vtype FROM customer")
def kv_get_with_type(spark, sf_dir):
    """Raw bytes and the type of a key; nothing for a missing one."""
    p = table(spark, sf_dir, "customer").select("c_custkey", prefixed("267.", "c_custkey").alias("key"))
    got = L.lookup(p, R.strings(spark, sf_dir).where(F.pmod(F.substring_index(F.col("key").cast("string"), ".", -1).cast("bigint"), F.lit(2)) == 0))
    one = L.get_with_type()
    return got.select("c_custkey", F.coalesce(one["bytes"].cast("string"), F.lit("")).alias("text"), one["vtype"].alias("vtype"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND event_id % 3 = 0)")
def kv_drop_empty_typed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise("x").alias("value"), F.when(F.col("event_type") == "click", "Int64").otherwise("String").alias("vtype"))
    return load_ops.drop_empty_typed(e).select("event_id")


SPLITS = "CASE doc_id % 4 WHEN 0 THEN 'a|b|' WHEN 1 THEN '|' WHEN 2 THEN '' ELSE 'x=y=z' END"


@query(
    f"""SELECT doc_id, CAST(len(string_split(t, '|')) AS INTEGER) AS every, CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS parts,
        CASE WHEN doc_id % 4 = 3 THEN 'y=z' END AS rest, CAST(CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS INTEGER) AS chars FROM (SELECT doc_id, {SPLITS} AS t FROM documents)"""
)
def kv_splits(spark, sf_dir):
    """Splits that keep every part, that drop an empty last one, that split once, and at any of several characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(SPLITS).alias("t"))
    return d.select("doc_id", F.size(S.split_all("t")).alias("every"), F.size(S.split_parts("t", "|")).alias("parts"), F.get(S.split_first("t", "="), F.lit(1)).alias("rest"), F.size(S.split_any("t", "|=")).alias("chars"))


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 12 WHEN 1 THEN -5 ELSE NULL END AS INTEGER) AS i, CASE o_orderkey % 3 WHEN 0 THEN 12.5 WHEN 1 THEN -5.0 ELSE 7.0 END::DOUBLE AS d,
       CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(2 ** ceil(log2(o_orderkey)) AS BIGINT) END AS p FROM orders"""
)
def kv_numbers(spark, sf_dir):
    """Leading numbers with and without a default, and the next power of two."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN '12.5x' WHEN 1 THEN '-5 ' ELSE 'x' END").alias("t"))
    return o.select("o_orderkey", S.to_int32("t").alias("i"), S.to_number("t", 7.0).alias("d"), S.power_of_two_at_least("o_orderkey").alias("p"))


@query("SELECT doc_id, lower(CASE WHEN doc_id % 2 = 0 THEN 'Ab C' ELSE 'TRUE' END) AS low, 'a b' AS trimmed, 'ab' AS head FROM documents")
def kv_text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Ab C").otherwise("TRUE").alias("t"))
    return d.select("doc_id", S.lowercase("t").alias("low"), S.trim(F.lit(" \ta b\r\n")).alias("trimmed"), S.until_nul(F.lit("ab\x00c")).alias("head"))
