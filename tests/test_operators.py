"""Load, lookup, dictionary, statistics."""

import pytest
from pyspark.sql import functions as F

from quillstore.operators import dictionary as D
from quillstore.operators import load as load_ops
from quillstore.operators import lookup as L
from quillstore.operators import stats
from quillstore.sources import records
from quillstore.types import SNAPSHOT, CacheKind, LimitError, OffsetBitsError, StoreError

RS = "\x1e"


def snapshot(spark, rows):
    """rows: key -> (type, value)"""
    at = {"String": 3, "StringList": 4, "Bool": 5, "Int64": 6, "Double": 7, "FloatList": 8}
    out = []
    for k, (t, v) in rows.items():
        row = [k.encode(), 0, t] + [None] * 6
        row[at[t]] = v
        out.append(tuple(row))
    return spark.createDataFrame(out, SNAPSHOT)


STORED = {
    "empty": ("String", b""),
    "text": ("String", b"12.5"),
    "true": ("String", b"TRUE"),
    "floats": ("String", b"1: 2:3"),
    "list": ("StringList", [b"b", b"a"]),
    "one": ("StringList", [b"x"]),
    "nolist": ("StringList", []),
    "yes": ("Bool", True),
    "int": ("Int64", 2**31 + 5),
    "double": ("Double", 2.5),
    "fl": ("FloatList", [1.0, 2.0]),
    "nofl": ("FloatList", []),
}
DEFAULT = {"s": ("D", False), "b": (True, False), "i": (-7, False), "n": (-7, False), "d": (-1.5, False), "v": ["D"], "f": [], "p": []}
#: The coercion matrix: what differs from the defaults.
MATRIX = {
    "empty": {"s": ("", True)},
    "text": {"s": ("12.5", True), "b": (False, True), "i": (12, True), "n": (12, True), "d": (12.5, True), "f": [12.5]},
    "true": {"s": ("TRUE", True), "b": (True, True), "i": (0, True), "n": (0, True), "d": (0.0, True), "f": [None]},
    "floats": {"s": ("1: 2:3", True), "b": (False, True), "i": (1, True), "n": (1, True), "d": (0.0, True), "f": [1.0, 2.0, 3.0]},
    "list": {"v": ["b", "a"]},
    "one": {"v": ["x"]},
    "nolist": {},
    "yes": {"b": (True, True)},
    "int": {"b": (True, True), "i": (2**31 + 5, True), "n": (-(2**31) + 5, True)},
    "double": {"d": (2.5, True)},
    "fl": {"f": [1.0, 2.0], "p": [1.0, 2.0]},
    "nofl": {},
    "missing": {},
    "": {},
}


def test_coercion_matrix(spark):
    probes = spark.createDataFrame([(k,) for k in MATRIX], "key string")
    got = L.lookup(probes, snapshot(spark, STORED)).select(
        "key",
        L.get_string("D").alias("s"),
        L.get_bool(True).alias("b"),
        L.get_int64(-7).alias("i"),
        L.get_integer(-7).alias("n"),
        L.get_double(-1.5).alias("d"),
        L.get_vector(["D"]).alias("v"),
        L.get_float_vector().alias("f"),
        L.get_float_span().alias("p"),
    )
    for row in got.collect():
        expected = DEFAULT | MATRIX[row.key]
        for c, e in expected.items():
            g = tuple(row[c]) if isinstance(e, tuple) else row[c]
            assert g == e, (row.key, c, g, e)


def test_other_getters(spark):
    probes = spark.createDataFrame([(k,) for k in [*STORED, "missing"]], "key string")
    got = {
        r.key: r
        for r in L.lookup(probes, snapshot(spark, STORED), rows=20)
        .select(
            "key",
            L.contains().alias("c"),
            L.get("D").alias("g"),
            L.get_key_type().alias("t"),
            L.read_key().alias("r"),
            L.read_keys().alias("rs"),
            L.get_vector_item(1).alias("i1"),
            L.get_vector_item(-1).alias("im"),
            L.get_vector_size().alias("n"),
            L.get_float_at_index(1).alias("f1"),
            L.get_float_at_index(-1).alias("fm"),
            L.get_float_at_indices([1, 9]).alias("fs"),
            L.found_hash().alias("h"),
            L.get_with_type().alias("w"),
            L.gated(L.get_int64(3), CacheKind.BUCKET_CHAIN).alias("gated"),
        )
        .collect()
    }
    assert [k for k, r in got.items() if not r.c] == ["missing"]
    assert (got["empty"].g, got["text"].g, got["int"].g, got["missing"].g) == ("D", "12.5", "D", "D")
    assert (got["nofl"].t, got["fl"].t, got["missing"].t, got["nolist"].t) == ("", "FloatList", "", "StringList")
    assert (got["one"].r, got["list"].r, got["text"].r, got["int"].r) == ("x", "", "12.5", "")
    assert (got["empty"].rs, got["list"].rs, got["int"].rs) == ([""], ["b", "a"], [])
    assert (got["list"].i1, got["list"].im, got["one"].i1, got["list"].n, got["missing"].n) == ("a", None, None, 2, 0)
    assert (got["fl"].f1, got["fl"].fm, got["fl"].fs, got["text"].f1) == (2.0, 0.0, [2.0, 0.0], 0.0)
    assert got["missing"].h == 0 and got["int"].h != 0
    assert got["text"].w.bytes == b"12.5" and got["list"].w.bytes == b"" and got["list"].w.vtype == "StringList"
    assert (got["int"].gated.value, got["int"].gated.exists) == (None, False)


def test_strict_getters(spark):
    probes = spark.createDataFrame([("true",)], "key string")
    for getter in (L.get_float_vector(True), L.get_float_span(True)):
        with pytest.raises(Exception, match="not a number|no float span"):
            L.lookup(probes, snapshot(spark, STORED)).select(getter).collect()


def test_point_prunes_by_query_id(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(f"{q}.k".encode(), q) for q in range(5)], "key binary, query_id bigint")
    rows.write.partitionBy("query_id").parquet(path)
    found = L.point(spark.read.parquet(path), "3.k")
    assert found.count() == 1
    assert "query_id" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def write(path, text):
    path.write_bytes(text.encode("utf-8", "surrogateescape") if isinstance(text, str) else text)
    return str(path)


def test_scan_order_and_first_wins(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        a = write(tmp_path / "a", RS.join(f"{i % 7}.k=a{i}" for i in range(60)))
        b = write(tmp_path / "b", RS.join(f"{i % 9}.k=b{i}" for i in range(60)) + RS)
        pairs = records.read_pairs(spark, [b, a])
        got = {r.key.decode(): r.s.decode() for r in load_ops.insert(pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"{i}.k": f"b{i}" for i in range(9)}


def test_records_of_all_sorts(spark, tmp_path):
    raw = RS.join(["250.x=foo", "250.x=bar", "\x01999.v=c|a|", "\x01999.w=|", "\x01999.e=", "bad", "=v", "k=", "k2=a=b", "", "n\nl=1"])
    path = write(tmp_path / "f", raw)
    parsed = records.parse_records(records.scan_records(spark, path))
    got = [tuple(r) for r in parsed.orderBy("src_block", "src_ord").select("key", "value", "vtype", "query_id").collect()]
    assert got == [
        ("250.x", "foo", "String", 250), ("250.x", "bar", "String", 250), ("999.v", "c|a|", "StringList", 999), ("999.w", "|", "StringList", 999), ("999.e", "", "StringList", 999),
        ("", "", "String", 0), ("", "v", "String", 0), ("k", "", "String", 0), ("k2", "a=b", "String", 0), ("", "", "String", 0), ("n\nl", "1", "String", 0),
    ]
    lists = {r.key.decode(): r.sl for r in records.to_pairs(parsed).where("vtype = 'StringList'").collect()}
    assert {k: [bytes(x) for x in v] for k, v in lists.items()} == {"999.v": [b"", b"a", b"c"], "999.w": [b"", b""], "999.e": []}
    assert records.parse_records(records.scan_records(spark, path), "drop").count() == 9
    with pytest.raises(Exception, match="without"):
        records.parse_records(records.scan_records(spark, path), "error").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        records.scan_records(spark, str(tmp_path / "none")).count()


def test_typed_text(spark, tmp_path):
    path = write(tmp_path / "t", "1=Bool|2=Int64|3=Double|4=StringList|5=FloatList|6=Nonsense\n1.a=true\n\n 2.a=12 \n3.a=4\n4.a=b|a|\n5.a=1:2\n7.a=x\n")
    got = {r.key.decode(): (r.vtype, r.b, r.i, r.d, [bytes(x) for x in r.sl] if r.sl is not None else None, r.fl) for r in records.read_typed_text(spark, path).collect()}
    assert got == {
        "1.a": ("Bool", True, None, None, None, None),
        "2.a": ("Int64", None, 12, None, None, None),
        "3.a": ("Double", None, None, 4.0, None, None),
        "4.a": ("StringList", None, None, None, [b"b", b"a"], None),
        "5.a": ("FloatList", None, None, None, None, [1.0, 2.0]),
        "7.a": ("String", None, None, None, None, None),
    }
    with pytest.raises(Exception, match="not one"):
        records.read_typed_text(spark, write(tmp_path / "u", "1=Bool\n1.a=b=c\n")).collect()


def test_insert_text(spark):
    rows = [("\x01k.l", "c|a|b|", 0), ("s", "a\0b", 127), ("\x01n", "b\0x|a\0y", 127), ("b", "1", 2), ("i", "12x", 3), ("d", "1.5 ", 4), ("f", "1:2", 7), ("u", "v", 99)]
    got = {r.key.decode(): (r.vtype, next(x for x in (r.s, r.sl, r.b, r.i, r.d, r.fl) if x is not None)) for r in load_ops.insert_text(spark.createDataFrame(rows, "key string, value string, key_type int")).collect()}
    assert {k: (t, [bytes(x) for x in v] if t == "StringList" else bytes(v) if t == "String" else v) for k, (t, v) in got.items()} == {
        "k.l": ("StringList", [b"a", b"b", b"c"]), "s": ("String", b"a"), "n": ("StringList", [b"a", b"b"]), "b": ("Bool", True), "i": ("Int64", 12), "d": ("Double", 0.0), "f": ("FloatList", [1.0, 2.0]), "u": ("String", b"v"),
    }


def test_insert_all(spark):
    rows = [(0, "a", "1", "String"), (1, "a", "2", "String"), (2, "b", "", "Int64"), (3, "b", "", "String"), (4, "a", "3", "String"), (5, "LAST_POPULATE_1", "x", "String")]
    df = spark.createDataFrame(rows, "n int, key string, value string, vtype string")
    assert sorted(r.n for r in load_ops.insert_all(df, F.col("n")).collect()) == [0, 4, 5]
    with pytest.raises(StoreError):
        load_ops.insert_all(df.where("n < 5"), F.col("n"))


def test_run_dedup(spark):
    keys = ["1.a", "1.b", "1.a", "x", "1.b", ".e", ".e", "2.a", "1.a", "x", "\x011.a", "1.a"]
    df = spark.createDataFrame(list(enumerate(keys)), "n int, key string")
    assert sorted(r.n for r in load_ops.dedup_runs(df, F.col("n")).collect()) == [0, 1, 3, 5, 6, 7, 8, 10, 11]


def test_limits_and_configuration(spark):
    good = snapshot(spark, STORED)
    assert load_ops.split_by_limits(good)[1].count() == 0
    long = snapshot(spark, {"k" * 65536: ("String", b"v"), "l": ("StringList", [b"x"] * 65536), "e": ("StringList", [b"x" * 65536]), "v": ("String", b"x" * 16777215)})
    assert {r.reason for r in load_ops.split_by_limits(long)[1].collect()} == {"key too long", "list too long", "list element too long", "value too long"}
    with pytest.raises(Exception, match="too long"):
        load_ops.enforce_limits(long).collect()
    for args, error in (((CacheKind.LINEAR_PROBE, 15, 0.5), OffsetBitsError), ((CacheKind.LINEAR_PROBE, 20, 0.81), LimitError), ((CacheKind.NONE, 20, 0.5), StoreError)):
        with pytest.raises(error):
            load_ops.check_config(*args)


def test_dictionary(spark):
    words = D.dictionary(spark, ["b", "a", "b"])
    assert [tuple(r) for r in words.select("idx", F.col("value").cast("string")).orderBy("idx").collect()] == [(0, "b"), (1, "a")]
    rows = spark.createDataFrame([(1, b"a"), (2, b"z"), (3, b"b"), (4, None)], "n int, v binary")
    encoded = D.encode(rows, words, "v")
    assert sorted((r.n, r.idx) for r in encoded.where("idx is not null").collect()) == [(1, 1), (3, 0)]
    assert sorted(map(tuple, D.decode(encoded, words, "v").select("n", "v").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(LimitError):
        D.dictionary(spark, ["x"] * 65537)
    b = D.DictionaryBuilder(CacheKind.LINEAR_PROBE_DEDUP)
    assert [b.add("v"), b.finish(), b.add("w"), b.finish()] == [0, 0, 1, 1]
    assert D.DictionaryBuilder(CacheKind.LINEAR_PROBE).add("v") == 1


def test_split_dump_and_compare(spark, tmp_path):
    rows = spark.createDataFrame([("1.a", "x"), ("2.b", "y"), ("c", "z")], "key string, value string")
    stats.split_by_query_id(rows, str(tmp_path / "split"))
    assert {(r.query_id, r.value) for r in spark.read.text(str(tmp_path / "split")).collect()} == {(1, "1.a=x"), (2, "2.b=y"), (0, "c=z")}
    stats.write_text(snapshot(spark, STORED), str(tmp_path / "dump"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert sorted(lines) == sorted(["empty=", "text=12.5", "true=TRUE", "floats=1: 2:3", "list=b|a", "one=x", "nolist="])
    source = spark.createDataFrame([("text", "12.5"), ("true", "x"), ("list", "b|a"), ("int", str(2**31 + 5)), ("fl", "1:2"), ("fl", "1"), ("yes", "true"), ("gone", "1")], "key string, value string")
    got = sorted((r.key, r.status) for r in stats.compare(source, snapshot(spark, STORED)).collect())
    assert got == [("fl", "different"), ("fl", "equal"), ("gone", "missing"), ("int", "equal"), ("list", "different"), ("text", "equal"), ("true", "different"), ("yes", "different")]


def test_capacity(spark):
    rows = spark.createDataFrame([(i, f"k{i % 4}".encode()) for i in range(12)], "src_ord int, key binary")
    assert sorted(r.src_ord for r in load_ops.within_capacity(rows, 4, 0.5).collect()) == [0, 1]
    assert load_ops.within_capacity(rows, 100, 0.5).count() == 12
    assert load_ops.within_capacity(rows, 1, 0.5).count() == 0


def test_empty_inputs(spark):
    none = snapshot(spark, {"a": ("String", b"")}).where("false")
    assert load_ops.insert(none.withColumn("src_ord", F.lit(1))).count() == 0
    assert stats.scan_stats(none.withColumn("value", F.lit(b"x"))).first().keys == 0
    assert L.lookup(spark.createDataFrame([("a",)], "key string"), none).select(L.contains().alias("c")).first().c is False
