"""Grammars against plain-Python models."""

import ctypes
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstore.functions import hashing
from quillstore.functions import scalars as S

EDGES = """true TRUE True 1 0 yes t 1.0 12abc +12 -5 --5 1_0 9223372036854775807 9223372036854775808 -9223372036854775808 1.5d 1.5f +12.5 12.5x .5 5. -.5 . - 1e e5 1E+10
1e9999 1e-9999 0x1.8p1 inf -inf +inf NaN -nan infinity Infinity -Infinity nan(1) 1e5 -0 007 1..2 1.2.3 1e+ 0x 1e-3x""".split() + ["", " 12", "12.5 ", " 12.5", "1\n", "12\n", "\t7", "٣"]
TEXTS = st.lists(st.sampled_from(list("0123456789+-.eExXpinfatruINF \n|:,ab=é\x00\x01")), max_size=9).map("".join)


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def strict(t):
    low = t.lower()
    if low in ("inf", "infinity"):
        return math.inf
    if low in ("-inf", "-infinity"):
        return -math.inf
    if low in ("nan", "-nan"):
        return math.nan
    if re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t, re.A):
        v = float(t)
        return v if math.isfinite(v) else 0.0
    return 0.0


def lenient(t):
    v = strict(t)
    if v or strict_ok(t):
        return v
    libc = ctypes.CDLL(None)
    libc.strtod.restype = ctypes.c_double
    libc.strtod.argtypes = [ctypes.c_char_p, ctypes.POINTER(ctypes.c_char_p)]
    raw = t.encode()
    if not raw or b"\0" in raw:
        return 0.0
    buffer = ctypes.create_string_buffer(raw)
    end = ctypes.c_char_p()
    start = ctypes.cast(buffer, ctypes.c_char_p)
    v = libc.strtod(start, ctypes.byref(end))
    used = len(raw) - len(end.value)
    return v if used == len(raw) else 0.0


def strict_ok(t):
    return bool(re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t, re.A)) and math.isfinite(float(t))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def check(spark, texts, expression, model):
    got = column(spark, texts, expression)
    for t, g in zip(texts, got, strict=True):
        assert same(g, model(t)), (t, g, model(t))


def fits(t, bits):
    m = re.match("-?[0-9]+", t, re.A)
    return int(m[0]) if m and -(2 ** (bits - 1)) <= int(m[0]) < 2 ** (bits - 1) else 0


def parts(t, sep):
    if t == "":
        return []
    p = t.split(sep)
    return p[:-1] if p[-1] == "" else p


MODELS = {
    "to_bool": (lambda: S.to_bool("t"), lambda t: t.translate({c: c + 32 for c in range(65, 91)}) == "true" or t == "1"),
    "to_long": (lambda: S.to_long("t"), lambda t: fits(t, 64)),
    "to_integer": (lambda: S.to_integer("t"), lambda t: fits(t, 32)),
    "to_double": (lambda: S.to_double("t"), strict),
    "to_double_lenient": (lambda: S.to_double_lenient("t"), lenient),
    "file_list": (lambda: S.file_list("t"), lambda t: sorted(t.split("|"), key=str.encode) if t else []),
    "inserted_list": (lambda: S.inserted_list("t"), lambda t: sorted(parts(t, "|"), key=str.encode)),
    "text_list": (lambda: S.text_list("t"), lambda t: parts(t, "|")),
    "until_nul": (lambda: S.until_nul("t"), lambda t: t.split("\0")[0]),
    "record_key": (lambda: S.record_key("t"), lambda t: (k[1:] if (k := t.split("=")[0]).startswith("\1") else k) if "=" in t else ""),
    "record_value": (lambda: S.record_value("t"), lambda t: t.split("=", 1)[1] if "=" in t else ""),
    "trim": (lambda: S.trim("t"), lambda t: t.strip(" \t\f\v\n\r")),
}


@pytest.mark.parametrize("name", MODELS)
def test_edges(spark, name):
    expression, model = MODELS[name]
    check(spark, [t for t in EDGES if "nan(" not in t], expression(), model)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=40, max_size=80))
def test_random(spark, texts):
    for name in ("to_bool", "to_long", "to_double", "to_double_lenient", "file_list", "inserted_list", "record_key", "record_value"):
        expression, model = MODELS[name]
        check(spark, texts, expression(), model)


def test_query_ids(spark):
    cases = {"12.x": 12, "\x0112.x": 12, "x.1": 0, "12": 0, "": 0, "-3.a": -3, "+4.a": 4, ".a": 0, "99999999999999999999.a": 0, "1.2.3": 1}
    assert column(spark, list(cases), S.query_id("t")) == list(cases.values())
    assert [S.query_id_literal(k) for k in cases] == list(cases.values())


def test_numbers_with_defaults(spark):
    texts = ["12x", "x", "inf", "1e-320", "0", "nan", "1.5e2z"]
    assert column(spark, texts, S.to_number("t", -1.0, normal=True)) == [12.0, -1.0, -1.0, -1.0, 0.0, -1.0, 150.0]
    assert column(spark, texts, S.to_number("t"))[1] is None
    assert column(spark, ["1: 2 :x", "", "3"], S.number_vector("t", default=9.0)) == [[1.0, 2.0, 9.0], [], [3.0]]
    with pytest.raises(Exception, match="not a number"):
        column(spark, ["1:x"], S.number_vector("t", strict=True))
    assert column(spark, ["1:x:", "1e39:2"], S.dictionary_floats("t")) == [[1.0, 0.0], [2.0]]


def test_power_of_two_and_wrap(spark):
    rows = spark.createDataFrame([(v,) for v in (-3, 0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "v bigint")
    assert [r[0] for r in rows.select(S.power_of_two_at_least("v")).collect()] == [1, 1, 1, 2, 4, 4, 8, 1024, 1024, 2048]
    rows = spark.createDataFrame([(v,) for v in (2**31, -1, 2**32 + 5, -(2**31) - 1)], "v bigint")
    assert [r[0] for r in rows.select(S.wrap32("v")).collect()] == [-(2**31), -1, 5, 2**31 - 1]


def test_splits(spark):
    assert column(spark, ["a|b,c", "", "a||"], S.split_any("t", "|,")) == [["a", "b", "c"], [""], ["a", "", ""]]
    assert column(spark, ["a=b=c", "a"], S.split_first("t", "=")) == [["a", "b=c"], ["a"]]
    assert column(spark, ["abc"], S.split_all("t", "")) == [["abc"]]


def test_xxh3(spark):
    import xxhash

    got = column(spark, ["", "key", "é"], hashing.xxh3_64(F.col("t")))
    assert [g & (1 << 64) - 1 for g in got] == [xxhash.xxh3_64_intdigest(t.encode()) for t in ("", "key", "é")]
