"""Snapshots, refresh, facades, downloads, settings and the binary format."""

import os

import pytest

from quillstore.api import Reader, Writer
from quillstore.operators import load as load_ops
from quillstore.plans.files import Files
from quillstore.plans.store import SnapshotStore, build, parse_version
from quillstore.sources import binary
from quillstore.sources.properties import Settings, WriterConfig, load_jobs, read_properties, write_properties, writer_config
from quillstore.streaming import download
from quillstore.streaming.refresh import Refresher, retry, wait_for
from quillstore.types import CacheKind, KeySpaceFullError, LimitError, MalformedSnapshotError, NotFoundError, OffsetBitsError, StoreError, UninitializedError, ValueType


def pairs(spark, rows):
    schema = "key string, value string, key_type int, src_ord int"
    return load_ops.insert_text(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema))


def test_publish_open_retain(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    with pytest.raises(NotFoundError):
        store.latest_timestamp("a")
    rows = [("1.k", "v", 0), ("1.k", "w", 0), ("2.k", "5", 3), ("k", "1:2", 7)]
    assert store.publish("a", pairs(spark, rows), timestamp=100) == 100
    store.publish("a", pairs(spark, [("1.k", "new", 0)]), timestamp=200)
    assert store.timestamps("a") == [100, 200] and store.latest_timestamp("a") == 200
    m = store.manifest("a", 100)
    assert (m.number_of_entries, m.unique_keys, m.max_collisions, m.name) == (3, 3, 1, "a")
    assert dict(m.header_info())["hashcode_bits"] == "29"
    assert {bytes(r.key): r.s for r in store.open("a").collect()} == {b"1.k": b"new"}
    assert store.open("a", 100).count() == 3 and store.open_as_of("a", 150).count() == 3
    assert store.manifests("a").count() == 2
    with pytest.raises(NotFoundError):
        store.open_as_of("a", 50)
    assert [store.reload("a")[0], store.reload("a")[0]] == [True, False]
    with pytest.raises(MalformedSnapshotError):
        store.open("a", kind=CacheKind.LINEAR_PROBE)
    with pytest.raises(MalformedSnapshotError):
        store.open_path(str(tmp_path / "nothing"))
    assert store.retain("a") == [100] and store.timestamps("a") == [200]
    assert parse_version("x/a.b.12.snapshot") == ("a.b", 12)


def test_failed_publish_keeps_the_pointer(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("a", pairs(spark, [("k", "v", 0)]), timestamp=1)
    with pytest.raises(KeySpaceFullError):
        store.publish("a", pairs(spark, [("k", "v", 0), ("l", "v", 0)]), timestamp=2, number_of_key_slots=2)
    with pytest.raises(Exception, match="too long"):
        store.publish("a", pairs(spark, [("k" * 70000, "v", 0)]), timestamp=3)
    assert store.latest_timestamp("a") == 1 and store.timestamps("a") == [1]
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".staging") and not f.endswith(".crc")]


def test_kinds(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = [("k", "v", 0), ("k", "w", 0), ("\x01k", "a", 0), ("i", "1", 3)]
    store.publish("m", pairs(spark, rows), CacheKind.MAP, timestamp=1)
    assert sorted(r.vtype for r in store.open("m").collect()) == ["String", "StringList"]
    store.publish("c", pairs(spark, rows), CacheKind.BUCKET_CHAIN, timestamp=1)
    assert (store.manifest("c").number_of_entries, store.manifest("c").unique_keys) == (4, 2)


def test_hot_swap(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("a", pairs(spark, [("k", "old", 0)]), timestamp=1)
    seen = []
    r = Refresher(store, "a", "live", seen.append)
    assert r.poll() and not r.poll()
    held = spark.table("live")
    store.publish("a", pairs(spark, [("k", "new", 0)]), timestamp=2)
    assert bytes(spark.table("live").first().s) == b"old"
    query = r.follow(str(tmp_path / "progress"))
    assert query.awaitTermination(60)
    assert bytes(spark.table("live").first().s) == b"new" and bytes(held.first().s) == b"old" and seen == [1, 2]
    with pytest.raises(NotFoundError):
        r.update(99)
    assert bytes(spark.table("live").first().s) == b"new"
    r.close()
    r.close()
    with pytest.raises(UninitializedError):
        r.update()


def test_reader_and_writer(spark, tmp_path):
    w = Writer(spark, str(tmp_path), "t.cache", chunk=3)
    rows = [("s", "v"), ("e", ""), ("\x01l", "b|a"), ("\x01n", ""), ("i", "7", 3), ("b", "true", 2), ("d", "1.5", 4), ("f", "1:2", 7), ("s", "late")]
    assert w.insert_many(rows) == 0
    assert w.add_duplicate_value("v") == 0 and w.finish_add_duplicate_values() == 0
    assert w.insert_key("k" * 70000, "v") == 1 and w.last_error() == "key or value too long" and w.last_error() == ""
    r = Reader(spark, str(tmp_path), "t.cache")
    with pytest.raises(UninitializedError):
        r.get_key("s")
    assert r.initialize() == 1
    w.finish_cache_creation(5)
    assert w.insert_key("x", "y") == 1
    assert r.initialize() == 0 and r.timestamp == 5
    assert (r.get_key("s"), r.get_key("e"), r.get_long("i"), r.get_int(b"i"), r.get_bool("b"), r.get_double("d")) == ("v", "", 7, 7, True, 1.5)
    assert (r.get_vector("l"), r.get_vector_float("f"), r.get_key_type("f"), r.get_vector_size("l"), r.get_vector_item("l", 1)) == (["a", "b"], [1.0, 2.0], "FloatList", 2, "b")
    assert r.contains_key("n") and not r.contains_key("zz") and r.get_any("i") == 7
    for call in (lambda: r.get_key("zz"), lambda: r.get_vector("n"), lambda: r.get_key(""), lambda: r.get_long("d")):
        with pytest.raises(NotFoundError):
            call()
    assert r.statistics()["number_of_entries"] == "8"
    r.close()
    with pytest.raises(UninitializedError):
        r.contains_key("s")
    full = Writer(spark, str(tmp_path), "full", number_of_key_slots=2)
    full.insert_many([("a", "1"), ("b", "2")])
    assert full.finish_code() == 3


def test_files(spark, tmp_path):
    f = Files(spark, str(tmp_path))
    f.write("a.txt", "é")
    f.write("a.txt", "b")
    assert f.read("a.txt") == "b" and f.exists("a.txt") and f.copy("a.txt", "c.txt") and f.modified("c.txt") > 0
    assert [p.rsplit("/", 1)[1] for p in f.glob("*.txt")] == ["a.txt", "c.txt"]
    assert f.rename("c.txt", "d.txt") and f.delete("d.txt") and not f.exists("d.txt")


def test_settings(tmp_path):
    path = str(tmp_path / "p.properties")
    with open(path, "w") as f:
        f.write("# c=d\na = 1\nb=x=y\n\nn#o=1\na=2\n")
    assert read_properties(path) == {"a": "2", "b": "x=y"}
    assert read_properties(path, strict=True) == {"a": "2", "n#o": "1"}
    assert read_properties(path + "none") == {}
    write_properties(path, {"b": 1, "a": 2})
    assert open(path).read() == "a=2\nb=1\n"
    s = Settings({"i": "12x", "d": "1.5", "b": "TRUE", "e": "", "c": "\\n", "t": "1m1.5s", "bad": "x"})
    assert (s.get_int("i"), s.get_int("e", 4), s.get_double("d"), s.get_double("bad"), s.get_bool("b"), s.get_bool("b", strict=True), s.get_char("c", "z"), s.get_char("e", "z"), s.get_duration("t")) == (12, 4, 1.5, 0.0, True, False, "\n", "z", 61.5)
    s.set_if_not_set("e", 1)
    assert s.get_string("e") == "1"
    with pytest.raises(StoreError):
        s.require("none")
    assert writer_config(Settings()) == WriterConfig()
    jobs = load_jobs(Settings({"cache.names": "a,b", "cache.input_dir": "/in", "cache.input_files": "x,y", "cache.type.b": "3", "cache.output_dir": "/out"}))
    assert [(j.name, j.inputs, j.config.kind) for j in jobs] == [("a", ("/in/x", "/in/y"), CacheKind.LINEAR_PROBE_DEDUP_TYPED), ("b", ("/in/x", "/in/y"), CacheKind.LINEAR_PROBE)]


def test_build(spark, tmp_path):
    (tmp_path / "in").write_bytes(b"1.k=v\x1e1.k=w\x1e\x012.l=b|a")
    s = Settings({"cache.names": "a", "cache.input_dir": str(tmp_path), "cache.input_files": "in", "cache.output_dir": str(tmp_path / "out")})
    (name, ts), = build(spark, load_jobs(s)).items()
    assert SnapshotStore(spark, str(tmp_path / "out")).manifest(name, ts).unique_keys == 2


def test_binary_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.cache")
    rows = [(b"1.s", ValueType.String, b"hello"), (b"e", ValueType.String, b""), (b"l", ValueType.StringList, [b"a", b""]), (b"b", ValueType.Bool, True), (b"i", ValueType.Int64, -5), (b"d", ValueType.Double, 2.5), (b"f", ValueType.FloatList, [1.5, 2.0]), (b"1.s", ValueType.String, b"late"), (b"\0k\xff", ValueType.String, b"hello")]
    h = binary.write_file(path, "x", rows, 32, dictionary=[b"hello\0"], offset_bits=20)
    assert h.entries == 8
    assert dict((k, v) for k, _, v in binary.read_slots(path, 0, 32)) == {k: v for k, _, v in reversed(rows)}
    binary.register(spark)
    got = spark.read.format("quillstore-binary").option("slots_per_task", 5).load(path)
    assert got.count() == 8
    row = got.where("key = cast('1.s' as binary)").first()
    assert (row.query_id, row.vtype, bytes(row.s)) == (1, "String", b"hello")
    with pytest.raises(MalformedSnapshotError):
        binary.read_header(b"short")
    with pytest.raises(KeySpaceFullError):
        binary.write_file(path, "x", rows, 4)
    with pytest.raises(OffsetBitsError):
        binary.write_file(path, "x", rows, 32, offset_bits=3)
    with pytest.raises(LimitError):
        binary.write_file(path, "x", rows, 32, kind=CacheKind.MAP)
    assert binary.decode_value(ValueType.Int64, b"x") == 0 and binary.decode_value(ValueType.FloatList, b"xyz") == []


def test_download(tmp_path):
    import xxhash
    import zstandard

    remote, local = tmp_path / "remote", tmp_path / "local"
    remote.mkdir()

    def publish(ts, body):
        (remote / f"x.{ts}.cache.zst").write_bytes(zstandard.compress(body))
        (remote / f"x.{ts}.cache.xxh3").write_text(xxhash.xxh3_64_hexdigest(body))
        (remote / "x.cache.timestamp.latest").write_text(str(ts))
        (remote / "x.properties").write_text("a=1\n")

    publish(10, b"one")
    job = lambda: download.Job([f"file://{tmp_path}/none", f"file://{remote}"], "x.cache", str(local))
    assert download.run(job()) == 10 and download.run(job()) is None
    assert (local / "x.10.cache").read_bytes() == b"one"
    publish(20, b"two" * 1000)
    assert download.Downloader(job()).wait() and download.Downloader(job()).run() == 20
    assert sorted(os.listdir(local)) == ["x.20.cache", "x.cache.timestamp.latest", "x.properties"]
    publish(30, b"three")
    (remote / "x.30.cache.xxh3").write_text("0" * 16)
    with pytest.raises(StoreError, match="checksum"):
        download.run(job())
    assert download.local_timestamp(job()) == 20 and not (local / "x.30.cache").exists()
    with pytest.raises(StoreError):
        download.newest_source([f"file://{tmp_path}/none"], "p")
    assert download.normalise("h/x") == "http://h/x"


def test_retry_and_wait():
    calls, pauses = [], []

    def fail_twice(timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retry(fail_twice, sleep=pauses.append) == "ok" and calls == [1, 5, 8] and pauses == [2.0, 2.0]
    state = iter([False, False, True])
    pauses.clear()
    assert wait_for(lambda: next(state), sleep=pauses.append, jitter=lambda: 1.0) and pauses == [5.0, 10.0]
    assert not wait_for(lambda: False, limit=20, sleep=pauses.append)
