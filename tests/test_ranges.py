"""Operators that follow the load order by ranges, and what a publication checks and keeps."""

import random

import pytest
from pyspark.sql import functions as F

from quillstore.api import KEY_SPACE_FULL, OFFSET_BITS, OK, Writer
from quillstore.operators import load as load_ops
from quillstore.plans.store import SnapshotStore
from quillstore.sources.records import read_pairs
from quillstore.types import CacheKind, MalformedSnapshotError, OffsetBitsError, StoreError


def brute_runs(rows):
    seen, here, last, out = set(), set(), None, []
    for n, k in rows:
        if "." not in k:
            if k not in seen:
                out.append(n)
            seen.add(k)
        elif k.startswith("."):
            out.append(n)
        else:
            if k.split(".")[0] != last:
                last, here = k.split(".")[0], set()
            if k not in here:
                out.append(n)
            here.add(k)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_repeats_across_ranges(spark, seed):
    rnd = random.Random(seed)
    rows, k = [], "a.1"
    for n in range(400):
        if rnd.random() < (0.05 if seed else 0.9):
            k = rnd.choice(["a.1", "a.2", "b.1", "b.2", "c", "d", ".x", "b.3"])
        elif rnd.random() < 0.3:
            k = k[:2] + rnd.choice("123") if "." in k[1:] else k
        rows.append((n, k))
    df = spark.createDataFrame(rows, "n long, key string").repartition(7)
    assert sorted(r.n for r in load_ops.dedup_runs(df, F.col("n")).collect()) == brute_runs(rows)
    wanted = [n for i, (n, key) in enumerate(rows) if not i or rows[i - 1][1] != key]
    got = load_ops.drop_consecutive(df, F.col("n"))
    assert sorted(r.n for r in got.collect()) == wanted
    assert got.columns == df.columns and "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    for slots in (0, 3, 5, 8, 100):
        kept, keys = [], set()
        for n, key in rows:
            if len(keys) >= slots:
                break
            keys.add(key)
            kept.append(n)
        assert sorted(r.n for r in load_ops.within_capacity(df, slots, 1.0, F.col("n")).collect()) == kept
    assert load_ops.dedup_runs(df.where("false"), F.col("n")).count() == load_ops.drop_consecutive(df.where("false"), F.col("n")).count() == 0


def test_a_folder_is_read_by_file_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("k=first")
    (tmp_path / "in" / "b").write_text("\x1e".join(["k=second"] + [f"x{i}=y" for i in range(5000)]))
    for path in (str(tmp_path / "in"), f"{tmp_path}/in/*"):
        got = load_ops.insert(read_pairs(spark, path)).where(F.col("key") == F.lit(b"k")).collect()
        assert [bytes(r.s) for r in got] == [b"first"]


def test_a_pointer_is_replaced(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    for text in ("1", "22"):
        store.files.write("p", text)
        assert store.files.read("p") == text and store.files.list() == ["p"]


def test_dictionary_and_offset_bits_on_publish(spark, tmp_path):
    w = Writer(spark, str(tmp_path), "t.cache", CacheKind.LINEAR_PROBE_DEDUP_TYPED)
    assert [w.add_duplicate_value(v) for v in ("foo", "bar", "foo")] == [0, 0, 0] and w.add_duplicate_value("1:2", 7) == 0
    assert w.finish_add_duplicate_values() == 0 and w.add_duplicate_value("late") == 1
    assert w.insert_many([("1.a", "foo"), ("1.b", "bar")]) == OK
    ts = w.finish_cache_creation()
    words = {r.idx: (r.s and bytes(r.s), r.fl) for r in w.store.dictionary("t", ts).collect()}
    assert words == {0: (b"foo", None), 1: (b"bar", None), 2: (None, [1.0, 2.0])}
    assert w.store.manifest("t", ts).dictionary_entries == 3 and w.store.open("t", ts).count() == 2
    plain = Writer(spark, str(tmp_path), "u.cache", CacheKind.LINEAR_PROBE)
    assert plain.add_duplicate_value("x") == 1
    small = Writer(spark, str(tmp_path), "v.cache", offset_bits=16)
    small.insert_many([(f"{i}.k", "x" * 100) for i in range(1000)])
    assert small.finish_code() == OFFSET_BITS and "too short" in small.last_error() and not small.store.timestamps("v")
    full = Writer(spark, str(tmp_path), "f.cache", number_of_key_slots=4)
    full.insert_many([(f"{i}.k", "x") for i in range(3)])
    assert full.finish_code() == KEY_SPACE_FULL
    store = w.store
    pairs = store.open("t", ts).withColumn("src_ord", F.lit(0))
    with pytest.raises(OffsetBitsError):
        store.publish("o", pairs, offset_bits=16, number_of_key_slots=1 << 14)
    assert store.manifest("o", store.publish("o", pairs, timestamp=5)).offset_bits == 35
    with pytest.raises(StoreError):
        store.publish("o", pairs, CacheKind.MAP, words=store.dictionary("t", ts))
    with pytest.raises(MalformedSnapshotError):
        store.open_path(store.path("t", ts), kind=CacheKind.LINEAR_PROBE)


def test_folders_are_mirrored(spark, tmp_path):
    files = SnapshotStore(spark, str(tmp_path)).files
    for name, text in (("a/x", "1"), ("a/y", "22"), ("b/x", "1"), ("b/old", "0")):
        files.write(name, text)
    assert files.mirror("a", "b") == ["y"] and files.list("b") == ["x", "y"]
    with files.open("b/y") as f:
        assert f.read(1) + f.read() == b"22"


def test_reasons_of_downloads(tmp_path):
    from quillstore.streaming.download import Job, Reason, decide

    there, here = tmp_path / "there", tmp_path / "here"
    there.mkdir()
    here.mkdir()
    job = Job([f"file://{there}"], "x.cache", str(here))
    said = lambda: decide(job)
    assert said() == (True, Reason.NO_TIMESTAMP)
    (there / "x.cache.timestamp.latest").write_text("20")
    assert said() == (True, Reason.MISSING_LATEST_TIMESTAMP)
    (here / "x.cache.timestamp.latest").write_text("10")
    for folder, missing, empty in ((there, Reason.MISSING_REMOTE_INPUTS, Reason.EMPTY_REMOTE_INPUTS), (here, Reason.MISSING_LOCAL_INPUTS, Reason.EMPTY_LOCAL_INPUTS)):
        assert said() == (True, missing)
        (folder / "x.inputs").write_text("")
        assert said() == (True, empty)
        (folder / "x.inputs").write_text("a")
    assert said() == (True, Reason.NOT_ENOUGH_FILES)
    (here / "x.20.cache").write_text("1")
    assert said() == (False, Reason.SIMILAR_REMOTE_AND_LOCAL_INPUTS)
    (here / "x.inputs").write_text("b")
    assert said() == (True, Reason.DIFFERENT_REMOTE_AND_LOCAL_INPUTS)
    (here / "x.cache.timestamp.latest").write_text("20")
    assert said() == (False, Reason.UP_TO_DATE)
    (here / "x.20.cache").unlink()
    assert said() == (True, Reason.NOT_ENOUGH_FILES)


def test_a_pinned_view_is_not_swapped(spark, tmp_path):
    from quillstore.streaming.refresh import Refresher

    store = SnapshotStore(spark, str(tmp_path))
    pairs = spark.range(3).select(*load_ops.put(F.col("id").cast("string"), "id", 3))
    for ts in (1, 2):
        store.publish("p", pairs, timestamp=ts)
    refresher = Refresher(store, "p", pinned=1)
    assert refresher.update() == 1 and not refresher.poll() and refresher.timestamp == 1
    refresher.start(0.01)
    assert refresher._thread is None
    refresher.close()
