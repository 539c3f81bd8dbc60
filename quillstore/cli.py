"""Command-line tools: ``python -m quillstore.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Reader
from .operators import load as load_ops
from .operators import lookup as L
from .operators import stats
from .plans.store import SnapshotStore, build
from .sources.properties import Settings, load_jobs, read_properties
from .sources.records import parse_records, read_typed_text, scan_records
from .streaming.download import Downloader, Job
from .types import RECORD_SEPARATOR, NotFoundError


def session() -> SparkSession:
    return SparkSession.builder.appName("quillstore").getOrCreate()


def _source(spark, args) -> DataFrame:
    """Parsed records of the files, de-duplicated as a scanner does if asked for."""
    parsed = parse_records(scan_records(spark, args.files, RECORD_SEPARATOR), "error")
    return load_ops.dedup_runs(parsed, load_ops.load_order(parsed)) if getattr(args, "dedup", False) else parsed


def scan(spark, args) -> None:
    """Statistics and query ids of record files."""
    rows = _source(spark, args)
    for k, v in stats.scan_stats(rows).first().asDict().items():
        print(f"{k}={v}")
    print("query ids:", *(r[0] for r in stats.distinct_query_ids(rows).toLocalIterator()))


def split(spark, args) -> None:
    """One folder of lines per query id."""
    stats.split_by_query_id(_source(spark, args), args.output)


def compare(spark, args) -> None:
    """Counts of equal, different and missing records of a source against a published version."""
    args.dedup = True
    snapshot = SnapshotStore(spark, args.root).open(args.name)
    for r in stats.comparison_counts(stats.compare(_source(spark, args), snapshot)).orderBy("status").collect():
        print(f"{r['status']}={r['n']}")


def create(spark, args) -> None:
    """Publish a typed text file, or the jobs of a settings file."""
    if args.settings:
        print(build(spark, load_jobs(Settings(read_properties(args.settings)))))
    else:
        print(SnapshotStore(spark, args.root).publish(args.name, read_typed_text(spark, args.files[0])))


def get(spark, args) -> int:
    """The value of one key, by its type."""
    reader = Reader(spark, args.root, args.name)
    reader.update()
    try:
        print(reader.get_any(args.key))
        return 0
    except NotFoundError:
        print("not found")
        return 1


def commands(spark, args) -> None:
    """Answer the commands of standard input, ``GET* key [index]`` a line, as one batch; reports the rate."""
    rows = []
    for line in sys.stdin:
        parts = line.split()
        if len(parts) > 1:
            rows.append((len(rows), parts[0], parts[1], int(parts[2]) if len(parts) > 2 else 0))
    frame = spark.createDataFrame(rows, "n long, command string, key string, idx int")
    began = time.perf_counter()
    answers = L.run_commands(frame, SnapshotStore(spark, args.root).open(args.name)).orderBy("n").collect()
    took = time.perf_counter() - began
    for r in answers:
        print(f"{r['key']}: {r['answer']}")
    print(f"{len(rows)} lookups, {took:.3f} s, {len(rows) / took:.0f} per second", file=sys.stderr)


def fetch(spark, args) -> None:
    """Download the newest published file; with ``--wait`` until there is one."""
    job = Job(args.url, args.name, args.root)
    downloader = Downloader(job)
    if args.wait:
        downloader.wait()
    print(downloader.run())


def wait_local(spark, args) -> int:
    """Wait until a version newer than ``--after`` is published."""
    from .streaming.refresh import wait_for

    store = SnapshotStore(spark, args.root)

    def ready():
        try:
            return store.latest_timestamp(args.name) > args.after
        except NotFoundError:
            return False

    return 0 if wait_for(ready, limit=args.limit) else 1


def dump(spark, args) -> None:
    """Write a version as text lines, or with ``--json`` print it in the debug form."""
    snapshot = SnapshotStore(spark, args.root).open(args.name)
    if args.json:
        for r in snapshot.select(F.coalesce(stats.debug_json(), F.lit("")).alias("line")).toLocalIterator():
            print(r["line"])
    else:
        stats.write_text(snapshot, args.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstore")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, name=None, files=None, store=False):
        c = sub.add_parser(name or f.__name__, help=f.__doc__)
        c.set_defaults(run=f)
        if store:
            c.add_argument("--root", required=True)
            c.add_argument("--name", required=True)
        if files:
            c.add_argument("files", nargs=files)
        return c

    add(scan, "kv_scan", "+").add_argument("--dedup", action="store_true")
    c = add(split, "kv_split", "+")
    c.add_argument("--output", required=True)
    add(compare, "comparo", "+", store=True)
    c = add(create, "create", "*")
    c.add_argument("--root", default=".")
    c.add_argument("--name", default="snapshot")
    c.add_argument("--settings")
    add(get, store=True).add_argument("key")
    add(commands, store=True)
    c = add(fetch, "download", store=True)
    c.add_argument("--url", action="append", required=True)
    c.add_argument("--wait", action="store_true")
    c = add(wait_local, store=True)
    c.add_argument("--after", type=int, default=-1)
    c.add_argument("--limit", type=float)
    c = add(dump, store=True)
    c.add_argument("--output", default="dump")
    c.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or session(), args) or 0


if __name__ == "__main__":
    sys.exit(main())
