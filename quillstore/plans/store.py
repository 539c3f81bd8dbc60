"""A versioned snapshot store.

Layout under a root folder::

    <name>.<ms>.snapshot/            Parquet, partitioned by query id, sorted by key in its files
    <name>.<ms>.dictionary/          Parquet (idx, s, fl): the values of an explicit dictionary, if one was given
    <name>.<ms>.manifest.json        one header row: counts, sizes, kind, times
    <name>.timestamp.latest          the newest version, written last

A version is written aside and renamed, then its manifest, then the pointer, so a reader never sees a pointer to a
version that is not complete, and a failed publication leaves the old pointer.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import load as load_ops
from ..types import SNAPSHOT, CacheKind, MalformedSnapshotError, NotFoundError, StoreError
from .files import Files

FORMAT_VERSION = 1
DEFAULT_OFFSET_BITS = 35
HASH_NAME = "xxh3"
VERSION_NAME = "v2"
VERSION = re.compile(r"(?P<name>.+)\.(?P<ms>[0-9]+)\.snapshot\Z")


@dataclass(frozen=True)
class Manifest:
    """The header of a version."""

    name: str
    creation_time_ms: int
    kind: int
    number_of_entries: int
    unique_keys: int
    max_collisions: int
    data_size: int
    offset_bits: int
    max_load_factor: float
    number_of_key_slots: int
    hash_func_id: int = 2
    format_version: int = FORMAT_VERSION
    version: str = VERSION_NAME
    hash_name: str = HASH_NAME
    dictionary_entries: int = 0

    @property
    def max_number_entries(self) -> int:
        return int(self.number_of_key_slots * self.max_load_factor)

    @property
    def hashcode_bits(self) -> int:
        return 64 - self.offset_bits

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def header_info(self) -> list[tuple[str, str]]:
        """(name, value) pairs."""
        return [(k, str(v)) for k, v in asdict(self).items()] + [("hashcode_bits", str(self.hashcode_bits)), ("max_number_entries", str(self.max_number_entries))]


def parse_version(file_name: str) -> tuple[str, int]:
    """(name, ms) of a version's folder name."""
    m = VERSION.fullmatch(file_name.rsplit("/", 1)[-1])
    if not m:
        raise StoreError(f"not a version: {file_name}")
    return m["name"], int(m["ms"])


def _parse(text: str, file: str) -> Manifest:
    try:
        return Manifest(**json.loads(text))
    except (ValueError, TypeError) as e:
        raise MalformedSnapshotError(f"malformed manifest {file}") from e


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._opened: dict[str, int] = {}

    # --- publish -------------------------------------------------------------------------------------------------

    def publish(
        self,
        name: str,
        pairs: DataFrame,
        kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED,
        offset_bits: int | None = None,
        max_load_factor: float = 0.5,
        number_of_key_slots: int = 0,
        timestamp: int | None = None,
        latest: bool = True,
        bloom: bool = True,
        strict: bool = True,
        words: DataFrame | None = None,
    ) -> int:
        """Load pairs (canonical columns and load order) into a new version; returns its timestamp.

        strict: records over a limit fail the load, else they are left out.  offset_bits: fail if the records' bytes
        outgrow that width; by default the least sufficient one is noted.  words: an explicit dictionary (idx, s, fl) for
        kinds that have one, kept beside the version.  Keys are sorted within files and carry a Parquet bloom filter, so a
        point lookup reads few row groups.
        """
        load_ops.check_config(kind, DEFAULT_OFFSET_BITS if offset_bits is None else offset_bits, max_load_factor)
        if words is not None and not kind.has_dictionary:
            raise StoreError(f"kind {kind.name} has no dictionary")
        ts = int(time.time() * 1000) if timestamp is None else timestamp
        pairs = load_ops.enforce_limits(pairs) if strict else load_ops.split_by_limits(pairs)[0]
        if number_of_key_slots:
            load_ops.require_capacity(pairs, number_of_key_slots, max_load_factor)
        n = F.count(F.lit(1))
        order = load_ops.load_order(pairs)
        keys = ("key", "vtype") if kind == CacheKind.MAP else ("key",)
        rest = [c for c in SNAPSHOT.fieldNames() if c not in keys]
        if kind == CacheKind.MAP:
            pairs = pairs.where(F.col("vtype").isin("String", "StringList"))
        won = pairs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("won"), n.alias("puts"))
        rows = won.select(*(F.col(c) if c in keys else F.col("won")[c].alias(c) for c in SNAPSHOT.fieldNames()), "puts")
        from pyspark.sql import Observation

        seen = Observation()
        chained = kind == CacheKind.BUCKET_CHAIN
        size = (F.octet_length("key") + load_ops.encoded_bytes() + 6).cast("bigint")
        rows = rows.observe(
            seen,
            F.coalesce(F.sum("puts" if chained else F.lit(1).cast("bigint")), F.lit(0)).alias("entries"),
            n.alias("unique"),
            F.coalesce(F.max("puts") - 1, F.lit(0)).alias("most"),
            F.coalesce(F.sum(size), F.lit(0)).alias("size"),
        ).drop("puts")
        staging, final = f".staging-{name}.{ts}", f"{name}.{ts}.snapshot"
        self.files.delete(staging)
        try:
            # One more shuffle of the de-duplicated rows, by query id, large ids split: few files instead of one per task and id.
            writer = rows.hint("rebalance", "query_id").sortWithinPartitions("query_id", "key").write.mode("overwrite").partitionBy("query_id")
            if bloom:
                writer = writer.option("parquet.bloom.filter.enabled#key", "true")
            writer.parquet(f"{self.root}/{staging}")
            got = seen.get
            slots = number_of_key_slots or int(got["unique"] / max_load_factor)
            if offset_bits is None:
                offset_bits = max(DEFAULT_OFFSET_BITS, (int(got["size"]) + 8 * slots).bit_length())
            else:
                load_ops.check_offset_bits(int(got["size"]), offset_bits, slots)
            entries = 0
            if words is not None:
                words.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}.{ts}.dictionary")  # at most 65536 rows
                entries = self.dictionary(name, ts).count()
            if not self.files.rename(staging, final):
                raise StoreError(f"cannot publish {final}")
        except Exception:
            self.files.delete(staging)
            self.files.delete(f"{name}.{ts}.dictionary")
            raise
        manifest = Manifest(
            name, ts, int(kind), int(got["entries"]), int(got["unique"]), int(got["most"]), int(got["size"]), offset_bits, max_load_factor, number_of_key_slots, dictionary_entries=entries
        )
        self.files.write(f"{name}.{ts}.manifest.json", manifest.to_json())
        if latest:
            self.files.write(f"{name}.timestamp.latest", str(ts))
        return ts

    def dictionary(self, name: str, ts: int | None = None) -> DataFrame:
        """(idx, s, fl) of a version's explicit dictionary; empty if it has none."""
        ts = self.latest_timestamp(name) if ts is None else ts
        folder, schema = f"{name}.{ts}.dictionary", "idx int, s binary, fl array<float>"
        if not self.files.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    # --- open ----------------------------------------------------------------------------------------------------

    def timestamps(self, name: str) -> list[int]:
        """Distinct versions of a name, ascending."""
        found = (VERSION.fullmatch(f) for f in self.files.list())
        return sorted({int(m["ms"]) for m in found if m and m["name"] == name})

    def latest_timestamp(self, name: str) -> int:
        pointer = f"{name}.timestamp.latest"
        text = self.files.read(pointer).strip() if self.files.exists(pointer) else ""
        if not re.fullmatch(r"[0-9]+", text):
            raise NotFoundError(f"no latest version of {name}")
        return int(text)

    def path(self, name: str, ts: int) -> str:
        return f"{self.root}/{name}.{ts}.snapshot"

    @staticmethod
    def _check(m: Manifest, kind: CacheKind | None) -> None:
        if m.format_version != FORMAT_VERSION:
            raise MalformedSnapshotError(f"format {m.format_version} of {m.name} is not {FORMAT_VERSION}")
        if kind is not None and CacheKind(m.kind).has_dictionary and not kind.has_dictionary:
            raise MalformedSnapshotError(f"{m.name} is of kind {CacheKind(m.kind).name}, not {kind.name}")

    def open_path(self, path: str, preload: bool = False, kind: CacheKind | None = None) -> DataFrame:
        """A version by its folder; what its manifest says of kind and format is checked if there is one.  preload: keep it
        in memory and disk of the executors, filled at once."""
        folder = path.rstrip("/")
        manifest = Files(self.spark, "")
        if VERSION.fullmatch(folder.rpartition("/")[2]) and manifest.exists(beside := folder.removesuffix(".snapshot") + ".manifest.json"):
            self._check(_parse(manifest.read(beside), beside), kind)
        try:
            df = self.spark.read.parquet(path)
        except Exception as e:
            raise MalformedSnapshotError(f"cannot open {path}: {e}") from e
        if missing := set(SNAPSHOT.fieldNames()) - set(df.columns):
            raise MalformedSnapshotError(f"{path} is not a snapshot: no {sorted(missing)}")
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in SNAPSHOT.fields))
        if preload:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            df.count()
        return df

    def open(self, name: str, ts: int | None = None, preload: bool = False, kind: CacheKind | None = None) -> DataFrame:
        """The latest version, or that of a time; raises if its manifest has another format or, if given, kind."""
        ts = self.latest_timestamp(name) if ts is None else ts
        self._check(self.manifest(name, ts), kind)
        return self.open_path(self.path(name, ts), preload)

    def open_as_of(self, name: str, ts: int) -> DataFrame:
        """The newest version that is not newer than a time."""
        older = [t for t in self.timestamps(name) if t <= ts]
        if not older:
            raise NotFoundError(f"no version of {name} at {ts}")
        return self.open(name, older[-1])

    def reload(self, name: str) -> tuple[bool, DataFrame]:
        """(whether a newer version was opened, its frame): only when the pointer is strictly newer than last time."""
        ts = self.latest_timestamp(name)
        newer = ts > self._opened.get(name, -1)
        self._opened[name] = max(ts, self._opened.get(name, -1))
        return newer, self.open(name, self._opened[name])

    def manifest(self, name: str, ts: int | None = None) -> Manifest:
        ts = self.latest_timestamp(name) if ts is None else ts
        file = f"{name}.{ts}.manifest.json"
        if not self.files.exists(file):
            raise NotFoundError(f"no version {ts} of {name}")
        return _parse(self.files.read(file), file)

    def manifests(self, name: str) -> DataFrame:
        rows = [asdict(self.manifest(name, t)) for t in self.timestamps(name)]
        kinds = {"str": "string", "int": "bigint", "float": "double"}
        return self.spark.createDataFrame(rows, ", ".join(f"{k} {kinds[t if isinstance(t, str) else t.__name__]}" for k, t in Manifest.__annotations__.items()))

    # --- keep house ----------------------------------------------------------------------------------------------

    def retain(self, name: str, newest: int = 1) -> list[int]:
        """Delete what was left half-written and all but the newest versions; the latest one always stays.  Returns
        what was deleted."""
        for f in self.files.list():
            if f.startswith(f".staging-{name}."):
                self.files.delete(f)
        versions = self.timestamps(name)
        keep = set(versions[-newest:] if newest > 0 else []) | {self.latest_timestamp(name)}
        gone = [t for t in versions if t not in keep]
        for t in gone:
            self.files.delete(f"{name}.{t}.snapshot")
            self.files.delete(f"{name}.{t}.dictionary")
            self.files.delete(f"{name}.{t}.manifest.json")
        return gone


def build(spark: SparkSession, jobs, on_invalid: str = "empty_key") -> dict[str, int]:
    """Build each job of a settings file: scan, parse, load, publish.  Returns name to timestamp."""
    from ..sources.records import read_pairs

    return {
        j.name: SnapshotStore(spark, j.output_dir).publish(j.name, read_pairs(spark, list(j.inputs), on_invalid=on_invalid), j.config.kind, j.config.offset_bits, j.config.max_load_factor)
        for j in jobs
    }
