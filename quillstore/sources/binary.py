"""The binary snapshot format: one memory image with header, slots, records and dictionary.

Readers and writers of a single file; meant for exchange, as the engine's own snapshots are Parquet.  A file is read in
byte ranges on executors by a Python data source, each range walking the slots that fall into it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..types import MAX_DICTIONARY, OFFSET_BITS, CacheKind, KeySpaceFullError, LimitError, MalformedSnapshotError, OffsetBitsError, ValueType

# Fixed values of the format.
MAGIC = 37460
NAME_BYTES = 32
VERSION = 2050
FLAG_SHORT, FLAG_BYTE = 1, 16
FIELDS = (
    ("magic", "H"), ("header_size", "H"), ("name_start", "H"), ("version", "H"), ("kind", "H"), ("hash_func", "H"),
    ("hashcode_bits", "H"), ("offset_bits", "H"), ("max_load_factor", "d"), ("max_collisions", "I"), ("creation_time_ms", "Q"),
    ("entries", "Q"), ("slots", "Q"), ("data_size", "Q"), ("max_entries", "Q"),
)
HEADER = struct.Struct("<" + "".join(f for _, f in FIELDS))


@dataclass
class Header:
    kind: int
    offset_bits: int
    max_load_factor: float
    entries: int
    slots: int
    data_size: int
    name: str = ""
    max_collisions: int = 0
    creation_time_ms: int = 0
    hash_func: int = 2
    version: int = VERSION
    max_entries: int = 0

    @property
    def size(self) -> int:
        return HEADER.size + NAME_BYTES

    def pack(self) -> bytes:
        values = {"magic": MAGIC, "header_size": self.size, "name_start": HEADER.size, "hashcode_bits": 64 - self.offset_bits} | vars(self)
        return HEADER.pack(*(values[n] for n, _ in FIELDS)) + self.name.encode()[: NAME_BYTES - 1].ljust(NAME_BYTES, b"\0")


def read_header(raw: bytes) -> Header:
    """Raises on a short header, another magic number or an inconsistent name field."""
    if len(raw) < HEADER.size + NAME_BYTES:
        raise MalformedSnapshotError("malformed snapshot: short header")
    got = dict(zip((n for n, _ in FIELDS), HEADER.unpack(raw[: HEADER.size]), strict=True))
    if got["magic"] != MAGIC or got["header_size"] - got["name_start"] != NAME_BYTES:
        raise MalformedSnapshotError("malformed snapshot: not a header")
    name = raw[HEADER.size : HEADER.size + NAME_BYTES].split(b"\0", 1)[0].decode("utf-8", "replace")
    return Header(**{k: v for k, v in got.items() if k in Header.__annotations__}, name=name)


def encode_value(vtype: ValueType, value) -> bytes:
    """The bytes of a typed value."""
    if vtype == ValueType.String:
        return bytes(value) + b"\0"
    if vtype == ValueType.StringList:
        if len(value) > 65535 or any(len(x) > 65535 for x in value):
            raise LimitError("list or element too long")
        return struct.pack("<H", len(value)) + b"".join(struct.pack("<H", len(x)) + bytes(x) + b"\0" for x in value)
    if vtype == ValueType.Bool:
        return b"\1" if value else b"\0"
    if vtype == ValueType.Int64:
        return struct.pack("<q", value)
    if vtype == ValueType.Double:
        return struct.pack("<d", value)
    if vtype == ValueType.FloatList:
        return struct.pack(f"<{len(value)}f", *value)
    raise LimitError(f"type {vtype.name} cannot be written")


def decode_value(vtype: ValueType, raw: bytes):
    """The inverse; a size that does not fit gives the type's zero."""
    if vtype == ValueType.String:
        return raw[:-1]
    if vtype == ValueType.StringList:
        if len(raw) < 2:
            return []
        out, at = [], 2
        for _ in range(struct.unpack_from("<H", raw)[0]):
            n = struct.unpack_from("<H", raw, at)[0]
            out.append(raw[at + 2 : at + 2 + n])
            at += n + 3
        return out
    if vtype == ValueType.Bool:
        return raw != b"\0" if len(raw) == 1 else False
    if vtype in (ValueType.Int64, ValueType.Double):
        return struct.unpack("<q" if vtype == ValueType.Int64 else "<d", raw)[0] if len(raw) == 8 else (0 if vtype == ValueType.Int64 else 0.0)
    if vtype in (ValueType.Int, ValueType.Float):
        return struct.unpack("<i" if vtype == ValueType.Int else "<f", raw)[0] if len(raw) == 4 else (0 if vtype == ValueType.Int else 0.0)
    return list(struct.unpack(f"<{len(raw) // 4}f", raw)) if len(raw) % 4 == 0 else []


def write_file(path: str, name: str, pairs, slots: int, kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED, offset_bits: int = 35, max_load_factor: float = 0.5, dictionary: list[bytes] = (), creation_time_ms: int = 0) -> Header:
    """Write (key, type, value) pairs in load order; the first of a key wins.  One process, in memory, as the format is
    one image."""
    import xxhash

    if not OFFSET_BITS[0] <= offset_bits <= OFFSET_BITS[1]:
        raise OffsetBitsError(f"offset bits {offset_bits} out of range")
    if kind < CacheKind.LINEAR_PROBE:
        raise LimitError("only linear kinds are written")
    if len(dictionary) > MAX_DICTIONARY - 1:
        raise LimitError("too many dictionary values")
    words: dict[bytes, int] = {}
    for i, w in enumerate(dictionary):
        words.setdefault(bytes(w), i)
    keys, table, data, most = {}, [0] * slots, bytearray(), 0
    mask = (1 << offset_bits) - 1
    for key, vtype, value in pairs:
        key = bytes(key)
        if len(keys) >= int(slots * max_load_factor):
            raise KeySpaceFullError("keySpace is full")
        if key in keys:
            continue
        raw = encode_value(vtype, value)
        if len(key) > 65535 or len(raw) > 16777215:
            raise LimitError("key or value too long")
        flags = 0
        if kind.has_dictionary and raw in words:
            n = words[raw]
            flags, stored = (FLAG_BYTE, struct.pack("<B", n)) if n < 256 else (FLAG_SHORT, struct.pack("<H", n))
        else:
            stored = raw
        h = xxhash.xxh3_64_intdigest(key)
        at, steps = h % slots, 0
        while table[at]:
            at, steps = (at + 1) % slots, steps + 1
        offset = len(data) + 8
        if offset > mask:
            raise OffsetBitsError(f"offset bits {offset_bits} too short")
        table[at] = (h & ~mask & (1 << 64) - 1) | offset
        data += struct.pack("<HI", len(key), flags | int(vtype) << 5 | len(stored) << 8) + key + stored
        keys[key], most = True, max(most, steps)
    header = Header(int(kind), offset_bits, max_load_factor, len(keys), slots, len(data), name, most, creation_time_ms, max_entries=int(slots * max_load_factor))
    with open(path, "wb") as f:
        f.write(header.pack())
        f.write(struct.pack(f"<{slots}Q", *table))
        f.write(data)
        if kind.has_dictionary:
            body = struct.pack("<H", len(words)) + b"".join(struct.pack("<I", len(w)) for w in words) + b"".join(words) if words else b""
            f.write(body + struct.pack("<Q", len(body)))
    return header


def read_dictionary(f, header: Header) -> list[bytes]:
    if not CacheKind(header.kind).has_dictionary:
        return []
    f.seek(-8, 2)
    size = struct.unpack("<Q", f.read(8))[0]
    if not size:
        return []
    f.seek(-8 - size, 2)
    body = f.read(size)
    n = struct.unpack_from("<H", body)[0]
    out, at = [], 2 + 4 * n
    for length in struct.unpack_from(f"<{n}I", body, 2):
        out.append(body[at : at + length])
        at += length
    return out


def read_slots(path: str, first: int, last: int):
    """(key, type, value) of the records of slots [first, last)."""
    with open(path, "rb") as f:
        header = read_header(f.read(HEADER.size + NAME_BYTES))
        words = read_dictionary(f, header)
        mask, base = (1 << header.offset_bits) - 1, header.size + header.slots * 8 - 8
        f.seek(header.size + 8 * first)
        for slot in struct.unpack(f"<{last - first}Q", f.read(8 * (last - first))):
            if not slot & mask:
                continue
            f.seek(base + (slot & mask))
            size, packed = struct.unpack("<HI", f.read(6))
            flags, vtype, length = packed & 31, ValueType(packed >> 5 & 7), packed >> 8
            key, raw = f.read(size), f.read(length)
            if flags & FLAG_BYTE:
                raw = words[raw[0]]
            elif flags & FLAG_SHORT:
                raw = words[struct.unpack("<H", raw)[0]]
            yield key, vtype, decode_value(vtype, raw)


SCHEMA = "key binary, query_id bigint, vtype string, s binary, sl array<binary>, b boolean, i bigint, d double, fl array<float>"


class BinarySource(DataSource):
    """``spark.read.format("quillstore-binary").load(path)``; option ``slots_per_task``.  The path must be readable as
    a local file on every executor (a shared mount)."""

    @classmethod
    def name(cls):
        return "quillstore-binary"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BinaryReader(self.options)


class BinaryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("slots_per_task", 1 << 20))

    def partitions(self):
        with open(self.path, "rb") as f:
            slots = read_header(f.read(HEADER.size + NAME_BYTES)).slots
        return [InputPartition((a, min(a + self.step, slots))) for a in range(0, slots, self.step)]

    def read(self, partition):
        from quillstore.functions.scalars import query_id_literal

        at = {ValueType.String: 3, ValueType.StringList: 4, ValueType.Bool: 5, ValueType.Int64: 6, ValueType.Double: 7, ValueType.FloatList: 8}
        for key, vtype, value in read_slots(self.path, *partition.value):
            row = [key, query_id_literal(key), vtype.name, None, None, None, None, None, None]
            if vtype in at:
                row[at[vtype]] = value
            yield tuple(row)


def register(spark) -> None:
    spark.dataSource.register(BinarySource)
