"""Property files and settings, on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from ..types import CacheKind, StoreError

#: Escapes of one-character settings.
ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\0": "\0", "\\b": "\b", "\\f": "\f", "\\a": "\a", "\\v": "\v", "\\\\": "\\"}


def read_properties(path: str, strict: bool = False) -> dict[str, str]:
    """``key=value`` lines.

    Lenient: the first ``=`` splits, blanks are trimmed, lines with ``#`` in their key are comments, later lines win,
    a missing file is empty.  Strict: lines that are blank or begin with ``#`` are skipped, and so is a line with other
    than one ``=``; a missing file raises.
    """
    if not os.path.exists(path):
        if strict:
            raise StoreError(f"no such file: {path}")
        return {}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f.read().splitlines():
            if strict:
                line = line.strip()
                if not line or line.startswith("#") or line.count("=") != 1:
                    continue
            elif "=" not in line or "#" in line.partition("=")[0]:
                continue
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def write_properties(path: str, values: dict) -> None:
    """Sorted ``key=value`` lines, written aside and renamed."""
    write_atomically(path, "".join(f"{k}={values[k]}\n" for k in sorted(values)))


def write_atomically(path: str, content: str | bytes) -> None:
    mode, more = ("wb", {}) if isinstance(content, bytes) else ("w", {"encoding": "utf-8"})
    with open(f"{path}.tmp", mode, **more) as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


class Settings:
    """Typed getters over a string map; an empty value counts as not set."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values = {str(k): str(v) for k, v in (values or {}).items()}

    def is_set(self, name: str) -> bool:
        return bool(self.values.get(name))

    def set_if_not_set(self, name: str, value) -> None:
        if not self.is_set(name):
            self.values[name] = str(value)

    def update(self, values: dict) -> None:
        self.values.update({str(k): str(v) for k, v in values.items()})

    def get_string(self, name: str, default: str = "") -> str:
        return self.values.get(name) or default

    def get_bool(self, name: str, default: bool = False, strict: bool = False) -> bool:
        """strict: only ``true`` and ``false`` count."""
        v = self.values.get(name)
        if not v or (strict and v not in ("true", "false")):
            return default
        return v.lower() == "true" or v == "1"

    def get_int(self, name: str, default: int = 0) -> int:
        m = re.match(r"-?[0-9]+", self.values.get(name, ""), re.A)
        if not self.is_set(name):
            return default
        return int(m[0]) if m else 0

    def get_double(self, name: str, default: float = 0.0) -> float:
        if not self.is_set(name):
            return default
        v = self.values[name]
        ok = re.fullmatch(r"-?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)", v, re.A | re.I)
        return float(v) if ok else 0.0

    def get_char(self, name: str, default: str) -> str:
        v = self.values.get(name)
        return ESCAPES.get(v, v[0]) if v else default

    def get_duration(self, name: str, default: float = 0.0) -> float:
        """Seconds of a text such as ``1h2m3.5s`` or ``150ms``."""
        v = self.values.get(name, "")
        unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
        parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", v)
        if not parts or "".join(a + b for a, b in parts) != v.lstrip("+-"):
            return default
        return (-1 if v.startswith("-") else 1) * sum(float(a) * unit[b] for a, b in parts)

    def require(self, *names: str) -> None:
        missing = [n for n in names if not self.is_set(n)]
        if missing:
            raise StoreError(f"missing settings: {', '.join(missing)}")


@dataclass(frozen=True)
class WriterConfig:
    """Writer settings with their defaults."""

    number_of_keys: int = 100000001
    kind: CacheKind = CacheKind.LINEAR_PROBE_DEDUP_TYPED
    offset_bits: int = 35
    max_load_factor: float = 0.5
    folder: str = "."
    key_types: dict = field(default_factory=dict)


@dataclass(frozen=True)
class LoadJob:
    """One snapshot to build: its name, inputs and writer settings."""

    name: str
    inputs: tuple
    output_dir: str
    config: WriterConfig


def writer_config(settings: Settings, name: str = "", prefix: str = "cache") -> WriterConfig:
    """Settings ``<prefix>.<property>`` or, more specific, ``<prefix>.<property>.<name>``."""

    def pick(prop):
        return f"{prefix}.{prop}.{name}" if name and settings.is_set(f"{prefix}.{prop}.{name}") else f"{prefix}.{prop}"

    d = WriterConfig()
    return WriterConfig(
        settings.get_int(pick("number_of_keys"), d.number_of_keys),
        CacheKind(settings.get_int(pick("type"), int(d.kind))),
        settings.get_int(pick("offset_bits"), d.offset_bits),
        settings.get_double(pick("max_load_factor"), d.max_load_factor),
        settings.get_string(pick("output_dir"), d.folder),
    )


def load_jobs(settings: Settings, prefix: str = "cache") -> list[LoadJob]:
    """One job per name of the comma list ``<prefix>.names``; each lists its files under an input folder."""
    jobs = []
    for name in filter(None, (n.strip() for n in settings.get_string(f"{prefix}.names").split(","))):
        config = writer_config(settings, name, prefix)
        folder = settings.get_string(f"{prefix}.input_dir.{name}", settings.get_string(f"{prefix}.input_dir", "."))
        files = settings.get_string(f"{prefix}.input_files.{name}", settings.get_string(f"{prefix}.input_files"))
        inputs = tuple(f"{folder}/{f.strip()}" for f in files.split(",") if f.strip())
        jobs.append(LoadJob(name, inputs, config.folder, config))
    return jobs
