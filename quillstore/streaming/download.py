"""Fetching published files from remote places, on the driver.

A place is an ``http(s)://`` URL, a ``file://`` URL or any other URI that Hadoop's file systems know.  Files arrive
under a temporary name, are verified, renamed, and the pointer is written last.
"""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import urllib.request
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import SparkSession

from ..plans.files import Files
from ..sources.properties import read_properties, write_atomically
from ..types import StoreError

CHUNK = 1 << 20


def normalise(url: str) -> str:
    """A URL without a scheme is http."""
    return url if "://" in url else f"http://{url}"


def fetch(url: str, timeout: float = 30.0):
    """An open binary stream of a URL."""
    url = normalise(url)
    if url.startswith("file://"):
        return open(url[len("file://") :], "rb")  # noqa: SIM115
    if url.startswith(("http://", "https://")):
        return urllib.request.urlopen(url, timeout=timeout)  # noqa: S310
    return _files(url).open(url)


def _files(url: str) -> Files:
    """Any other place, through the session's file systems."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise StoreError(f"{url} needs a session")
    return Files(spark, "")


def fetch_text(url: str, timeout: float = 30.0) -> str:
    with fetch(url, timeout) as f:
        return f.read().decode("utf-8").strip()


def glob(pattern: str) -> list[str]:
    """Files that match a pattern, in a local folder or in any store that Spark reads."""
    if "://" in pattern and not pattern.startswith("file://"):
        return _files(pattern).glob(pattern)
    folder, _, name = pattern.removeprefix("file://").rpartition("/")
    return sorted(f"{folder}/{f}" for f in os.listdir(folder or ".") if fnmatch.fnmatch(f, name))


def checksum(name: str):
    """A running hash: ``xxh`` (64 bits) or ``xxh3``."""
    import xxhash

    kinds = {"xxh": xxhash.xxh64, "xxh3": xxhash.xxh3_64}
    if name not in kinds:
        raise StoreError(f"unknown checksum {name}")
    return kinds[name]()


def save(stream, path: str, compression: str | None = None, hash_name: str | None = None, expected: str | None = None, size: int | None = None) -> str | None:
    """Copy a stream to a file, decompressing (``zst``) and hashing what is written on the way; verify, then rename."""
    if compression not in (None, "zst"):
        raise StoreError(f"unknown compression {compression}")
    running = checksum(hash_name) if hash_name else None
    if compression:
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    temporary, written = f"{path}.tmp", 0
    try:
        with open(temporary, "wb") as out:
            if size and hasattr(os, "posix_fallocate"):
                os.posix_fallocate(out.fileno(), 0, size)
            while chunk := stream.read(CHUNK):
                out.write(chunk)
                written += len(chunk)
                if running:
                    running.update(chunk)
            out.truncate(written)
        if size is not None and size != written:
            raise StoreError(f"{path}: {written} bytes, not {size}")
        if running and expected and running.hexdigest() != expected.lower():
            raise StoreError(f"{path}: checksum {running.hexdigest()}, not {expected}")
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.remove(temporary)
        raise
    return running.hexdigest() if running else None


@dataclass
class Job:
    """What to download: base URLs, a file name such as ``x.cache``, and where to put it."""

    urls: list
    name: str
    folder: str
    hash_name: str = "xxh3"
    compression: str | None = "zst"
    retain: int = 1
    inputs: list = field(default_factory=list)
    fetched: list = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    @property
    def pointer(self) -> str:
        return f"{self.name}.timestamp.latest"

    def versioned(self, ts: int) -> str:
        stem, dot, extension = self.name.rpartition(".")
        return f"{stem}.{ts}.{extension}" if dot else f"{self.name}.{ts}"


def newest_source(urls: list, pointer: str, timeout: float = 30.0) -> tuple[str, int]:
    """(url, timestamp) of the newest pointer; the first of several wins, places out of reach are skipped."""
    best = None
    for url in urls:
        try:
            ts = int(fetch_text(f"{url.rstrip('/')}/{pointer}", timeout))
        except (OSError, ValueError, StoreError):
            continue
        if best is None or ts > best[1]:
            best = (url, ts)
    if best is None:
        raise StoreError(f"no source has {pointer}")
    return best


def local_timestamp(job: Job) -> int | None:
    try:
        with open(f"{job.folder}/{job.pointer}", encoding="utf-8") as f:
            return int(f.read().strip())
    except (OSError, ValueError):
        return None


def staleness(job: Job, remote: int | None, size: int | None = None, expected: str | None = None) -> str | None:
    """Why a download is due, or None."""
    have = local_timestamp(job)
    if remote is None:
        return None
    if not os.path.isdir(job.folder):
        return "no local folder"
    if have is None:
        return "no local pointer"
    path = f"{job.folder}/{job.versioned(have)}"
    if have < remote:
        return "remote is newer"
    if have > remote:
        return None
    if not os.path.exists(path):
        return "no local file"
    if size is not None and os.path.getsize(path) != size:
        return "size differs"
    if expected is not None:
        running = checksum(job.hash_name)
        with open(path, "rb") as f:
            while chunk := f.read(CHUNK):
                running.update(chunk)
        if running.hexdigest() != expected.lower():
            return "checksum differs"
    return None


class Reason(IntEnum):
    """Why a download is due, or is not."""

    UP_TO_DATE = 0
    NO_TIMESTAMP = 1
    MISSING_LATEST_TIMESTAMP = 2
    MISSING_REMOTE_INPUTS = 3
    MISSING_LOCAL_INPUTS = 4
    EMPTY_REMOTE_INPUTS = 5
    EMPTY_LOCAL_INPUTS = 6
    SIMILAR_REMOTE_AND_LOCAL_INPUTS = 7
    DIFFERENT_REMOTE_AND_LOCAL_INPUTS = 8
    NOT_ENOUGH_FILES = 9


def _text_or_none(read) -> str | None:
    try:
        return read()
    except (OSError, StoreError):
        return None


def decide(job: Job, timeout: float = 30.0) -> tuple[bool, Reason]:
    """Whether a download is due, by the pointers and, where these differ, by the lists of inputs (``<stem>.inputs``)
    that were built from; in any case a file of the remote version must be there."""
    try:
        url, ts = newest_source(job.urls, job.pointer, timeout)
    except StoreError:
        return True, Reason.NO_TIMESTAMP
    have = local_timestamp(job)
    if have is None:
        return True, Reason.MISSING_LATEST_TIMESTAMP
    verdict = Reason.UP_TO_DATE
    if have != ts:
        stem = job.name.rpartition(".")[0] or job.name

        def local():
            with open(f"{job.folder}/{stem}.inputs", encoding="utf-8") as f:
                return f.read().strip()

        there, here = _text_or_none(lambda: fetch_text(f"{url.rstrip('/')}/{stem}.inputs", timeout)), _text_or_none(local)
        for text, missing, empty in ((there, Reason.MISSING_REMOTE_INPUTS, Reason.EMPTY_REMOTE_INPUTS), (here, Reason.MISSING_LOCAL_INPUTS, Reason.EMPTY_LOCAL_INPUTS)):
            if not text:
                return True, missing if text is None else empty
        if there != here:
            return True, Reason.DIFFERENT_REMOTE_AND_LOCAL_INPUTS
        verdict = Reason.SIMILAR_REMOTE_AND_LOCAL_INPUTS
    return (False, verdict) if os.path.exists(f"{job.folder}/{job.versioned(ts)}") else (True, Reason.NOT_ENOUGH_FILES)


def settings_of(url: str, job: Job, ts: int, timeout: float = 30.0) -> dict[str, str]:
    """Settings published beside a version, else those beside the file, else none."""
    stem = job.name.rpartition(".")[0] or job.name
    for name in (f"{stem}.{ts}.properties", f"{stem}.properties"):
        try:
            text = fetch_text(f"{url.rstrip('/')}/{name}", timeout)
        except (OSError, StoreError):
            continue
        path = f"{job.folder}/{stem}.properties"
        write_atomically(path, text + "\n")
        job.fetched.append(path)
        return read_properties(path, strict=True)
    return {}


def run(job: Job, timeout: float = 30.0) -> int | None:
    """Download the newest version unless it is there; returns its timestamp if it was downloaded.

    On an error everything fetched is removed; afterwards only the newest versions are kept.
    """
    os.makedirs(job.folder, exist_ok=True)
    url, ts = newest_source(job.urls, job.pointer, timeout)
    if staleness(job, ts) is None:
        return None
    base = url.rstrip("/")
    remote = job.versioned(ts)
    try:
        job.settings = settings_of(url, job, ts, timeout)
        expected = fetch_text(f"{base}/{remote}.{job.hash_name}", timeout)
        target = f"{job.folder}/{remote}"
        suffix = f".{job.compression}" if job.compression else ""
        with fetch(f"{base}/{remote}{suffix}", timeout) as stream:
            save(stream, target, job.compression, job.hash_name, expected)
        job.fetched.append(target)
        for name in job.inputs:
            with fetch(f"{base}/{name}", timeout) as stream:
                save(stream, f"{job.folder}/{name}")
            job.fetched.append(f"{job.folder}/{name}")
        write_atomically(f"{job.folder}/{job.pointer}", str(ts))
    except BaseException:
        clean_after_error(job)
        raise
    retain(job)
    return ts


def clean_after_error(job: Job) -> None:
    for path in [*job.fetched, *temporary_files(job.folder)]:
        if os.path.exists(path):
            os.remove(path)
    job.fetched.clear()


def temporary_files(folder: str) -> list[str]:
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".tmp")) if os.path.isdir(folder) else []


def timestamps(folder: str, name: str) -> list[int]:
    """Distinct numbers in the second or third part of file names that begin with the name's stem, ascending."""
    stem = name.rpartition(".")[0] or name
    found = set()
    for f in os.listdir(folder):
        parts = f.split(".")
        if parts[0] == stem:
            found |= {int(p) for p in parts[1:3] if re.fullmatch("[0-9]+", p)}
    return sorted(found)


def retain(job: Job) -> list[int]:
    """Remove temporary files and all versions but the newest."""
    for path in temporary_files(job.folder):
        os.remove(path)
    gone = timestamps(job.folder, job.name)[: -job.retain or None]
    stem = job.name.rpartition(".")[0] or job.name
    for f in os.listdir(job.folder):
        if any(f.startswith(f"{stem}.{ts}.") for ts in gone):
            path = f"{job.folder}/{f}"
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
    return gone


class Downloader:
    """Polls remote places: ``wait`` until there is something new, then ``run``."""

    def __init__(self, job: Job):
        self.job = job

    def due(self) -> bool:
        try:
            _, ts = newest_source(self.job.urls, self.job.pointer)
        except StoreError:
            return False
        return staleness(self.job, ts) is not None

    def wait(self, limit: float | None = None, **options) -> bool:
        from .refresh import wait_for

        return wait_for(self.due, limit=limit, **options)

    def run(self, attempts: int = 5, **options) -> int | None:
        from .refresh import retry

        return retry(lambda timeout: run(self.job, timeout), attempts, **options)
