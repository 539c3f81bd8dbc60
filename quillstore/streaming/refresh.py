"""Hot swap of a published view, by polling or by a streaming query over the manifests.

Readers name a temporary view.  A swap opens the new version first and replaces the view last; if opening fails the
old view stays, and plans made on it go on reading the old version, which is immutable.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import SnapshotStore
from ..types import NotFoundError, StoreError, UninitializedError


class Refresher:
    """Keeps a view at the newest version of a name, or at a pinned one, which ends polling."""

    def __init__(self, store: SnapshotStore, name: str, view: str | None = None, callback: Callable[[int], None] | None = None, preload: bool = False, pinned: int | None = None):
        self.pinned = pinned
        self.store, self.name, self.view = store, name, view or name
        self.callback, self.preload = callback, preload
        self.timestamp, self.frame, self._closed = -1, None, False
        self._lock, self._stop, self._thread = threading.Lock(), threading.Event(), None

    def update(self, ts: int | None = None) -> int:
        """Open a version (the latest by default) and swap it in; on failure the published one stays."""
        with self._lock:
            if self._closed:
                raise UninitializedError(f"{self.name} is closed")
            ts = ts if ts is not None else self.pinned if self.pinned is not None else self.store.latest_timestamp(self.name)
            new = self.store.open(self.name, ts, preload=self.preload)
            new.createOrReplaceTempView(self.view)
            old, self.frame, self.timestamp = self.frame, new, ts
            if old is not None and self.preload:
                old.unpersist()
        if self.callback:
            self.callback(ts)
        return ts

    def poll(self) -> bool:
        """Swap if the pointer is strictly newer; whether it was.  A pinned version is never swapped."""
        if self.pinned is not None:
            return False
        try:
            ts = self.store.latest_timestamp(self.name)
        except NotFoundError:
            return False
        if ts <= self.timestamp:
            return False
        self.update(ts)
        return True

    def start(self, seconds: float) -> None:
        """Poll in the background.  An error is kept in ``error`` and polling goes on."""
        self.error: Exception | None = None
        if self.pinned is not None:
            return

        def loop():
            while not self._stop.wait(seconds):
                try:
                    self.poll()
                except Exception as e:  # the published version stays; the next round may succeed
                    self.error = e

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def close(self) -> None:
        """Stop polling and drop the view; closing twice is fine, lookups then fail."""
        self._stop.set()
        if self._thread:
            self._thread.join(timeout=10)
        with self._lock:
            if not self._closed:
                self._closed = True
                self.store.spark.catalog.dropTempView(self.view)
                if self.frame is not None and self.preload:
                    self.frame.unpersist()
                self.frame = None

    def follow(self, checkpoint: str, trigger: str | None = None):
        """The same as a streaming query: a file source over the manifests, of which each batch's newest is swapped in.
        Without a trigger it handles what is there and ends."""
        stream = self.store.spark.readStream.schema("name string, creation_time_ms bigint").json(f"{self.store.root}/{self.name}.*.manifest.json")

        def swap(batch: DataFrame, _: int):
            newest = batch.where(F.col("name") == self.name).agg(F.max("creation_time_ms")).first()[0]
            if newest is not None and newest > self.timestamp:
                self.update(newest)

        writer = stream.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def retry(action: Callable, attempts: int = 5, timeouts=(1, 5, 8, 12, 18), delay: float = 2.0, sleep=time.sleep):
    """Call ``action(timeout)`` until it succeeds, with a longer timeout each time."""
    for i in range(attempts):
        try:
            return action(timeouts[min(i, len(timeouts) - 1)])
        except Exception:
            if i == attempts - 1:
                raise
            sleep(delay)
    raise StoreError("no attempts")


def wait_for(ready: Callable[[], bool], least: float = 5.0, most: float = 30.0, limit: float | None = None, sleep=time.sleep, jitter=random.random) -> bool:
    """Wait with growing pauses and jitter until something is ready; False after ``limit`` seconds of pauses."""
    pause, waited = least, 0.0
    while not ready():
        if limit is not None and waited >= limit:
            return False
        step = pause * (0.5 + jitter() / 2)
        sleep(step)
        waited += step
        pause = min(most, pause * 2)
    return True
