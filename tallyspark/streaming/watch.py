"""Watching: a stream of changes that reruns the batch query, or updates it by deltas."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import EXCLUDED_DIRS

#: How often a watch looks for changes; a changed tree is scanned as a whole.
TRIGGER = "400 milliseconds"


@dataclass
class RetryState:
    """When to try again after a failed pass: after 5 s, then doubled up to 60 s.

    While a retry is due, changes alone start nothing; a root that vanished is polled.
    """

    first: float = 5.0
    most: float = 60.0
    delay: float = 0.0
    due: float | None = None

    def failed(self, now: float) -> float:
        self.delay = min(self.most, self.delay * 2) if self.delay else self.first
        self.due = now + self.delay
        return self.delay

    def succeeded(self) -> None:
        self.delay, self.due = 0.0, None

    def root_lost(self, now: float) -> None:
        self.delay, self.due = 0.0, now

    def ready(self, now: float, changed: bool) -> bool:
        return changed if self.due is None else now >= self.due


class _Changes(SimpleDataSourceStreamReader):
    """A version of the tree (a hash of names, times and sizes of its files) as the offset; a row for each new version."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def version(self) -> str:
        found = hashlib.sha256()
        for folder, dirs, files in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS)
            for f in sorted(files):
                try:
                    s = os.stat(os.path.join(folder, f))
                except OSError:
                    continue
                found.update(f"{os.path.join(folder, f)}\0{s.st_mtime_ns}\0{s.st_size}\0".encode("utf-8", "surrogateescape"))
        return found.hexdigest()

    def initialOffset(self) -> dict:
        return {"version": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.version()
        return iter([(now,)] if now != start["version"] else []), {"version": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(end["version"],)] if end["version"] != start["version"] else [])


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "version string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options)


def watch_tree(spark: SparkSession, root: str, on_change: Callable[[SparkSession], None], checkpoint: str | None = None, trigger: str = TRIGGER, once: bool = False, clock: Callable[[], float] | None = None, on_error: Callable[[Exception], None] | None = None):
    """A streaming query that calls on_change for every changed version of the tree.

    A failing pass is told to on_error, keeps the last good result and is tried again later.
    """
    import time

    spark.dataSource.register(TreeChanges)
    now, retry, pending = clock or time.time, RetryState(), {"changed": False}

    def each(batch: DataFrame, _: int) -> None:
        pending["changed"] |= not batch.isEmpty()
        if not os.path.isdir(root):
            retry.root_lost(now())
            return
        if not retry.ready(now(), pending["changed"]):
            return
        try:
            on_change(batch.sparkSession)
            retry.succeeded()
            pending["changed"] = False
        except Exception as problem:
            retry.failed(now())
            if on_error:
                on_error(problem)

    writer = spark.readStream.format("treechanges").load(root).writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="0 seconds") if once else writer.trigger(processingTime=trigger)).start()


def count_deltas(updates: DataFrame) -> DataFrame:
    """Changes of counts by language from a stream of (path, language, code, comment, blank), one state for each path.

    A path seen again gives the difference to its last counts, so sums of the result are
    the counts of the latest version of every file.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        for frame in frames:
            for row in frame.sort_values("version", kind="stable").itertuples():
                new = (row.language, int(row.code), int(row.comment), int(row.blank))
                out = [(new[0], 1, *new[1:])]
                if old:
                    out.append((old[0], -1, -old[1], -old[2], -old[3]))
                yield pd.DataFrame(out, columns=["language", "files", "code", "comment", "blank"])
                old = new
        state.update(old)

    return updates.groupBy("path").applyInPandasWithState(
        step, "language string, files long, code long, comment long, blank long", "language string, code long, comment long, blank long", "append", GroupStateTimeout.NoTimeout
    )


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("language").agg(*(F.sum(c).alias(c) for c in ("files", "code", "comment", "blank")))
