"""Detection of compactions in sessions that are being written: a batch form and a streaming form."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.sources.scratch import file_system
from winnow.sources.sessions import replace


def is_compaction(before: Column, now: Column, last_type: Column) -> Column:
    """A session fell below half its lines, but not to two, and either says so or fell below a third."""
    return (now < F.floor(before / 2)) & (now > 2) & ((last_type == "compacted") | (now < F.floor(before / 3)))


def events(observed: DataFrame) -> DataFrame:
    """observed (session, seq, n_lines, last_type) -> the observations at which a compaction shows."""
    before = F.lag("n_lines").over(Window.partitionBy("session").orderBy("seq"))
    return observed.withColumn("prev_lines", before).where(is_compaction(F.col("prev_lines"), F.col("n_lines"), F.col("last_type")))


def watch(observed: DataFrame) -> DataFrame:
    """The same over a stream, with the last count of lines as each session's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if before is not None and r.n_lines < before // 2 and r.n_lines > 2 and (r.last_type == "compacted" or r.n_lines < before // 3):
                rows.append((key[0], int(r.seq), int(r.n_lines), int(before)))
            before = int(r.n_lines)
        state.update((before,))
        yield pd.DataFrame(rows, columns=["session", "seq", "n_lines", "prev_lines"])

    return observed.groupBy("session").applyInPandasWithState(step, "session string, seq long, n_lines long, prev_lines long", "prev_lines long", "append", "NoTimeout")


def on_event(stream: DataFrame, compact: Callable[[DataFrame], None], checkpoint: str, seconds: int = 2):
    """Start the watcher; compact(events) runs for each batch of events and must bear being run twice on one."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            compact(batch)

    return watch(stream).writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(run).start()


class Snapshots:
    """Copies of sessions from before they were compacted, a file for each below `folder`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, session: str) -> str:
        return f"{self.folder}/{hashlib.sha256(session.encode()).hexdigest()}.jsonl"

    def take(self, session: str) -> None:
        """Copy the session's file as it is now; a later copy takes an earlier one's place."""
        (source, fs), (target, to) = file_system(self.spark, session), file_system(self.spark, self._path(session))
        to.mkdirs(target.getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, target, False, self.spark.sparkContext._jsc.hadoopConfiguration())

    def of(self, session: str) -> str | None:
        path, fs = file_system(self.spark, self._path(session))
        return path.toString() if fs.exists(path) else None


def answer_compaction(spark: SparkSession, session: str, snapshots: Snapshots, compact: Callable[[str], list[str]], backups: str) -> str:
    """A session was compacted by its model: put our own compaction of its snapshot in its place.

    Without a snapshot, or if ours fails or gives no lines, the model's output stays. Says which: "replaced", or "kept" and
    why. Either way the file as it is then becomes the next snapshot.
    """
    if (before := snapshots.of(session)) is None:
        said = "kept: no snapshot"
    else:
        try:
            said = "replaced" if replace(spark, session, compact(before), backups) else "kept: nothing to write"
        except Exception as e:
            said = f"kept: {e}"
    snapshots.take(session)
    return said
