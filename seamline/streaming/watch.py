"""A watched folder as a stream: changed source files, each batch taken into the index in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..sources import scan

#: Seconds after an accepted event within which others of the same tree are dropped.
DEBOUNCE = 0.3


def source_events(spark: SparkSession, root: str, *, files_a_batch: int = 1000) -> DataFrame:
    """path, mtime, content of new files below root, as they come."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return raw.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root).select("path", F.col("modificationTime").alias("mtime"), "content")


def relevant(events: DataFrame, endings: list[str] = (".py",)) -> DataFrame:
    """Events of watched endings outside ignored folders."""
    wanted = F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    return events.where(wanted & ~scan.path_ignored(F.col("path"), scan.IGNORED, []))


def _taken(rows: pd.DataFrame, last: float | None, wait: float) -> tuple[pd.DataFrame, float | None]:
    """Rows that come `wait` seconds or more after the last taken one, and when the last of them came."""
    keep = []
    for at in rows.sort_values("seconds").itertuples():
        if last is None or at.seconds - last >= wait:
            keep.append(at.Index)
            last = at.seconds
    return rows.loc[keep, ["tree", "path", "seconds"]], last


def _leading_edge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for rows in batches:
        taken, last = _taken(rows, last, DEBOUNCE)
        yield taken
    if last is not None:
        state.update((float(last),))


def debounced(events: DataFrame) -> DataFrame:
    """tree, path, seconds of events (tree, path, seconds) that come DEBOUNCE seconds or more after the last accepted of their tree."""
    return events.groupBy("tree").applyInPandasWithState(_leading_edge, "tree string, path string, seconds double", "last double", "append", "NoTimeout")


def debounced_table(events: DataFrame, wait: float = DEBOUNCE) -> DataFrame:
    """The same of a table: events (tree, path, seconds) that come `wait` seconds or more after the last taken of their tree.

    Times stream through a task in order, with the last taken one of a tree as all that it holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for rows in batches:
            for tree, mine in rows.groupby("tree", sort=False):
                taken, last[tree] = _taken(mine, last.get(tree), wait)
                yield taken

    return events.repartition("tree").sortWithinPartitions("tree", "seconds").mapInPandas(run, "tree string, path string, seconds double")


def watch(events: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Gives each batch of events to take(batch, number), one after the other; a batch that failed comes again."""
    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, began, ended, events of event streams or tables with ts: the latest state of each session."""
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")
