"""An index that follows a stream of changed files: each batch is taken in by an incremental update, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..plans import index as plan
from ..sources import artifacts
from . import watch

#: A change of a file: its language and content, or a null content where it is gone.
CHANGE = "path string, language string, content string, seq long"


def _version(spark: SparkSession, folder: str) -> int:
    return (artifacts.read_json(spark, f"{folder}/current.json") or {}).get("version", -1)


def current(spark: SparkSession, folder: str) -> plan.Index:
    """The index as the last batch left it."""
    path = f"{folder}/version={_version(spark, folder)}"
    return plan.Index(**artifacts.import_tables(spark, path, list(plan.Index.__dataclass_fields__)))


def begin(index: plan.Index, folder: str) -> None:
    spark = index.files.sparkSession
    artifacts.export_tables({name: getattr(index, name) for name in plan.Index.__dataclass_fields__}, f"{folder}/version=0", overwrite=True)
    artifacts.write_json(spark, f"{folder}/current.json", {"version": 0, "batch": -1})


def take(spark: SparkSession, folder: str, batch: DataFrame, number: int) -> None:
    """Takes a batch of changes in. A batch that comes again after its update was committed changes nothing.

    The tables of the version before are removed once the new one is in place.
    """
    state = artifacts.read_json(spark, f"{folder}/current.json")
    if state["batch"] >= number:
        return
    index = current(spark, folder)
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    changes = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
    content = F.col("content")
    written = changes.where("content is not null").select("path", "language", F.length(content).cast("long").alias("size_bytes"), F.sha2(content.cast("binary"), 256).alias("sha256"), tx.line_count(content).alias("line_count"), "content")
    tree = index.files.join(changes.select("path"), "path", "left_anti").unionByName(written, allowMissingColumns=True)
    now, _ = plan.update(index, tree)
    version = state["version"] + 1
    artifacts.export_tables(dict(vars(now)), f"{folder}/version={version}", overwrite=True)
    artifacts.write_json(spark, f"{folder}/current.json", {"version": version, "batch": number})
    artifacts.remove(spark, f"{folder}/version={version - 1}")


def follow(changes: DataFrame, folder: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """changes: a stream of CHANGE rows. begin() must have put a first index into the folder."""
    spark = changes.sparkSession
    return watch.watch(changes, lambda batch, number: take(spark, folder, batch, number), checkpoint, once=once)
