"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import setting


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir; where that is unset, a local run has one of its own and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seamline-")
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


class Tables:
    """Tables as attributes, each made when it is first asked for: written ones to a folder of their own, once, others as plans."""

    def __init__(self, spark: SparkSession, name: str, written: dict[str, Callable[[], DataFrame]], plans: dict[str, Callable[[], DataFrame]]):
        self._spark, self._folder, self._written, self._plans = spark, folder(spark, name), written, plans

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._written and name not in self._plans:
            raise AttributeError(name)
        found = self._put(name) if name in self._written else self._plans[name]()
        setattr(self, name, found)
        return found

    def _put(self, name: str) -> DataFrame:
        made = self._written[name]()
        # what a table was shuffled through goes as soon as it is written, not when the driver happens to collect garbage
        with setting(self._spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            made.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._folder}/{name}")
        return self._spark.read.parquet(f"{self._folder}/{name}")
