"""Folders that the driver and all executors share, below spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local run gets one of its own and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seamline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing exists there yet."""
    return f"{shared_root(spark)}/seamline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str, passing: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here and lost executors cost nothing before it.

    The path joins `passing`, if given, for the caller to remove once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if passing is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_all(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    while paths:
        remove(spark, paths.pop())


def hadoop_fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_fs(spark, path)
    fs.delete(jpath, True)


class Files:
    """Raw files below one shared folder, for Python workers: plain calls on file: URIs, pyarrow's file systems on all others."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = unquote(parsed.path) if parsed.scheme else uri
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self, folder: str = "") -> None:
        if self.local:
            os.makedirs(self._at(folder), exist_ok=True)
        else:
            self.fs.create_dir(self._at(folder).rstrip("/"), recursive=True)

    def write(self, name: str):
        return open(self._at(name), "wb") if self.local else self.fs.open_output_stream(self._at(name), compression=None)

    def read(self, name: str):
        return open(self._at(name), "rb") if self.local else self.fs.open_input_file(self._at(name))

    def move(self, old: str, new: str) -> None:
        """Replaces new at once, so that a repeated task leaves one whole file."""
        if self.local:
            os.replace(self._at(old), self._at(new))
        else:
            if self.fs.get_file_info(self._at(new)).is_file:
                self.fs.delete_file(self._at(new))
            self.fs.move(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        os.remove(self._at(name)) if self.local else self.fs.delete_file(self._at(name))
