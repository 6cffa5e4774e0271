"""Results that several jobs read again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint where the session names a folder for it, else persisted in memory and on disk."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for what runs inside."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


#: Groups up to which an aggregate of lists stays a hash table; beyond, a task sorts all rows that it still reads.
GROUPS = 10_000


def kept_groups(df: DataFrame) -> DataFrame:
    """kept(), of an aggregate whose groups hold a bounded list each: tasks don't sort their rows for up to GROUPS of them."""
    with setting(df.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS)):
        return kept(df)
