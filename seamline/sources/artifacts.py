"""Tables of an index as one folder: written, checked and read; reports as JSON; results of workflows that expire."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 1


def export_tables(tables: dict[str, DataFrame], path: str, *, overwrite: bool = False) -> None:
    """A Parquet folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "error").option("compression", "zstd").parquet(f"{path}/{name}")


def import_tables(spark: SparkSession, path: str, required: list[str]) -> dict[str, DataFrame]:
    """The tables of a folder; raises where one is missing or cannot be read."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in required}


# -- checked artifacts ----------------------------------------------------------


def _row_hash(df: DataFrame) -> Column:
    """A hash that doesn't depend on the order of rows when added up; maps and structs go by their JSON."""
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)]
    return F.xxhash64(*values)


def _seal(df: DataFrame) -> tuple[int, str]:
    rows, total = df.agg(F.count(F.lit(1)), F.sum(_row_hash(df).cast("decimal(38,0)"))).first()
    return rows, str(total or 0)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """One JSON file, replaced as a whole."""
    fs, target = _fs(spark, path)
    _, attempt = _fs(spark, f"{path}.attempt")
    out = fs.create(attempt, True)
    out.write(bytearray(json.dumps(payload, sort_keys=True, default=str).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(attempt, target)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a JSON file; None where there is no such file or it holds something else."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return None
    return found if isinstance(found, dict) else None


def export_index(tables: dict[str, DataFrame], path: str) -> dict:
    """Tables and a manifest of their rows and hashes; the manifest is written last, so a broken export has none."""
    spark = next(iter(tables.values())).sparkSession
    export_tables(tables, path, overwrite=True)
    sealed = {name: dict(zip(("rows", "hash"), _seal(spark.read.parquet(f"{path}/{name}")))) for name in tables}
    write_json(spark, f"{path}/manifest.json", sealed)
    return sealed


def import_index(spark: SparkSession, path: str, required: list[str], into: str | None = None, *, overwrite: bool = False) -> dict[str, DataFrame]:
    """The tables of an export whose rows and hashes are those of its manifest; with `into`, copied there and moved into place at once."""
    sealed = read_json(spark, f"{path}/manifest.json")
    if sealed is None:
        raise FileNotFoundError(f"no whole export at {path}")
    tables = import_tables(spark, path, required)
    for name, df in tables.items():
        if name not in sealed or _seal(df) != (sealed[name]["rows"], sealed[name]["hash"]):
            raise ValueError(f"table {name} of {path} is not what was exported")
    if into is None:
        return tables
    fs, target = _fs(spark, into)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"{into} exists; pass overwrite to replace it")
    _, attempt = _fs(spark, f"{into}.importing")
    fs.delete(attempt, True)
    export_index(tables, f"{into}.importing")
    fs.delete(target, True)
    fs.rename(attempt, target)
    return import_tables(spark, into, required)


# -- reports and results that expire --------------------------------------------


def write_reports(spark: SparkSession, folder: str, metadata: dict, stats: DataFrame) -> None:
    """metadata.json, and stats.json from (metric, value) rows."""
    write_json(spark, f"{folder}/metadata.json", metadata)
    write_json(spark, f"{folder}/stats.json", {r["metric"]: r["value"] for r in stats.collect()})


def cache_key(fingerprint: str, name: str, params: dict) -> str:
    """Equal for equal states of the index and its configuration, name and parameters."""
    return hashlib.sha256(json.dumps([fingerprint, name, params], sort_keys=True, default=str).encode()).hexdigest()


class WorkflowCache:
    """Results of named workflows in a folder, as tables; one is used again until ttl_seconds have passed (0: never)."""

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str, ttl_seconds: int = 300, enabled: bool = True, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.fingerprint, self.ttl, self.enabled, self.clock = spark, folder, fingerprint, ttl_seconds, enabled, clock

    def get(self, name: str, params: dict, compute: Callable[[], DataFrame]) -> tuple[DataFrame, dict]:
        """The result, and {hit, enabled, key, age_seconds}."""
        if not self.enabled:
            return compute(), {"hit": False, "enabled": False}
        key = cache_key(self.fingerprint, name, params)
        path, now = f"{self.folder}/{key}", self.clock()
        made = read_json(self.spark, f"{path}/made.json")
        if made and self.ttl > 0 and now - made["at"] <= self.ttl:
            return self.spark.read.parquet(f"{path}/{made['table']}"), {"hit": True, "enabled": True, "key": key, "age_seconds": round(now - made["at"], 3)}
        table = f"rows-{int(now * 1000)}"
        compute().write.mode("overwrite").parquet(f"{path}/{table}")
        write_json(self.spark, f"{path}/made.json", {"at": now, "table": table})
        return self.spark.read.parquet(f"{path}/{table}"), {"hit": False, "enabled": True, "key": key, "age_seconds": 0}


def save_snapshot(folder: str, sha: str, tables: dict[str, DataFrame]) -> None:
    """A commit's component graph, for comparisons, under its sha."""
    spark = next(iter(tables.values())).sparkSession
    export_tables(tables, f"{folder}/{sha}", overwrite=True)
    write_json(spark, f"{folder}/{sha}/snapshot.json", {"schema_version": SNAPSHOT_VERSION, "sha": sha, "tables": sorted(tables)})


def load_snapshot(spark: SparkSession, folder: str, sha: str) -> dict[str, DataFrame] | None:
    """What save_snapshot wrote for this sha by this version; None for anything else."""
    found = read_json(spark, f"{folder}/{sha}/snapshot.json")
    if not found or found.get("schema_version") != SNAPSHOT_VERSION or found.get("sha") != sha or not found.get("tables"):
        return None
    return import_tables(spark, f"{folder}/{sha}", found["tables"])


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def clear_index(spark: SparkSession, folder: str, keep: list[str] = ("evidence", "entities", "relationships")) -> list[str]:
    """Removes an index's tables from a folder, but not those of its memory; returns what was removed."""
    fs, target = _fs(spark, folder)
    gone = []
    if fs.exists(target):
        for status in fs.listStatus(target):
            name = status.getPath().getName()
            if name not in keep:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)
