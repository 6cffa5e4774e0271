"""Commits and changed files of a git repository. git runs on the driver; its output becomes tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

_FIELDS = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s"


#: Where an index keeps its files within a repository.
OWN_FOLDER = ".seamline/"


def run_git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def is_repository(root: str) -> bool:
    try:
        return run_git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (RuntimeError, OSError):
        return False


def parse_log(text: str) -> Iterator[tuple]:
    for record in text.split("\x1e")[1:]:
        head, *files = record.split("\n")
        yield (*head.split("\x1f"), [f for f in files if f.strip()])


def commits(spark: SparkSession, root: str, max_commits: int = 500) -> DataFrame:
    """The newest commits, oldest first, with the paths each touched."""
    if not is_repository(root):
        return spark.createDataFrame([], schema.COMMITS)
    log = run_git(root, "log", f"--max-count={max_commits}", "--reverse", "--name-only", f"--pretty=format:{_FIELDS}")
    return spark.createDataFrame(list(parse_log(log)), schema.COMMITS)


def parse_log_files(lines: DataFrame) -> DataFrame:
    """The same from a column `value` of one log record a row (split at %x1e): for logs too large for the driver."""
    rows = F.split("value", "\n")
    head = F.split(F.get(rows, F.lit(0)), "\x1f")
    files = F.filter(F.slice(rows, 2, F.size(rows)), lambda f: F.trim(f) != "")
    names = ["sha", "author", "email", "ts", "subject"]
    return lines.where(F.length("value") > 0).select(*[F.get(head, F.lit(i)).alias(n) for i, n in enumerate(names)], files.alias("files"))


def changes(status: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, status of name-status lines and untracked paths (value, seq): the last field of a line is its path, untracked
    files count as added, each path's first line counts, and the index's own folder is left out."""
    fields = F.split("value", "\t")
    tracked = status.where(F.size(fields) > 1).select(F.element_at(fields, -1).alias("path"), F.get(fields, F.lit(0)).alias("status"), F.struct(F.lit(0).alias("part"), "seq").alias("at"))
    others = untracked.where(F.trim("value") != "").select(F.col("value").alias("path"), F.lit("A").alias("status"), F.struct(F.lit(1).alias("part"), "seq").alias("at"))
    rows = tracked.unionByName(others).where(~F.contains(F.col("path"), F.lit(OWN_FOLDER)))
    return rows.groupBy("path").agg(F.min_by("status", "at").alias("status"))


def changed_files(spark: SparkSession, root: str, base_ref: str = "HEAD") -> DataFrame:
    """path, status against a ref; untracked files count as added, each path once."""
    lines = lambda *args: spark.createDataFrame([(v, i) for i, v in enumerate(run_git(root, *args).splitlines())], "value string, seq long")
    return changes(lines("diff", "--name-status", base_ref), lines("ls-files", "--others", "--exclude-standard"))


def snapshot(root: str, ref: str, into: str) -> str:
    """Unpacks a ref's tree into a folder; refuses members outside it. Returns the ref's sha."""
    import io
    import tarfile

    sha = run_git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()
    raw = subprocess.run(["git", "-C", root, "archive", "--format=tar", sha], capture_output=True, check=True).stdout
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        tar.extractall(into, filter="data")
    return sha
