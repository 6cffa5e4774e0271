"""Source trees and documents as tables of files."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Folders left out, languages of endings, and where documents are.
IGNORED = [".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "__pycache__", "node_modules", "build", "dist", "coverage", "target"]
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript"}
DOCUMENTS = ["README*", "CHANGELOG*", "RELEASE*", "docs/*.md", "docs/*.rst", "docs/*.txt", "adr/*.md", "adrs/*.md", "rfcs/*.md", "design/*.md", "designs/*.md"]


def glob_regex(pattern: str) -> str:
    return "^" + fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")


def path_ignored(path: Column, folders: list[str], globs: list[str]) -> Column:
    """A folder of the path is listed, or a glob (its * crosses slashes) fits the path."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) if folders else F.lit(False)
    return reduce(lambda a, g: a | path.rlike(glob_regex(g)), globs, inside)


def language(path: Column, enabled: list[str] | None = None) -> Column:
    """The language of the path's ending; null for others and for those not enabled."""
    known = {e: v for e, v in LANGUAGES.items() if enabled is None or v in enabled}
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    ending = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.element_at(F.create_map(*pairs), ending) if pairs else F.lit(None).cast("string")


def _walk(uri: str, below: str, deep: bool) -> Iterator[tuple[str, str, int, int, bool]]:
    """uri, path (with `below` before it), size, milliseconds, is a folder: of a folder's entries, or of all files under it.

    Also what Spark's readers hide (_*, .*); links are left out.
    """
    join = lambda *parts: "/".join(p for p in parts if p)
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        for entry in sorted(os.scandir(unquote(parsed.path) if parsed.scheme else uri), key=lambda e: e.name):
            if entry.is_symlink():
                continue
            if entry.is_dir() and deep:
                yield from _walk(entry.path, join(below, entry.name), True)
            else:
                stat = entry.stat()
                yield entry.path, join(below, entry.name), stat.st_size, int(stat.st_mtime * 1000), entry.is_dir()
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(path.strip("/"))] if path.strip("/") else uri
    for info in sorted(system.get_file_info(fs.FileSelector(path, recursive=deep)), key=lambda i: i.path):
        folder = info.type == fs.FileType.Directory
        if folder and deep:
            continue
        millis = int(info.mtime.timestamp() * 1000) if info.mtime else 0
        yield head + info.path.strip("/"), join(below, info.path[len(path) :].strip("/")), info.size or 0, millis, folder


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """FOUND rows of all files below root: the driver lists two levels of folders, tasks list what is below them."""
    base = root if urlparse(root).scheme else os.path.abspath(root)
    files, folders = [], [(base, "")]
    for _ in range(2):
        entries = [e for uri, below in folders for e in _walk(uri, below, False)]
        files += [e[:4] for e in entries if not e[4]]
        folders = [(e[0], e[1]) for e in entries if e[4]]
    here = spark.createDataFrame(files, FOUND)
    if not folders:
        return here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uri", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("millis", pa.int64())])
        for batch in batches:
            for uri, below in zip(batch.column("uri").to_pylist(), batch.column("below").to_pylist()):
                found = _walk(uri, below, True)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in list(zip(*part))[:4]], schema=schema)

    spread = spark.createDataFrame(folders, "uri string, below string").repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    return here.union(spread.mapInArrow(run, FOUND))


def _content(uri: str) -> bytes:
    if "://" not in uri:
        with open(uri, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read()


FOUND = "uri string, path string, length long, millis long"
READ = "path string, length long, modificationTime timestamp, content binary"


def _binary(spark: SparkSession, root: str, wanted) -> DataFrame:
    """path, length, modificationTime, content of files that wanted(path column) keeps; workers read what is kept."""
    kept = _listed(spark, root).where(wanted(F.col("path")))
    spread = kept.repartition(spark.sparkContext.defaultParallelism, "path").withColumn("modificationTime", F.timestamp_millis("millis"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column("uri").to_pylist()):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("path"), one.column("length"), one.column("modificationTime"), pa.array([_content(uri)], pa.binary())], names=["path", "length", "modificationTime", "content"])

    return spread.mapInArrow(read, READ)


def source_files(spark: SparkSession, root: str, *, ignore_folders: list[str] = IGNORED, ignore_globs: list[str] = (), languages: list[str] | None = None) -> DataFrame:
    """path, language, size_bytes, mtime, sha256, line_count, content of a tree's source files."""
    wanted = lambda path: language(path, languages).isNotNull() & ~path_ignored(path, list(ignore_folders), list(ignore_globs))
    rows = _binary(spark, root, wanted).withColumn("language", language(F.col("path"), languages))
    content = F.decode("content", "UTF-8")
    return rows.select("path", "language", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), tx.line_count(content).alias("line_count"), content.alias("content"))


def is_document(path: Column, ignore_folders: list[str] = IGNORED) -> Column:
    """Whether a path is one of the documents that tell about a repository."""
    named = reduce(lambda a, g: a | path.rlike(glob_regex(g)), DOCUMENTS, F.lit(False))
    return named & ~path_ignored(path, list(ignore_folders), [])


def described(rows: DataFrame) -> DataFrame:
    """path, content, title, snippet of documents (path, content as text)."""
    content = F.col("content")
    return rows.select("path", "content", tx.title(content, F.col("path")).alias("title"), tx.compact_snippet(content).alias("snippet"))


def document_files(spark: SparkSession, root: str, *, ignore_folders: list[str] = IGNORED) -> DataFrame:
    """path, content, title, snippet of READMEs, change logs and the texts below docs and the like."""
    rows = _binary(spark, root, lambda path: is_document(path, ignore_folders))
    return described(rows.withColumn("content", F.decode("content", "UTF-8")))
