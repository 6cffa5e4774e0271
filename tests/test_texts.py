"""Titles and snippets of documents whose lines begin or end with digits and spaces, against the queries' SQL."""

import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seamline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
#: A line's place among its text's lines must not be taken for characters to cut off it.
TEXTS = ["0 zero\n1219 one edit 1\n2 two\n3 33 layout 3", "  # 0 heading \n 1 one \n\n\u00a0 4 four\u3000\nlayout", "a\r\n1 b\rc", "#\n11", "", None, " \n \n2", "x" * 690 + "\n1 y\u00a0 z", "the word edi alone"]
NAMES = ["document_summary", "memory_evidence", "memory_entities", "evidence_fallback"]


def linked(folder, but: str) -> str:
    """The tables of DATA in a folder, without one."""
    for path in glob.glob(f"{DATA}/*.parquet"):
        if os.path.basename(path) != f"{but}.parquet":
            os.symlink(path, folder / os.path.basename(path))
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, n = tmp_path_factory.mktemp("texts"), len(TEXTS)
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": TEXTS, "lang": ["en"] * n, "source": ["web"] * n, "n_chars": [len(t or "") for t in TEXTS]}), folder / "documents.parquet")
    return linked(folder, "documents")


@pytest.fixture(scope="module")
def untouched(tmp_path_factory):
    """Commits that touch no file."""
    folder = tmp_path_factory.mktemp("untouched")
    pq.write_table(pq.read_table(f"{DATA}/lineitem.parquet").slice(0, 0), folder / "lineitem.parquet")
    return linked(folder, "lineitem")


def differences(spark, folder: str, name: str) -> tuple[list, list]:
    """Rows of a query's SQL that its plan lacks, and those that it has besides."""
    got, con = QUERIES[name](spark, folder).toArrow(), duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    con.register("got", got)
    con.sql(f"create table want as {SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    both = lambda a, b: con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall()[:2]
    return both("want", "got"), both("got", "want")


@pytest.mark.parametrize("name", NAMES)
def test_lines_keep_their_characters(spark, odd, name):
    assert differences(spark, odd, name) == ([], [])


def test_summary_of_commits_without_files(spark, untouched):
    assert differences(spark, untouched, "memory_component_summary") == ([], [])
