"""Arrow batches of bounded size for Python workers, and columns that a worker adds to a table."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a batch; long texts make batches of fewer rows.
ROWS, BYTES = 2_000, 16 << 20


def bounded(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df, whose session hands its rows to Python in batches of at most so many rows and about so many bytes from now on."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def give_back() -> None:
    """Returns freed memory to the system: Spark reuses workers, and what one stage freed would else stay with the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # other C libraries have no such call


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def mapped(df: DataFrame, source: str, added: list[tuple[str, T.DataType]], make: Callable[[pa.Array], list[pa.Array]], *, keep_source: bool = True, batch_rows: int = ROWS, batch_bytes: int = BYTES) -> DataFrame:
    """df with added columns, which make(a batch's values of source) gives; they replace columns of the same name."""
    names = [n for n, _ in added]
    passed = [c for c in df.columns if c not in names and (keep_source or c != source)]
    schema = T.StructType([f for f in df.schema.fields if f.name in passed])
    for name, kind in added:
        schema = schema.add(name, kind)
    extra = [] if source in passed else [F.col(f"`{source}`").alias("_source")]
    at = passed.index(source) if source in passed else len(passed)
    rows = bounded(df.select(*[F.col(f"`{c}`") for c in passed], *extra), batch_rows, batch_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *make(batch.column(at))], names=[*passed, *names])

    return rows.mapInArrow(trimmed(run), schema)
