"""Helpers shared by the operators: tables, scratch tables, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ticksmith.session import scratch_path, table_path


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of texts, unless the session says otherwise.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: thousands of them in one Arrow batch would not be a bounded piece of memory."""
    if int(spark.conf.get(_BATCH_ROWS)) == 10_000:  # Spark's default
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the Python worker hands its free memory back: it stays and serves other stages."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, not the work
    before this point.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_columns(df: DataFrame, fields: list[StructField],
                fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """All columns of ``df`` plus ``fields``, filled by ``fn`` per Arrow batch.

    ``fields`` must not clash with columns of ``df`` (see ``free_name``).
    """
    schema = StructType(list(df.schema.fields) + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names = b.schema.names + [f.name for f in fields]
                yield pa.RecordBatch.from_arrays(list(b.columns) + fn(b), names=names)

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def text_chunks(texts: list, budget: int = 2_000_000, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` characters, at least one row each.

    Bounds the working memory of a batch; a longer text is a range of its own.
    """
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (size + n > budget or i - start >= most):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
