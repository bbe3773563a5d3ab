"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelwave.session import scratch_path

#: A word is a run of characters other than these separators (space and the ASCII controls 9 to 13).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later plans start from files that
    every executor reaches, so a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as 64-bit-offset strings without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def cut(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of ``column`` each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.frombuffer(texts_of(batch.column(column)).buffers()[1], np.int64)[: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def by_slices(
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, limit: int = 1 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that hands ``fn`` slices of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run
