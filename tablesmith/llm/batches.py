"""Small helpers shared by the Arrow-based operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark may put into one Arrow batch: texts are long, and both sides of a task hold whole batches.
BATCH_ROWS = 1000
#: Bytes of text that one step of a task works on; bounds the memory of a task whatever the length of the rows.
STEP_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; a lower setting stays.

    Spark reads the setting when a plan runs, so it can't be restored here: it holds for the session's later queries too.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The two columns an operator reads, so that other columns (whatever their names) are pruned from the scan."""
    small_batches(df)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of their text column (one row at least)."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def blocks(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Join batches to tables of about ``limit`` bytes of their text column; a longer text is a table of its own."""
    held, size = [], 0
    for part in steps(batches, limit, column):
        own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(part)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers, of which hash partitioning by an int column into ``n`` partitions puts one into each (a few may meet)."""
    own = spark.range(8 * n + 256).select(F.col("id").cast("int").alias("id"))
    found = [r["id"] for r in own.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()]  # n rows at most
    return [*found, *range(8 * n + 256, 8 * n + 256 + n - len(found))]


class Numbering(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the flat values and each row's length."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
