"""Token ids as Parquet files: list columns in a stated encoding, row groups and pages of a stated size, and a small table of the files.

A folder of token files holds ``tokens`` (one row per document in ascending order of the id: the id, ``part`` (the number of its file),
``before`` (ids of the same file before it), ``n_tokens`` and ``ids``) and ``parts`` (one row per file: its first place among all ids, its documents
and ids). Places are sums of two numbers, so no document needs to know more than its file. Reads are selective: metadata alone
leaves the ids' column chunks unread, conditions on ids of documents or on places reach row groups and page indexes.

Documents are dealt to files by ranges of (id, hash of the text), so that rows that share an id may stand in several files; texts are encoded where
they are written. Rows that share an id are ordered by hash and text, a null id comes first, a null or empty text is the end id alone, a very
long text is one row, an empty table gives files without rows and an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.batches import blocks, id_and_text, list_array
from tablesmith.llm.components import shared_folder
from tablesmith.llm.subwords import byte_level_units

#: Files at most; beyond it they grow. The table of files has so many rows, and no more are ever broadcast.
MAX_FILES = 10_000
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 5 << 20


def layout(encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, page_rows: int = 2_000, codec: str = "zstd") -> dict[str, str]:
    """Options of the Parquet writer. ``encoding`` of the ids: ``dictionary``, or ``delta`` for vocabularies that outgrow a dictionary page."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    return {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": str(4 << 20),
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": codec,
    }


def _encoded(path: str, end_id: int, special_tokens: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, before = byte_level_units(path, special_tokens), TaskContext.get().partitionId(), 0
        for docs in blocks(batches, BLOCK_BYTES):
            use, n = units.of(docs.column("text").combine_chunks())
            ids, count = units.ids(0, use, n)
            ends = np.cumsum(count + 1)
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype=np.int32)
            own = np.ones(len(flat), dtype=bool)
            own[ends - 1] = False
            flat[own] = ids
            places = before + ends - (count + 1)
            before += len(flat)
            yield pa.RecordBatch.from_arrays([docs.column("id").combine_chunks(), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(places), pa.array(count + 1), list_array(flat, count + 1, pa.int32())], names=names)

    return run


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True, file_bytes: int = 256 << 20, options: dict[str, str] | None = None) -> TokenFiles:
    """Encode the texts and write the files; ``tokenizer`` must be readable on every executor under that name.

    With ``special_tokens`` their strings within a text are these tokens, else plain text.
    """
    src = id_and_text(df, id_col, text_col)
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = min(MAX_FILES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / file_bytes)))
    dealt = src.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    kind = src.schema["id"].dataType.simpleString()
    names = [id_col, "part", "before", "n_tokens", "ids"]
    made = dealt.mapInArrow(_encoded(tokenizer, end_id, special_tokens, names), f"`{id_col}` {kind}, part int, before long, n_tokens long, ids array<int>")
    made.write.options(**(layout() if options is None else options)).parquet(f"{folder}/tokens")
    held = df.sparkSession.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    start = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row for each file
    held.select("part", start.alias("start"), "documents", "n", "first_id", "last_id").coalesce(1).write.parquet(f"{folder}/parts")
    return TokenFiles(df.sparkSession, folder, id_col)


class TokenFiles:
    """A written folder."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id"):
        self.spark, self.id_col = spark, id_col
        self.rows, self.parts = spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/parts")

    def _placed(self, *columns: str, where: Column | None = None, parts: DataFrame | None = None) -> DataFrame:
        rows = self.rows if where is None else self.rows.filter(where)
        starts = (self.parts if parts is None else parts).select("part", "start")
        return rows.join(F.broadcast(starts), "part").select(self.id_col, (F.col("start") + F.col("before")).alias("start"), "n_tokens", *columns)

    def documents(self, where: Column | None = None) -> DataFrame:
        """The id, ``start`` and ``n_tokens`` of each document; the ids stay unread."""
        return self._placed(where=where)

    def tokens(self, where: Column | None = None) -> DataFrame:
        """``documents`` with ``ids``; a condition on the id skips row groups and pages."""
        return self._placed("ids", where=where)

    def window(self, start: int, length: int) -> DataFrame:
        """The ids at the places from ``start`` on, ``length`` of them, by document: only files and pages that hold some are read."""
        own = self.parts.filter((F.col("start") < start + length) & (F.col("start") + F.col("n") > start)).collect()  # files of one window
        if not own:
            return self.tokens(F.lit(False))
        where = F.lit(False)
        for r in own:
            low, high = start - r["start"], start + length - r["start"]
            where |= (F.col("part") == r["part"]) & (F.col("before") < high) & (F.col("before") + F.col("n_tokens") > low)
        found = self._placed("ids", where=F.col("part").between(min(r["part"] for r in own), max(r["part"] for r in own)) & where)
        skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
        take = F.least(F.col("start") + F.col("n_tokens"), F.lit(start + length)) - F.col("start") - skip
        return found.select(self.id_col, (F.col("start") + skip).alias("start"), take.alias("n_tokens"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))

    def digests(self) -> DataFrame:
        """The id, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) of each document, from the files."""
        id_col, src = self.id_col, self.tokens()
        kind = src.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("ids")
                ends, raw = np.asarray(lists.offsets).tolist(), memoryview(np.asarray(lists.values, dtype="<u4")).cast("B")
                sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

        return src.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own among those that all executors share."""
    return f"{shared_folder(spark)}/tokens-{uuid4()}"
