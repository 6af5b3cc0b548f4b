"""Pages of a large table in the order of its key, found by the number of rows before them.

The table is written once in ranges of its key, each a partition of files, with the rows of each range beside it. A page then reads the one or two
ranges that hold it and sorts these alone, however late it is.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.gaps import as_text

PART = "_part"


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{folder}/rows")


def write_pages(df: DataFrame, key: list[str], folder: str, parts: int | None = None) -> Pages:
    """Write ``df`` in ``parts`` ranges of ``key`` (the session's shuffle partitions if not given). Rows of one key share a range."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *key).withColumn(PART, F.spark_partition_id())
    ranged.sortWithinPartitions(PART, *key).write.partitionBy(PART).parquet(f"{folder}/rows")
    _read(spark, folder, df.schema).groupBy(PART).count().coalesce(1).write.parquet(f"{folder}/counts")
    return Pages(spark, folder, key, df.schema)


class Pages:
    """A written table; one row for each range is kept on the driver."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: T.StructType):
        self.key, self.columns = key, [f.name for f in schema]
        self.rows = _read(spark, folder, schema)
        self.counts = sorted(map(tuple, spark.read.parquet(f"{folder}/counts").collect()))
        self.ends = list(accumulate(n for _, n in self.counts))

    def page(self, offset: int, limit: int = 25) -> DataFrame:
        """1 to 100 rows from ``offset`` on, as ``preview`` has them."""
        offset, limit = max(0, offset), min(100, max(1, limit))
        first, last = bisect_right(self.ends, offset), bisect_right(self.ends, offset + limit - 1)
        own = [part for part, _ in self.counts[first : last + 1]]
        found = self.rows.filter(F.col(PART).isin(own) if own else F.lit(False)).orderBy(PART, *self.key)
        return as_text(found.offset(offset - (self.ends[first - 1] if first else 0)).limit(limit), self.columns)
