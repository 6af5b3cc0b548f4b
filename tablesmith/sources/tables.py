"""Sets of named tables: loading, row counts, and dense indexes over existing key columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_tables(spark: SparkSession, base: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Named tables below a folder or, with ``fmt`` "table", in a database; nothing is read yet."""
    if fmt == "table":
        return {n: spark.table(f"{base}.{n}" if base else n) for n in names}
    return {n: spark.read.format(fmt).load(f"{base}/{n}" if fmt != "parquet" else f"{base}/{n}.parquet") for n in names}


def load_jdbc(spark: SparkSession, url: str, names: list[str], **options: str) -> dict[str, DataFrame]:
    """Named tables of an external database."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


def load_export(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Generated data read back for export to another format."""
    return spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; set where none is."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` read back from the session's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` read back from files of a new folder beside the session's checkpoints.

    A checkpoint keeps the size that Spark had estimated, and a join's is the product of its sides': in a loop that joins what it cut, that
    number gets twice as many digits each round, until it fills the driver. Files have their own size. They are not compressed, so that it
    tells whether a side may be broadcast.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of at most so many narrow rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its ``rows`` are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def key_values(df: DataFrame, column: str) -> DataFrame:
    """Only a table's key values; the scan reads that column alone."""
    return df.select(F.col(column).alias("key")).filter(F.col("key").isNotNull())


def preload_keys(tables: dict[str, DataFrame], spec, targets: list[str]) -> dict[tuple[str, str], DataFrame]:
    """The key values of every parent column that a target refers to, and no others."""
    wanted = {v.parent for t in targets for v in spec.tables[t].values() if v.parent and v.parent[0] in tables}
    return {p: key_values(tables[p[0]], p[1]) for p in sorted(wanted)}


def dense_index(keys: DataFrame, column: str = "key") -> DataFrame:
    """``idx`` (0, 1, ... in the order of the key) and ``key`` of the distinct key values, without one partition for all.

    The sorted keys are cut from their lineage first, so that both passes see the same partitions.
    """
    ordered = cut_lineage(keys.select(F.col(column).alias("key")).distinct().orderBy("key").select("key", F.monotonically_increasing_id().alias("m")))
    place = ordered.select("key", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("offset"))
    sizes = place.groupBy("part").count()  # one row for each partition
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return place.join(F.broadcast(before), "part").select((F.col("before") + F.col("offset")).alias("idx"), "key")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table`` and ``n`` of every table, in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in sorted(tables.items())])
