"""Loads in dependency order that can be broken off and taken up again.

The tables of one level do not need each other, so they are written at the same time, each as a job group of its own in a fair pool; the next level
begins when they all are written. A finished table is noted in a manifest beside the data. A load that is run again under its name skips what the
manifest has and writes the rest anew over what was left of it, so nothing stands twice: each load owns a partition (``load``) of every table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesmith.operators.depgraph import spec_levels
from tablesmith.sources.sinks import literal, quote_name

MANIFEST = "load string, table string, level int, rows long"


def manifest(spark: SparkSession, base: str, load: str) -> DataFrame:
    """The finished tables of a load: ``load``, ``table``, ``level``, ``rows``."""
    try:
        return spark.read.schema(MANIFEST).json(f"{base}/_loads/{load}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _write(df: DataFrame, name: str, base: str, fmt: str, load: str) -> None:
    if fmt == "table":
        full, target = f"{base}.{name}", df.withColumn("load", F.lit(load))
        columns = ", ".join(f"`{c}`" for c in df.columns)
        if not df.sparkSession.catalog.tableExists(full):  # empty at first: a table that fails while it is created leaves its folder behind
            df.sparkSession.createDataFrame([], target.schema).write.partitionBy("load").saveAsTable(full)
        df.sparkSession.sql(f"INSERT OVERWRITE {full} PARTITION (load = '{load}') SELECT {columns} FROM {{rows}}", rows=df)
    else:
        df.write.mode("overwrite").format(fmt).save(f"{base}/{name}.{fmt}/load={load}")


def load_by_level(tables: dict[str, DataFrame], levels: list[list[str]], base: str, load: str, fmt: str = "parquet", notes: str | None = None, at_once: int = 8) -> DataFrame:
    """Write ``tables`` level by level below a folder (or into a database with ``fmt`` "table"; then ``notes`` is the manifest's folder); the manifest.

    If a table fails, the others of its level are still finished and noted, and no later level begins; the error is raised. ``at_once``
    tables are written at the same time at most.
    """
    if not re.fullmatch(r"[\w-]+", load):
        raise ValueError(f"{load!r} is no name of a load")
    spark = next(iter(tables.values())).sparkSession
    context, notes = spark.sparkContext, notes or base
    done = {r["table"] for r in manifest(spark, notes, load).select("table").collect()}  # a row for each table

    def write(name: str, level: int) -> None:
        seen = Observation()
        context.setJobGroup(f"{load}: {name}", f"load {name} of level {level}")
        context.setLocalProperty("spark.scheduler.pool", name)
        _write(tables[name].observe(seen, F.count(F.lit(1)).alias("rows")), name, base, fmt, load)
        spark.createDataFrame([(load, name, level, seen.get["rows"])], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{notes}/_loads/{load}/{name}")

    for level, names in enumerate(levels):
        left = [t for t in names if t in tables and t not in done]
        with ThreadPoolExecutor(max(1, min(at_once, len(left)))) as pool:
            failed = [e for job in as_completed([pool.submit(write, t, level) for t in left]) if (e := job.exception())]
        if failed:
            raise failed[0]
    return manifest(spark, notes, load)


def load_spec(tables: dict[str, DataFrame], spec, base: str, load: str, **options) -> DataFrame:
    """``load_by_level`` in the levels of a spec's required references."""
    return load_by_level(tables, spec_levels(spec), base, load, **options)


def loaded(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table with the rows of all its loads."""
    return (spark.table(f"{base}.{name}") if fmt == "table" else spark.read.format(fmt).load(f"{base}/{name}.{fmt}")).drop("load")


def insert_batches(df: DataFrame, table: str, rows: int = 100, dialect: str = "ansi") -> DataFrame:
    """``statement``: INSERTs of up to ``rows`` rows of literal values each; columns sorted by name.

    Rows are gathered within their partition as they come, without a shuffle; only the last statement of a partition is shorter.
    """
    if rows < 1:
        raise ValueError("a statement has one row at least")
    kinds, columns = dict(df.dtypes), sorted(df.columns)
    head = f"INSERT INTO {quote_name(table, dialect)} ({', '.join(quote_name(c, dialect) for c in columns)}) VALUES "
    values = F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(f"`{c}`"), kinds[c]) for c in columns]), F.lit(")"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) // rows * rows
            if full:
                yield pa.RecordBatch.from_pydict({"statement": [f"{head}{', '.join(held[i : i + rows])};" for i in range(0, full, rows)]})
                held = held[full:]
        if held:
            yield pa.RecordBatch.from_pydict({"statement": [f"{head}{', '.join(held)};"]})

    return df.select(values.alias("v")).mapInArrow(gather, "statement string")
