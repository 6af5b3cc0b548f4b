"""Profiles of tables that grow: what each part of a table holds is kept, so that only new parts are read.

A part's entry has counts, ends, the longest text and a sketch of the distinct values for each column, from one aggregation over the part. Entries
of parts add up without the rows. Distinct values are estimates of bounded size; where what follows from them (a unique column, a short list of
values) lies near its threshold, that column alone is counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.profile import ENUM_LIMIT, scalar_fields

#: Log2 of a sketch's registers, and how far an estimate may be from the truth (several standard errors).
REGISTERS, MARGIN = 14, 0.05
COLUMNS = ["part", "table", "column", "type", "rows", "filled", "low", "high", "longest", "sketch"]


def sketch_parts(df: DataFrame, table: str, part: str) -> DataFrame:
    """An entry for each part (values of the column ``part``, or ``_metadata.file_path`` for files) and scalar column, in one scan."""
    fields = [f for f in scalar_fields(df) if f.name != part]
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        facts = {"filled": F.count(c), "low": F.min(c).cast("string"), "high": F.max(c).cast("string"), "longest": F.max(F.char_length(text)).cast("long"), "sketch": F.hll_sketch_agg(text, F.lit(REGISTERS))}
        aggregates += [value.alias(f"{name}_{i}") for name, value in facts.items()]
    entries = []
    for i, f in enumerate(fields):
        named = [F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")]
        entries.append(F.struct(*named, *[F.col(f"{name}_{i}").alias(name) for name in COLUMNS[5:]]))
    found = df.groupBy(F.col(part).cast("string").alias("part")).agg(*aggregates)
    return found.select("part", F.lit(table).alias("table"), "rows", F.explode(F.array(*entries)).alias("e")).select("part", "table", "rows", "e.*").select(*COLUMNS)


def new_parts(df: DataFrame, part: str, known: DataFrame) -> DataFrame:
    """The rows of parts that no entry is of: for ``_metadata.file_path`` the files are left out before they are read."""
    return df.join(F.broadcast(known.select(F.col("part").alias("_known")).distinct()), F.col(part).cast("string") == F.col("_known"), "left_anti")


def add_up(entries: DataFrame) -> DataFrame:
    """One entry for each table and column, of whatever parts: ``table``, ``column``, ``type``, ``rows``, ``nulls``, ``distinct_values`` (estimated), ``low``, ``high``, ``longest``."""

    def end(name: str, f, kind: str):
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        return F.when(F.first("type") == kind, f(F.col(name).try_cast(kind)).cast("string") if numeric else f(name))

    kinds = [r["type"] for r in entries.select("type").distinct().collect()]  # a row for each type
    ends = [F.coalesce(*[end(name, f, k) for k in kinds], F.lit(None).cast("string")).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    sums = [F.first("type").alias("type"), F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("filled")).alias("nulls"), F.max("longest").alias("longest")]
    out = entries.groupBy("table", "column").agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"), *ends)
    return out.select("table", "column", "type", "rows", "nulls", "distinct_values", "low", "high", "longest")


def profile_from(entries: DataFrame, df: DataFrame) -> DataFrame:
    """The profile of the table that the entries describe, with ``is_unique`` and ``is_enum``; ``df`` (the whole table) is read only for columns whose
    estimates are near a threshold, and then ``distinct_values`` is exact (``exact``)."""
    merged = add_up(entries)
    facts = {r["column"]: r for r in merged.collect()}  # a row for each column
    near = [c for c, r in sorted(facts.items()) if r["rows"] and (r["distinct_values"] >= (1 - MARGIN) * r["rows"] or r["distinct_values"] <= (1 + MARGIN) * ENUM_LIMIT + 1)]
    counts = [df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.lit(1)).agg(F.count("v").alias("d")).select(F.lit(c).alias("column"), "d") for c in near]
    none = df.sparkSession.createDataFrame([], T.StructType([T.StructField("column", T.StringType()), T.StructField("d", T.LongType())]))
    exact = reduce(DataFrame.unionByName, counts, none)
    d = F.coalesce("d", "distinct_values").alias("distinct_values")
    flags = [F.coalesce((F.col("d") == F.col("rows")) & (F.col("rows") > 0), F.lit(False)).alias("is_unique"), F.coalesce((F.col("d") <= ENUM_LIMIT) & (F.col("d") > 0), F.lit(False)).alias("is_enum")]
    return merged.join(F.broadcast(exact), "column", "left").select("table", "column", "type", "rows", "nulls", d, "low", "high", "longest", *flags, F.col("d").isNotNull().alias("exact"))
