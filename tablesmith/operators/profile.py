"""Profiling: what a catalog would declare, measured from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of at most so many distinct values are enum-like.
ENUM_LIMIT = 12


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """``table``, ``column``, ``ordinal``, ``type`` from the schema."""
    return df.sparkSession.createDataFrame([(table, c, i, k) for i, (c, k) in enumerate(df.dtypes, 1)], "table string, column string, ordinal int, type string")


def scalar_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def profile_table(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """One row for each scalar column: rows, nulls, distinct values, smallest and largest, longest text, and what follows from them.

    One aggregation for all columns but for the distinct values. With ``exact`` these are counted column by column, each scan and
    shuffle of one narrow column; without, they are estimates of bounded size within the one aggregation.
    """
    fields = scalar_fields(df)
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        parts += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), F.max(F.char_length(c.cast("string"))).alias(f"len{i}")]
        parts += [(F.max(c).cast("decimal(38,0)") - F.min(c).cast("decimal(38,0)") + 1 if whole else F.lit(None).cast("decimal(38,0)")).alias(f"span{i}")]
        parts += [] if exact else [F.approx_count_distinct(c).alias(f"d{i}")]
    facts = [
        F.struct(
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), "rows", (F.col("rows") - F.col(f"c{i}")).alias("nulls"), (F.lit(None).cast("long") if exact else F.col(f"d{i}")).alias("d"),
            F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.col(f"len{i}").cast("long").alias("longest"), F.col(f"span{i}").alias("span"),
        )
        for i, f in enumerate(fields)
    ]
    found = df.agg(*parts).select(F.explode(F.array(*facts)).alias("r")).select("r.*")
    if exact:
        counts = [df.select(F.col(f"`{f.name}`").alias("v")).groupBy("v").agg(F.lit(1)).agg(F.count("v").alias("d")).select(F.lit(f.name).alias("column"), "d") for f in fields]
        found = found.drop("d").join(F.broadcast(reduce(DataFrame.unionByName, counts)), "column")  # one row for each column
    full = (F.col("d") == F.col("rows")) & (F.col("rows") > 0)
    flags = [full.alias("is_unique"), F.coalesce((F.col("span") == F.col("d")) & full, F.lit(False)).alias("is_sequence"), ((F.col("d") <= ENUM_LIMIT) & (F.col("d") > 0)).alias("is_enum")]
    return found.select("table", "column", "type", "rows", "nulls", F.col("d").alias("distinct_values"), "low", "high", "longest", *flags)


def enum_domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and its sorted values, comma-joined, for columns known to have few."""
    sets = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns])
    return sets.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.array_join(c, ",").alias("domain"), F.size(c).cast("long").alias("n_values")) for c in columns])).alias("r")).select("r.*")


def parse_checks(clauses: DataFrame, clause_col: str = "clause") -> DataFrame:
    """CHECK clauses with ``check_values`` (array), ``check_min`` and ``check_max`` (signed integers), as far as the text states them.

    The first ``ARRAY[...]``, else the first ``in (...)``, gives the values. A range is ``between``, or ``>=`` and after it ``<=`` on one
    column; a lower bound above the upper one is no range.
    """
    clause = F.col(clause_col)
    between = r"(?i)\w+[`\"]?\)?\s+between\s+\(?(-?\d+)\)?\s+and\s+\(?(-?\d+)\b"
    pair = r"(?is)\b(\w+)[`\"]?\)?\s*>=\s*\(?(-?\d+)\b(?!\.).*?\b\1[`\"]?\)?\s*<=\s*\(?(-?\d+)\b(?!\.)"
    is_between = F.regexp_extract(clause, between, 1) != ""
    bounds = [F.when(is_between, F.regexp_extract(clause, between, i)).otherwise(F.regexp_extract(clause, pair, i + 1)).try_cast("long") for i in (1, 2)]
    low, high = (F.when(bounds[0] <= bounds[1], x) for x in bounds)
    inner = F.coalesce(F.nullif(F.regexp_extract(clause, r"(?is)array\s*\[([^\]]+)\]", 1), F.lit("")), F.regexp_extract(clause, r"(?is)\bin\s*\(([^)]+)\)", 1))
    values = F.transform(F.regexp_extract_all(inner, F.lit(r"'([^']+)'"), F.lit(1)), lambda v: F.regexp_replace(v, r"\\+$", ""))
    return clauses.select("*", values.alias("check_values"), low.alias("check_min"), high.alias("check_max"))


def enum_type_values(kind: Column) -> Column:
    """The values that a type such as ``enum('a','b')`` or ``set('a')`` lists, trimmed and without quotes; empty for other types."""
    inner = F.regexp_extract(kind, r"(?is)^\s*(?:enum|set)\s*\((.*)\)", 1)
    parts = F.transform(F.split(inner, ","), lambda v: F.regexp_replace(F.trim(v), r"^['\"]+|['\"]+$", ""))
    return F.filter(parts, lambda v: v != "")
