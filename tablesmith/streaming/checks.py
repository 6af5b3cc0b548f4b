"""Row-level constraint checks that work alike on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``violations``: the sorted names of the rules (conditions that must hold; null passes) that a row breaks."""
    broken = [F.when(~F.coalesce(holds, F.lit(True)), F.lit(name)) for name, holds in sorted(rules.items())]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def windowed_counts(df: DataFrame, rules: dict[str, Column], time_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start``, ``rule`` and ``n``: violations for each window of event time; on a stream, rows later than ``late`` are left out."""
    timed = flag(df, rules)
    timed = timed.withWatermark(time_col, late) if df.isStreaming else timed  # a stream's event time must be a TIMESTAMP
    rows = timed.select(F.window(time_col, width).alias("w"), F.explode("violations").alias("rule"))
    return rows.groupBy("w", "rule").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "rule", "n")
