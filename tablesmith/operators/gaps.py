"""Gap analysis: which tables are empty, what they depend on, and filling them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.operators.depgraph import close_selection, display_parents
from tablesmith.operators.synth import Synthesis, synthesize
from tablesmith.sources.tables import row_counts


def empty_tables(counts: DataFrame, ranked: DataFrame) -> DataFrame:
    """``table`` and ``level`` of tables without rows, parents first."""
    return counts.filter("n = 0").join(ranked, "table").select("table", "level").orderBy("level", "table")


def gap_report(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """``table``, ``n``, ``status`` and ``depends_on``: each parent as ``p (filling)`` if it is empty too, else ``p (n rows)``."""
    parents = display_parents(edges).join(counts.select(F.col("table").alias("parent"), F.col("n").alias("parent_rows")), "parent", "left")
    text = F.when(F.coalesce("parent_rows", F.lit(0)) == 0, F.concat("parent", F.lit(" (filling)"))).otherwise(F.concat("parent", F.lit(" ("), F.col("parent_rows").cast("string"), F.lit(" rows)")))
    listed = parents.select(F.col("child").alias("table"), text.alias("text")).groupBy("table").agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("depends_on"))
    return counts.join(listed, "table", "left").select("table", "n", F.when(F.col("n") == 0, F.lit("empty")).otherwise(F.lit("ok")).alias("status"), F.coalesce("depends_on", F.lit("")).alias("depends_on"))


def gap_totals(counts: DataFrame, rows: int, overrides: dict[str, int] | None = None) -> DataFrame:
    """``tables``, ``gaps`` and ``planned_rows`` (overrides above 0 count instead of ``rows``)."""
    planned = F.lit(rows)
    for table, n in sorted((overrides or {}).items()):
        if n > 0:
            planned = F.when(F.col("table") == table, F.lit(n)).otherwise(planned)
    return counts.agg(F.count("*").alias("tables"), F.count_if(F.col("n") == 0).alias("gaps"), F.coalesce(F.sum(F.when(F.col("n") == 0, planned)), F.lit(0)).cast("long").alias("planned_rows"))


def scoped_gaps(counts: DataFrame, edges: DataFrame, selected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Empty tables among the selection and all of its hard parents, parents first."""
    return empty_tables(counts, ranked).join(close_selection(edges, selected).select("table"), "table", "left_semi").orderBy("level", "table")


def fill_gaps(spark: SparkSession, spec, tables: dict[str, DataFrame], rows: int = 50, **options) -> Synthesis:
    """Rows for the empty tables of ``tables`` only; keys of the others are drawn from their rows."""
    empty = [r["table"] for r in row_counts(tables).filter("n = 0").collect()]
    filled = {t: df for t, df in tables.items() if t not in empty}
    if not empty:
        return Synthesis({}, [], spark.createDataFrame([], "table string, requested long, generated long, reason string"))
    return synthesize(spark, spec, rows=rows, targets=empty, existing=filled, **options)


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text, by name, ``NULL`` for null."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in sorted(columns)])


def preview(df: DataFrame, key: list[str], limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of a table in the order of its key: 1 to 100 rows, all columns as text by name, ``NULL`` for null."""
    return as_text(df.orderBy(*key).offset(max(0, offset)).limit(min(100, max(1, limit))), df.columns)


def generated_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows for each table and in total (table ``(total)``)."""
    return row_counts(tables).rollup("table").agg(F.sum("n").alias("n")).select(F.coalesce("table", F.lit("(total)")).alias("table"), F.coalesce("n", F.lit(0)).alias("n"))


def dry_run(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """``table``, ``n`` and ``sample`` (the row of the smallest key, as JSON) of each table, in one job; nothing is written."""
    parts = [df.agg(F.count("*").alias("n"), F.min_by(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), keys[t]).alias("sample")).select(F.lit(t).alias("table"), "n", "sample") for t, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)
