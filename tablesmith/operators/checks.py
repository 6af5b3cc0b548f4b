"""Constraint checks. Each gives the violating rows (or groups) as a DataFrame; ``summary`` makes one row of any of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.depgraph import jump
from tablesmith.sources.tables import row_counts


def summary(violations: DataFrame, name: str) -> DataFrame:
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``check`` and ``violations`` for each named check, in one job."""
    return reduce(DataFrame.unionByName, [summary(df, name) for name, df in sorted(checks.items())])


def orphans(child: DataFrame, column: str, parent: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent; the parent's scan reads the key alone."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(ref_column).alias(column)), column, "left_anti")


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with null in any of the columns. File tables accept null in a NOT NULL column, so this must be measured."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """The values (of one column or a composite key) that occur more than once, and how often; null keys are no duplicates."""
    full = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return full.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def out_of_range(df: DataFrame, column: str, low: float | Column | None = None, high: float | Column | None = None) -> DataFrame:
    """Rows outside [low, high]; null passes."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.filter(bad)


def outside_domain(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose value is none of ``values`` (a list, or a DataFrame's first column for large domains); null passes."""
    if isinstance(values, DataFrame):
        return df.filter(F.col(column).isNotNull()).join(values.select(values[values.columns[0]].alias(column)), column, "left_anti")
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def too_long(df: DataFrame, column: str, length: int) -> DataFrame:
    return df.filter(F.char_length(column) > length)


def malformed(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(~F.col(column).rlike(pattern))


def undercovered(df: DataFrame, column: str, domain: list[str], least: int = 1) -> DataFrame:
    """``value`` and ``n`` of each value of the domain that fewer than ``least`` rows have."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    held = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return wanted.join(held, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def broken_chains(tables: dict[str, DataFrame], chain: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows of the first child that do not reach the last parent; ``chain``: (child, column, parent, ref_column)."""
    # From the last parent back: the keys of each table whose rows reach the end. Semi joins need no distinct parents, and only keys move.
    reached = tables[chain[-1][2]].select(F.col(chain[-1][3]).alias("_key"))
    for (_, _, _, key), (child, column, _, _) in reversed(list(zip(chain, chain[1:], strict=False))):
        reached = tables[child].join(reached, F.col(column) == F.col("_key"), "left_semi").select(F.col(key).alias("_key"))
    child, column, _, _ = chain[0]
    return tables[child].join(reached, F.col(column) == F.col("_key"), "left_anti")


def roots(df: DataFrame, parent_col: str, id_col: str) -> DataFrame:
    """Rows that are roots of a self-reference: no parent, or themselves."""
    return df.filter(F.col(parent_col).isNull() | (F.col(parent_col) == F.col(id_col)))


def depths(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``id``, ``root`` and ``depth`` (0 at a root) of every row of a self-reference; both null for rows on a cycle or below one. A parent that is no row counts as a root."""
    links = df.select(F.col(id_col).alias("node"), F.col(parent_col).alias("target"))
    above = F.col("target").isNotNull() & (F.col("target") != F.col("node"))
    found = jump(links.filter(above).withColumn("dist", F.lit(1)))
    whole = found.select(F.col("node").alias("id"), F.when(~F.col("stuck"), F.col("end")).alias("root"), F.when(~F.col("stuck"), F.col("dist")).alias("depth"))
    return whole.unionByName(links.filter(~above | F.col("target").isNull()).select(F.col("node").alias("id"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")))


def depth_violations(df: DataFrame, id_col: str, parent_col: str, depth: int) -> DataFrame:
    """``id`` of rows more than ``depth`` steps from a root; rows on a cycle or below one never reach a root and violate."""
    return depths(df, id_col, parent_col).filter(F.col("depth").isNull() | (F.col("depth") > depth)).select("id")


def unexpected_counts(tables: dict[str, DataFrame], expected: dict[str, int | str]) -> DataFrame:
    """Tables whose rows are not as expected: a number, or ``filled`` or ``empty``."""
    want = next(iter(tables.values())).sparkSession.createDataFrame([(t, str(v)) for t, v in sorted(expected.items())], "table string, expected string")
    fits = F.when(F.col("expected") == "filled", F.col("n") > 0).when(F.col("expected") == "empty", F.col("n") == 0).otherwise(F.col("n") == F.expr("try_cast(expected AS BIGINT)"))
    return want.join(row_counts(tables), "table", "left").filter(~F.coalesce(fits, F.lit(False))).select("table", "expected", "n")


def gaps_left(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables that are still empty after a fill."""
    return row_counts(tables).filter("n = 0")


def fk_count_differences(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """``child`` with its number of references and the expected one (child, n_expected) where they differ."""
    held = edges.groupBy("child").agg(F.count("*").alias("n"))
    return held.join(expected, "child", "full_outer").select("child", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_expected", F.lit(0)).alias("n_expected")).filter("n <> n_expected")


def structure_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two column catalogs (table, column, ordinal, type) that only one of them has or that differ in type or place."""
    x, y = (c.select("table", "column", F.col("type").alias(f"{n}_type"), F.col("ordinal").alias(f"{n}_ordinal")) for c, n in ((a, "a"), (b, "b")))
    return x.join(y, ["table", "column"], "full_outer").filter(~(F.col("a_type").eqNullSafe(F.col("b_type")) & F.col("a_ordinal").eqNullSafe(F.col("b_ordinal"))))
