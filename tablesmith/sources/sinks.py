"""Sinks: ordered loads, text formats, truncation and structure clones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.sources.catalog import properties, quoted, spec_properties


def write_tables(tables: dict[str, DataFrame], order: list[str], base: str, fmt: str = "parquet", mode: str = "append", **options: str) -> list[str]:
    """Write each table, parents first, below a folder (or into a database with ``fmt`` "table"); the names written."""
    done = []
    for name in [t for t in order if t in tables]:
        writer = tables[name].write.mode(mode).options(**options)
        if fmt == "table":
            writer.saveAsTable(f"{base}.{name}" if base else name)
        elif fmt == "jdbc":
            writer.format("jdbc").option("dbtable", name).option("url", base).save()
        else:
            writer.format(fmt).save(f"{base}/{name}" + (".parquet" if fmt == "parquet" else ""))
        done.append(name)
    return done


def quote_name(name: str, dialect: str = "ansi") -> str:
    mark = "`" if dialect == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def literal(value: Column, kind: str) -> Column:
    """A value as an SQL literal."""
    plain = value.cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal"):
        text = plain
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str, dialect: str = "ansi") -> DataFrame:
    """``statement``: one INSERT with literal values for each row; columns sorted by name."""
    kinds = dict(df.dtypes)
    columns = sorted(df.columns)
    names = ", ".join(quote_name(c, dialect) for c in columns)
    values = F.concat_ws(", ", *[literal(F.col(f"`{c}`"), kinds[c]) for c in columns])
    return df.select(F.concat(F.lit(f"INSERT INTO {quote_name(table, dialect)} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


def csv_rows(df: DataFrame, table: str) -> DataFrame:
    """The table for CSV: a leading ``_table`` column, then all columns as text, sorted by name."""
    return df.select(F.lit(table).alias("_table"), *[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(df.columns)])


def write_text(tables: dict[str, DataFrame], base: str, fmt: str) -> None:
    """One folder for each table: ``json``, ``csv`` (with ``_table``) or ``sql`` (INSERT statements)."""
    for name, df in sorted(tables.items()):
        if fmt == "json":
            df.write.mode("overwrite").json(f"{base}/{name}")
        elif fmt == "csv":
            csv_rows(df, name).write.mode("overwrite").csv(f"{base}/{name}", header=True)
        else:
            insert_statements(df, name).write.mode("overwrite").text(f"{base}/{name}")


def truncate_tables(spark: SparkSession, order: list[str], database: str = "", progress: Callable[[str], None] | None = None) -> list[str]:
    """Empty the tables, children first; the names in that order."""
    done = []
    for name in reversed(order):
        spark.sql(f"TRUNCATE TABLE {f'{database}.' if database else ''}{name}")
        done.append(name)
        if progress:
            progress(name)
    return done


def clone_structure(spark: SparkSession, source: str, target: str, order: list[str], spec=None, drop: bool = False) -> list[str]:
    """Create the tables of database ``source`` in ``target``, empty, with their defaults, comments and properties; keys and checks of ``spec`` become properties too.

    A target that holds any of the tables is refused unless ``drop`` is set.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
    held = {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {target}").collect()} & set(order)
    if held and not drop:
        raise ValueError(f"{target} already has {', '.join(sorted(held))}")
    for name in [t for t in reversed(order) if t in held]:
        spark.sql(f"DROP TABLE {target}.{name}")
    for name in order:
        spark.sql(f"CREATE TABLE {target}.{name} LIKE {source}.{name}")
        marks = properties(spark, f"{source}.{name}") | (spec_properties(spec.tables.get(name, {})) if spec else {})
        if note := spark.catalog.getTable(f"{source}.{name}").description:
            marks["comment"] = note
        if marks:
            spark.sql(f"ALTER TABLE {target}.{name} SET TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in sorted(marks.items()))})")
    return order
