"""Stored tables as rows of a catalog: types, defaults, comments, generated columns and properties; and tables made from a spec with all of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table string, column string, attribute string, value string"
#: Properties that Spark and its catalogs keep for themselves.
OWN = ("transient_lastDdlTime", "option.", "spark.", "view.", "numFiles", "totalSize", "rawDataSize", "numRows", "COLUMN_STATS_ACCURATE", "bucketing_version", "owner", "is_managed_location", "external", "provider")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    """What was set on a table by users."""
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if not r["key"].startswith(OWN)}


def catalog_rows(spark: SparkSession, database: str, names: list[str]) -> DataFrame:
    """``table``, ``column`` (empty for the table itself), ``attribute`` and ``value``: type, ordinal, default and comment of each column, the comment of the table,
    and its properties (keys, checks and generated columns among them)."""
    rows = []
    for name in names:
        full = f"{database}.{name}"
        for i, f in enumerate(spark.table(full).schema, 1):
            meta = f.metadata
            kind = meta.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
            facts = {"type": kind, "ordinal": str(i), "default": meta.get("CURRENT_DEFAULT"), "comment": meta.get("comment")}
            rows += [(name, f.name, a, v) for a, v in facts.items() if v is not None]
        rows += [(name, "", f"property {k}", v) for k, v in properties(spark, full).items() if k != "comment"]
        note = spark.catalog.getTable(full).description
        rows += [(name, "", "comment", note)] if note else []
    return spark.createDataFrame(rows, SCHEMA)


def catalog_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``table``, ``column``, ``attribute``, ``a_value`` and ``b_value`` wherever two catalogs differ or only one has an entry."""
    x, y = (c.withColumnRenamed("value", f"{side}_value") for c, side in ((a, "a"), (b, "b")))
    both = x.join(y, ["table", "column", "attribute"], "full_outer")
    return both.filter(~F.col("a_value").eqNullSafe(F.col("b_value")))


def spec_properties(columns) -> dict[str, str]:
    """The marks of a table's columns as properties."""
    found = {}
    for column, c in columns.items():
        marks = (("pk", c.pk), ("fk", c.fk), ("unique", c.unique), ("check_values", ",".join(c.check_values)), ("check_min", c.check_min), ("check_max", c.check_max), ("generated", c.generated))
        found |= {f"{kind}.{column}": str(value) for kind, value in marks if value not in (None, False, "")}
    return found


def create_tables(spark: SparkSession, spec, database: str, order: list[str], fmt: str = "parquet") -> None:
    """Empty tables of a spec with types, defaults and comments; keys, checks and generated columns as properties, which file tables can't enforce."""
    for name in order:
        columns = []
        for column, c in spec.tables[name].items():
            kind = f"varchar({c.length()})" if c.length() else c.spark_type().simpleString()
            columns.append(f"`{column}` {kind}" + (f" DEFAULT {c.default}" if c.default is not None else "") + (f" COMMENT {quoted(c.comment)}" if c.comment else ""))
        marks = spec_properties(spec.tables[name])
        listed = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in sorted(marks.items()))
        note = spec.comments.get(name)
        spark.sql(f"CREATE TABLE {database}.{name} ({', '.join(columns)}) USING {fmt}" + (f" COMMENT {quoted(note)}" if note else "") + (f" TBLPROPERTIES ({listed})" if marks else ""))


def insert_rows(df: DataFrame, table: str) -> None:
    """Append rows to a stored table by column name: what is left out takes the column's default, and generated columns are computed from their expressions."""
    spark = df.sparkSession
    made = {k.removeprefix("generated."): v for k, v in properties(spark, table).items() if k.startswith("generated.")}
    schema = spark.table(table).schema
    out = df
    for f in schema:
        if f.name not in out.columns and f.name not in made:
            out = out.withColumn(f.name, F.expr(f.metadata.get("CURRENT_DEFAULT", "NULL")).cast(f.dataType))
    for column, expression in made.items():
        out = out.withColumn(column, F.expr(expression).cast(schema[column].dataType))
    out.select(*schema.names).write.insertInto(table)
