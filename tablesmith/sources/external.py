"""Tables of an external database, each read by many tasks.

A key column is cut at its quantiles, so that skewed keys give even ranges too: the smallest and the largest key come from the database, the key
alone is read in ranges of equal width, and its quantiles become one condition per task. Only columns that a query uses are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.sources.sinks import quote_name

#: Accuracy of the quantiles: ranges differ by about one part in so many.
ACCURACY = 10_000


def key_ranges(cuts: list, column: str) -> list[str]:
    """A condition for each range between sorted cut points; rows without a key belong to the first."""
    marks = [f"'{c}'" if not isinstance(c, (int, float)) and not hasattr(c, "as_tuple") else str(c) for c in dict.fromkeys(cuts)]
    if not marks:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(marks, marks[1:], strict=False)]
    return [f"{column} < {marks[0]} OR {column} IS NULL", *inner, f"{column} >= {marks[-1]}"]


def _options(df_reader, url: str, options: dict[str, str]):
    return df_reader.format("jdbc").options(url=url, **options)


def plan_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, dialect: str = "ansi", **options: str) -> list[str]:
    """Conditions that deal a table's rows evenly to ``parts`` tasks by a key that is a number, a date or an instant."""
    whole, name = _options(spark.read, url, options).option("dbtable", table), quote_name(key, dialect)
    if not isinstance(whole.load().schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{table}.{key} is no number, date or instant: give the conditions yourself")
    low, high = _options(spark.read, url, options).option("dbtable", f"(SELECT min({name}) AS low, max({name}) AS high FROM {table}) ends").load().first()
    if low is None or low == high:
        return ["1 = 1"]
    wide = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    keys = _options(spark.read, url, options).options(dbtable=table, **wide).load().select(F.col(key).alias("key")).filter("key IS NOT NULL")
    cuts = keys.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], ACCURACY)).first()[0]
    return key_ranges([c for c in sorted(set(cuts)) if c > low], name)


def load_split(spark: SparkSession, url: str, keys: dict[str, str | list[str]], parts: int = 8, dialect: str = "ansi", **options: str) -> dict[str, DataFrame]:
    """Named tables, each with the key column to split it by or with the conditions of its tasks."""
    found = {}
    for table, key in keys.items():
        ranges = key if isinstance(key, list) else plan_ranges(spark, url, table, key, parts, dialect, **options)
        found[table] = spark.read.jdbc(url, table, predicates=ranges, properties=options)
    return found
