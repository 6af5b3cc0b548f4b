"""Schema specifications: tables, columns, keys and volumes, kept on the driver as plain metadata."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMBERS = {"smallint", "int2", "mediumint", "int", "integer", "int4", "bigint", "int8", "tinyint", "serial", "bigserial", "smallserial"}
INTEGER_KEYS = NUMBERS - {"tinyint"}
FRACTIONS = {"float", "double", "real", "float4", "float8", "double precision", "decimal", "numeric", "money"}
STRINGS = {"char", "varchar", "bpchar", "character varying", "character", "text", "tinytext", "mediumtext", "longtext", "uuid"}
TEMPORAL = {"date", "time", "datetime", "timestamp", "timestamptz", "time without time zone", "time with time zone", "timestamp without time zone", "timestamp with time zone"}


@dataclass
class ColumnSpec:
    """A column: its type name, exact type, generator, key marks and measured or declared limits."""

    type: str
    ddl_type: str = ""
    generator: str | None = None
    fk: str | None = None
    pk: bool = False
    nullable: bool = False
    unique: bool = False
    generated: str | bool | None = None
    enum_values: list[str] = field(default_factory=list)
    check_values: list[str] = field(default_factory=list)
    check_min: int | None = None
    check_max: int | None = None
    default: str | None = None
    comment: str | None = None

    @property
    def parent(self) -> tuple[str, str] | None:
        """The table and the column that ``fk`` names, split at the first dot."""
        table, dot, column = (self.fk or "").partition(".")
        return (table, column) if dot else None

    def spark_type(self) -> T.DataType:
        kind = self.type.lower()
        if kind in ("smallint", "int2"):
            return T.ShortType()
        if kind in ("bigint", "int8", "bigserial"):
            return T.LongType()
        if kind in ("bool", "boolean", "bit", "tinyint"):
            return T.BooleanType()
        if kind in NUMBERS or kind == "year":
            return T.IntegerType()
        if kind in ("decimal", "numeric"):
            precision, scale = self.precision()
            return T.DecimalType(precision, scale)
        if kind == "money":
            return T.DecimalType(19, 2)
        if kind in FRACTIONS:
            return T.DoubleType()
        if kind == "date":
            return T.DateType()
        if kind in TEMPORAL and not kind.startswith("time ") and kind != "time":
            return T.TimestampType() if kind.endswith("tz") or kind.endswith("with time zone") else T.TimestampNTZType()
        if kind in ("bytea", "blob"):
            return T.BinaryType()
        return T.StringType()

    def precision(self) -> tuple[int, int]:
        inner = (self.ddl_type or self.type).partition("(")[2].rstrip(") ")
        numbers = [int(x) for x in inner.split(",") if x.strip().isdigit()]
        return (numbers + [0])[0] if numbers else 38, numbers[1] if len(numbers) > 1 else (0 if numbers else 10)

    def length(self) -> int | None:
        """The declared length of a character type, of the exact type before the type name."""
        for text in (self.ddl_type, self.type):
            name, _, inner = text.lower().partition("(")
            if name.strip() in ("varchar", "char", "character varying", "character") and inner.rstrip(") ").isdigit():
                return int(inner.rstrip(") "))
        return None


@dataclass
class SchemaSpec:
    tables: dict[str, dict[str, ColumnSpec]]
    comments: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(spec: dict | str) -> SchemaSpec:
        """From nested dicts, or the same as JSON."""
        spec = json.loads(spec) if isinstance(spec, str) else spec
        return SchemaSpec({t: {c: v if isinstance(v, ColumnSpec) else ColumnSpec(**v) for c, v in columns.items()} for t, columns in spec.items()})

    def json(self) -> str:
        return json.dumps({t: {c: asdict(v) for c, v in columns.items()} for t, columns in self.tables.items()}, indent=1)

    def keys(self, table: str) -> list[str]:
        return sorted(c for c, v in self.tables[table].items() if v.pk)

    def edges(self, spark: SparkSession) -> DataFrame:
        """One row for each foreign key column: child, column, parent, ref_column, nullable."""
        rows = [(t, c, *v.parent, v.nullable) for t, columns in sorted(self.tables.items()) for c, v in sorted(columns.items()) if v.parent]
        return spark.createDataFrame(rows, "child string, column string, parent string, ref_column string, nullable boolean")
