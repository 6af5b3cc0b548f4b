"""Assign a generator to each column of a catalog: one chain of conditions, the first that holds wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.generators import BARE, CALLED

#: Type names by what they hold.
INTS = ["smallint", "int2", "mediumint", "int", "integer", "int4", "bigint", "int8", "tinyint"]
DECIMALS = ["decimal", "numeric"]
FLOATS = ["float", "double", "real", "float4", "float8", "double precision"]
SEQUENCES = ["money", "smallmoney", "dec", "fixed", "serial", "bigserial", "smallserial"]
DATES = ["date"]
TIMES = ["time", "time without time zone", "time with time zone"]
INSTANTS = ["datetime", "timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone"]
BOOLS = ["bool", "boolean"]
#: Types that come before the column's name, by dialect.
STRICT = {"mysql": BOOLS + ["bit", "tinyint", "date", "time", "datetime", "timestamp", "json"], "pgx": BOOLS + DATES + TIMES + INSTANTS[1:] + ["json", "jsonb", "uuid"]}
#: Fixed values: (exact names, suffixes, generator), in order of precedence.
NAMES = [
    (["email"], ["_email"], "email"),
    (["full_name", "person_name"], [], "name"),
    (["first_name", "firstname"], [], "firstname"),
    (["last_name", "lastname"], [], "lastname"),
    (["username", "user_name"], [], "username"),
    (["phone", "phone_number", "mobile"], [], "phone"),
    (["address", "street_address"], [], "street"),
    (["city"], [], "city"),
    (["country"], [], "country"),
    (["zip", "zip_code", "postal_code"], [], "zip"),
    (["state", "province"], [], "state"),
    (["url", "website"], ["_url"], "url"),
    (["date", "day"], ["_date", "_day"], "date"),
    (["time"], ["_time"], "time"),
    (["datetime", "timestamp", "created_at", "updated_at"], ["_at"], "datetime"),
    (["title"], ["_title"], "sentence"),
    (["description", "bio", "summary", "notes"], [], "paragraph(2)"),
    (["price", "amount", "cost", "total", "balance"], [], "price(1,1000)"),
    ("uuid", None, "uuid"),
    (["rating", "score", "stars"], [], "number(1,5)"),
    (["age"], [], "number(18,90)"),
    (["quantity", "qty", "stock", "count"], [], "number(1,500)"),
    (["percentage", "percent", "discount"], [], "number(0,100)"),
    (["ip", "ip_address"], [], "ipv4"),
    (["color", "colour"], [], "hexcolor"),
    (["company", "company_name"], [], "company"),
    (["job", "job_title", "position"], [], "jobtitle"),
    (["latitude", "lat"], [], "latitude"),
    (["longitude", "lng", "lon"], [], "longitude"),
]
#: Defaults by type name for the two dialects.
MYSQL = [
    (BOOLS + ["tinyint", "bit"], "bool"),
    (["smallint", "mediumint", "int", "integer"], "number(1,1000)"),
    (["bigint"], "number(1,100000)"),
    (["float", "double", "real"], "float64"),
    (DECIMALS, "price(1,1000)"),
    (["char", "varchar"], "word"),
    (["text", "tinytext", "mediumtext", "longtext"], "sentence"),
    (DATES, "date"),
    (["time"], "time"),
    (["datetime", "timestamp"], "datetime"),
    (["year"], "number(2000,2025)"),
    (["json"], "json"),
]
POSTGRES = [
    (BOOLS, "bool"),
    (["smallint", "int2"], "number(1,1000)"),
    (["int", "integer", "int4"], "number(1,10000)"),
    (["bigint", "int8"], "number(1,100000)"),
    (["serial", "bigserial", "smallserial"], ""),
    (["real", "float4", "float8", "double precision"], "float64"),
    (DECIMALS, "price(1,1000)"),
    (["money"], "price(1,10000)"),
    (["char", "varchar", "bpchar", "character varying", "character"], "word"),
    (["text"], "sentence"),
    (["uuid"], "uuid"),
    (DATES, "date"),
    (TIMES, "time"),
    (INSTANTS[1:], "datetime"),
    (["json", "jsonb"], "json"),
    (["inet", "cidr"], "ipv4"),
    (["macaddr"], "macaddress"),
]


def _listed(values: Column) -> Column:
    return F.concat(F.lit("randomstring("), F.array_join(values, ","), F.lit(")"))


def _by_type(kind: Column, table: list) -> Column:
    return reduce(lambda done, row: F.when(kind.isin(*row[0]), F.lit(row[1])).otherwise(done), reversed(table), F.lit("word"))


def by_name(name: Column) -> Column:
    """The generator that a column's name suggests, or null."""
    out = F.lit(None).cast("string")
    for names, suffixes, generator in reversed(NAMES):
        hit = name.contains(names) if suffixes is None else reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes], name.isin(*names))
        out = F.when(hit, F.lit(generator)).otherwise(out)
    return out


def _fixed_point(kind: Column, ddl: Column) -> Column:
    """The bounds that precision and scale set, for types exactly decimal or numeric."""
    exact = F.trim(F.lower(ddl))
    pattern = r"^(?:decimal|numeric|dec|fixed)\((\d+),\s*(\d+)\)$"
    precision, scale = (F.regexp_extract(exact, pattern, i).try_cast("int") for i in (1, 2))
    most = lambda digits, cap: F.when(digits > 9, F.lit(cap)).otherwise(F.least(F.pow(F.lit(10), digits).cast("long") - 1, F.lit(cap)))
    whole = F.concat(F.lit("number(1,"), F.greatest(most(precision, 100_000), F.lit(1)).cast("string"), F.lit(")"))
    part = F.when(precision == scale, F.lit("price(0,0.99)")).otherwise(F.concat(F.lit("price(1,"), most(precision - scale, 1_000).cast("string"), F.lit(")")))
    return F.when(kind.isin(*DECIMALS) & (precision > 0) & (scale <= precision), F.when(scale == 0, whole).otherwise(part))


def assign_generators(catalog: DataFrame, overrides: dict[tuple[str, str], str] | None = None, default_dialect: str = "pgx") -> DataFrame:
    """``catalog`` (table, column, type; as far as present also ddl_type, dialect, pk, unique, enum_values, check_values, check_min, check_max) with ``generator``."""
    blank = {"ddl_type": "string", "dialect": "string", "pk": "boolean", "unique": "boolean", "enum_values": "array<string>", "check_values": "array<string>", "check_min": "long", "check_max": "long"}
    full = catalog.select("*", *[F.lit(None).cast(k).alias(c) for c, k in blank.items() if c not in catalog.columns])
    kind, name = F.lower("type"), F.lower("column")
    full = full.withColumn("_ddl", F.coalesce("ddl_type", "type"))
    listed = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = F.regexp_replace(kind, r"\s*\(.*", "")
    dialect = F.coalesce("dialect", F.lit(default_dialect))
    typed = F.when(dialect == "mysql", _by_type(base, MYSQL)).otherwise(_by_type(base, POSTGRES))
    strict = F.when(reduce(lambda a, b: a | b, [(dialect == d) & base.isin(*kinds) for d, kinds in STRICT.items()]), typed)
    text = base.contains("char") | base.contains("text") | base.isin("clob", "uuid")
    temporal = base.contains("date") | base.contains("time")
    rule = (
        F.when(listed("enum_values"), _listed(F.col("enum_values")))
        .when(yes("pk"), F.lit(""))
        .when(listed("check_values"), _listed(F.col("check_values")))
        .when(F.col("check_min").isNotNull() & F.col("check_max").isNotNull(), F.concat(F.lit("number("), F.col("check_min").cast("string"), F.lit(","), F.col("check_max").cast("string"), F.lit(")")))
        .when(yes("unique") & text, F.lit("uuid"))
        .when(yes("unique") & (base.isin(*INTS, *DECIMALS, *FLOATS, *SEQUENCES) | temporal), F.lit("sequence"))
    )
    out = F.coalesce(rule, strict, _fixed_point(base, F.col("_ddl")), by_name(name), typed)
    for (table, column), generator in (overrides or {}).items():
        out = F.when((F.col("table") == table) & (F.col("column") == column), F.lit(generator)).otherwise(out)
    return full.withColumn("generator", out).select(*catalog.columns, "generator")


def recognized(generator: Column) -> Column:
    """Whether a generator string is recognized: empty, a bare name, or a call of one that takes arguments."""
    return F.trim(generator).rlike(rf"(?s)^(|{'|'.join(BARE)}|({'|'.join(CALLED)})\(.*\))$")
