"""Queries on generator assignment and on what texts of checks and types state. The expected SQL is written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.operators import assign, profile
from tablesmith.plans.queries import one, query

COLUMNS = [
    "email", "contact_email", "full_name", "firstname", "mobile", "city", "home_url", "birth_day", "created_at", "job_title", "title", "notes",
    "total", "my_uuid_ref", "stars", "age", "qty", "discount", "ip", "colour", "lat", "lon", "plain", "Score", "company", "job", "state",
]
#: Type name and exact type, apart by "|".
PGX_TYPES = [
    "integer|integer", "bigint|bigint", "character varying|character varying(40)", "text|text", "boolean|boolean", "date|date", "numeric|numeric(10,2)",
    "numeric|numeric(4,0)", "decimal|decimal(2,2)", "numeric|numeric(2,4)", "numeric|numeric(4)", "numeric|numeric", "jsonb|jsonb", "uuid|uuid",
    "inet|inet", "macaddr|macaddr", "timestamp without time zone|timestamp without time zone", "double precision|double precision", "smallint|smallint",
    "money|money", "serial|serial", "interval|interval", "bytea|bytea", "time|time", "bpchar|character(3)", "datetime|datetime", "decimal|decimal(20,0)",
    "bigserial|bigserial", "smallmoney|smallmoney",
]
MYSQL_TYPES = [
    "tinyint|tinyint(1)", "bit|bit(1)", "bool|bool", "smallint|smallint", "int|int", "bigint|bigint", "float|float", "double|double",
    "decimal|decimal(3,2)", "decimal|decimal(5,2)", "decimal|decimal(4,1)", "decimal|decimal", "char|char(36)", "varchar|varchar(20)", "mediumtext|mediumtext",
    "date|date", "time|time", "datetime|datetime", "timestamp|timestamp", "year|year", "json|json", "blob|blob", "uuid|uuid", "timestamptz|timestamptz",
    "double precision|double precision", "dec|dec(4,2)", "mediumint|mediumint", "jsonb|jsonb", "fixed|fixed(4,2)",
]

BY_NAME = """CASE WHEN c = 'email' OR suffix(c, '_email') THEN 'email' WHEN c IN ('full_name', 'person_name') THEN 'name' WHEN c IN ('first_name', 'firstname') THEN 'firstname'
WHEN c IN ('last_name', 'lastname') THEN 'lastname' WHEN c IN ('username', 'user_name') THEN 'username' WHEN c IN ('phone', 'phone_number', 'mobile') THEN 'phone'
WHEN c IN ('address', 'street_address') THEN 'street' WHEN c = 'city' THEN 'city' WHEN c = 'country' THEN 'country' WHEN c IN ('zip', 'zip_code', 'postal_code') THEN 'zip'
WHEN c IN ('state', 'province') THEN 'state' WHEN c IN ('url', 'website') OR suffix(c, '_url') THEN 'url' WHEN c IN ('date', 'day') OR suffix(c, '_date') OR suffix(c, '_day') THEN 'date'
WHEN c = 'time' OR suffix(c, '_time') THEN 'time' WHEN c IN ('datetime', 'timestamp') OR suffix(c, '_at') THEN 'datetime' WHEN c = 'title' OR suffix(c, '_title') THEN 'sentence'
WHEN c IN ('description', 'bio', 'summary', 'notes') THEN 'paragraph(2)' WHEN c IN ('price', 'amount', 'cost', 'total', 'balance') THEN 'price(1,1000)' WHEN contains(c, 'uuid') THEN 'uuid'
WHEN c IN ('rating', 'score', 'stars') THEN 'number(1,5)' WHEN c = 'age' THEN 'number(18,90)' WHEN c IN ('quantity', 'qty', 'stock', 'count') THEN 'number(1,500)'
WHEN c IN ('percentage', 'percent', 'discount') THEN 'number(0,100)' WHEN c IN ('ip', 'ip_address') THEN 'ipv4' WHEN c IN ('color', 'colour') THEN 'hexcolor'
WHEN c IN ('company', 'company_name') THEN 'company' WHEN c IN ('job', 'job_title', 'position') THEN 'jobtitle' WHEN c IN ('latitude', 'lat') THEN 'latitude' WHEN c IN ('longitude', 'lng', 'lon') THEN 'longitude' END"""
PGX_STRICT = "CASE WHEN t = 'boolean' THEN 'bool' WHEN t = 'date' THEN 'date' WHEN t = 'time' THEN 'time' WHEN t = 'timestamp without time zone' THEN 'datetime' WHEN t = 'jsonb' THEN 'json' WHEN t = 'uuid' THEN 'uuid' END"
PGX_FIXED = "CASE d WHEN 'numeric(10,2)' THEN 'price(1,1000)' WHEN 'numeric(4,0)' THEN 'number(1,9999)' WHEN 'decimal(2,2)' THEN 'price(0,0.99)' WHEN 'decimal(20,0)' THEN 'number(1,100000)' END"
PGX_TYPE = "CASE WHEN t = 'smallint' THEN 'number(1,1000)' WHEN t = 'integer' THEN 'number(1,10000)' WHEN t = 'bigint' THEN 'number(1,100000)' WHEN t IN ('serial', 'bigserial') THEN '' WHEN t = 'double precision' THEN 'float64' WHEN t IN ('numeric', 'decimal') THEN 'price(1,1000)' WHEN t = 'money' THEN 'price(1,10000)' WHEN t = 'text' THEN 'sentence' WHEN t = 'inet' THEN 'ipv4' WHEN t = 'macaddr' THEN 'macaddress' ELSE 'word' END"
PGX_UNIQUE = "CASE WHEN t IN ('character varying', 'text', 'uuid', 'bpchar') THEN 'uuid' WHEN t IN ('integer', 'bigint', 'smallint', 'numeric', 'decimal', 'double precision', 'money', 'smallmoney', 'serial', 'bigserial', 'date', 'time', 'datetime', 'timestamp without time zone') THEN 'sequence' END"
MYSQL_STRICT = "CASE WHEN t IN ('tinyint', 'bit', 'bool') THEN 'bool' WHEN t = 'date' THEN 'date' WHEN t = 'time' THEN 'time' WHEN t IN ('datetime', 'timestamp') THEN 'datetime' WHEN t = 'json' THEN 'json' END"
MYSQL_FIXED = "CASE d WHEN 'decimal(3,2)' THEN 'price(1,9)' WHEN 'decimal(5,2)' THEN 'price(1,999)' WHEN 'decimal(4,1)' THEN 'price(1,999)' END"
MYSQL_TYPE = "CASE WHEN t IN ('smallint', 'mediumint', 'int') THEN 'number(1,1000)' WHEN t = 'bigint' THEN 'number(1,100000)' WHEN t IN ('float', 'double') THEN 'float64' WHEN t = 'decimal' THEN 'price(1,1000)' WHEN t = 'mediumtext' THEN 'sentence' WHEN t = 'year' THEN 'number(2000,2025)' ELSE 'word' END"
MYSQL_UNIQUE = "CASE WHEN t IN ('char', 'varchar', 'mediumtext', 'uuid') THEN 'uuid' WHEN t IN ('tinyint', 'smallint', 'mediumint', 'int', 'bigint', 'float', 'double', 'double precision', 'decimal', 'dec', 'fixed', 'date', 'time', 'datetime', 'timestamp', 'timestamptz') THEN 'sequence' END"


def assigned_sql(types: list[str], unique: str, strict: str, fixed: str, typed: str) -> str:
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"""SELECT k AS p_partkey, CASE WHEN k % 31 = 0 THEN 'randomstring(' || p_brand || ',' || p_type || ')' WHEN k % 29 = 0 THEN '' WHEN k % 13 = 0 THEN 'randomstring(a,' || p_brand || ')'
WHEN k % 23 = 0 THEN 'number(' || p_size || ',' || k || ')' ELSE coalesce(CASE WHEN k % 2 = 0 THEN {unique} END, {strict}, {fixed}, {BY_NAME}, {typed}) END AS generator
FROM (SELECT *, split_part(x, '|', 1) AS t, split_part(x, '|', 2) AS d FROM (SELECT *, p_partkey AS k, lower(([{listed(COLUMNS)}])[p_partkey % {len(COLUMNS)} + 1]) AS c, ([{listed(types)}])[p_partkey % {len(types)} + 1] AS x FROM part))"""


def assigned(spark, sf_dir: str, types: list[str], dialect: str):
    """A catalog with one column for each part: its name and type by the key, its marks by divisors of the key."""
    key = F.col("p_partkey")
    both = F.split(G.pick(key, types), r"\|")
    catalog = one(spark, sf_dir, "part").select(
        "p_partkey", F.lit("t").alias("table"), G.pick(key, COLUMNS).alias("column"), both[0].alias("type"), both[1].alias("ddl_type"), F.lit(dialect).alias("dialect"), (key % 29 == 0).alias("pk"), (key % 2 == 0).alias("unique"),
        F.when(key % 31 == 0, F.array("p_brand", "p_type")).alias("enum_values"), F.when(key % 13 == 0, F.array(F.lit("a"), "p_brand")).alias("check_values"), F.when(key % 23 == 0, F.col("p_size").cast("long")).alias("check_min"), F.when(key % 23 == 0, key).alias("check_max"),
    )
    return assign.assign_generators(catalog).select("p_partkey", "generator")


@query(assigned_sql(PGX_TYPES, PGX_UNIQUE, PGX_STRICT, PGX_FIXED, PGX_TYPE))
def a_assign_generators(spark, sf_dir):
    return assigned(spark, sf_dir, PGX_TYPES, "pgx")


@query(assigned_sql(MYSQL_TYPES, MYSQL_UNIQUE, MYSQL_STRICT, MYSQL_FIXED, MYSQL_TYPE))
def a10_mysql_generators(spark, sf_dir):
    return assigned(spark, sf_dir, MYSQL_TYPES, "mysql")


@query("SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 3, 4) AS known FROM orders")
def a12_recognized_generators(spark, sf_dir):
    key = F.col("o_orderkey")
    n = key.cast("string")
    texts = [F.lit(" email "), F.concat(F.lit("number(1,"), n, F.lit(")")), F.concat(F.lit("randomstring(a ("), n, F.lit("),b)")), F.lit(""), F.lit("number(1)"), F.lit("nothing"), F.concat(F.lit("randomint("), n, F.lit(")")), F.lit("paragraph")]
    text = texts[-1]
    for i, t in enumerate(texts[:-1]):
        text = F.when(key % len(texts) == i, t).otherwise(text)
    return one(spark, sf_dir, "orders").select("o_orderkey", assign.recognized(text).alias("known"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 8 WHEN 1 THEN l_linenumber - 10 WHEN 2 THEN l_linenumber - 10 WHEN 6 THEN -5 END AS check_min, CASE l_linenumber % 8 WHEN 1 THEN l_orderkey WHEN 2 THEN l_orderkey WHEN 6 THEN 9 END AS check_max, CASE l_linenumber % 8 WHEN 0 THEN l_returnflag || ',' || l_linestatus WHEN 3 THEN l_linestatus || ',x y' WHEN 4 THEN l_returnflag || ',b' WHEN 5 THEN l_returnflag ELSE '' END AS check_values FROM lineitem")
def p9_check_clauses(spark, sf_dir):
    """One clause for each line: domains and ranges of both dialects, two clauses at once, bounds of two columns, bounds the wrong way round."""
    line, low = one(spark, sf_dir, "lineitem"), F.expr("cast(l_linenumber - 10 as string)")
    high, kind = F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 8
    text = [
        F.concat(F.lit("CHECK ((status)::text = ANY ((ARRAY['"), F.col("l_returnflag"), F.lit("'::character varying, '"), F.col("l_linestatus"), F.lit("'::character varying])::text[]))")),
        F.concat(F.lit("CHECK (((a >= "), low, F.lit(") AND (a <= "), high, F.lit(")))")),
        F.concat(F.lit("(`a` between "), low, F.lit(" and "), high, F.lit(")")),
        F.concat(F.lit("(`s` in (_utf8mb4'"), F.col("l_linestatus"), F.lit("\\',_utf8mb4'x y\\'))")),
        F.concat(F.lit("((status in ('"), F.col("l_returnflag"), F.lit("','b')) and (kind <> 'c'))")),
        F.concat(F.lit("CHECK ((s = ANY (ARRAY['"), F.col("l_returnflag"), F.lit("'::text])) AND (k <> 'z'::text) AND (q = ANY (ARRAY['y'::text])))")),
        F.lit("CHECK (((a <= 5) AND (b >= 7)) OR ((c >= -5) AND (c <= 9)))"),
        F.lit("CHECK (((a <= 5) AND (b >= 7) AND (price > 0)))"),
    ]
    clause = text[-1]
    for i, t in enumerate(text[:-1]):
        clause = F.when(kind == i, t).otherwise(clause)
    found = profile.parse_checks(line.select("l_orderkey", "l_linenumber", clause.alias("clause")))
    return found.select("l_orderkey", "l_linenumber", "check_min", "check_max", F.array_join("check_values", ",").alias("check_values"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|a b' WHEN 1 THEN p_type ELSE '' END AS listed FROM part")
def p7_enum_types(spark, sf_dir):
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, F.concat(F.lit("enum('"), F.col("p_brand"), F.lit("', 'a b','')"))).when(key % 3 == 1, F.concat(F.lit('SET("'), F.col("p_type"), F.lit('")'))).otherwise(F.lit("varchar(20)"))
    return one(spark, sf_dir, "part").select("p_partkey", F.array_join(profile.enum_type_values(kind), "|").alias("listed"))
