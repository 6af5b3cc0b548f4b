"""Queries on discovery from data: columns, keys, references, preloaded keys, structure."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import checks, depgraph, gaps, inclusions, keys, profile
from tablesmith.plans.queries import CORE, load, one, query, shared_folder
from tablesmith.sources import sinks
from tablesmith.sources import tables as src
from tablesmith.spec import SchemaSpec

INT, LONG, TEXT, DOUBLE, TIME = "int", "bigint", "string", "double", "timestamp_ntz"
COLUMNS = {
    "region": {"r_regionkey": INT, "r_name": TEXT},
    "nation": {"n_nationkey": INT, "n_name": TEXT, "n_regionkey": INT},
    "customer": {"c_custkey": LONG, "c_name": TEXT, "c_nationkey": INT, "c_acctbal": DOUBLE, "c_mktsegment": TEXT},
    "supplier": {"s_suppkey": LONG, "s_name": TEXT, "s_nationkey": INT, "s_acctbal": DOUBLE},
    "part": {"p_partkey": LONG, "p_name": TEXT, "p_brand": TEXT, "p_type": TEXT, "p_size": INT, "p_retailprice": DOUBLE},
    "orders": {"o_orderkey": LONG, "o_custkey": LONG, "o_orderstatus": TEXT, "o_totalprice": DOUBLE, "o_orderdate": TIME, "o_orderpriority": TEXT},
}


def catalog_sql(tables: dict[str, dict[str, str]]) -> str:
    """The catalog as the tables' files are known to be, with nulls and uniqueness counted."""
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS ordinal, '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(*) = count(DISTINCT {c}) AS is_unique FROM {t}" for t, columns in tables.items() for i, (c, kind) in enumerate(columns.items(), 1))


@query(catalog_sql(COLUMNS))
def p1_o10_column_catalog(spark, sf_dir):
    """Columns, places and types from the schemas, joined to what the data say of them."""
    tables = load(spark, sf_dir, *COLUMNS)
    known = reduce(DataFrame.unionByName, [profile.columns_of(df, t) for t, df in tables.items()])
    facts = reduce(DataFrame.unionByName, [profile.profile_table(df, t) for t, df in tables.items()])
    return known.join(facts.select("table", "column", "rows", "nulls", "is_unique"), ["table", "column"])


def keys_sql(tables: dict[str, dict[str, str]], most: int) -> str:
    """Every smallest set of up to two columns whose values are unique."""
    full = lambda c: f"count({c}) = count(*) AND count(DISTINCT {c}) = count(*)"
    parts = []
    for t, columns in tables.items():
        parts += [f"SELECT '{t}' AS \"table\", '{c}' AS key, 1 AS n_columns, {most} AS searched FROM {t} HAVING {full(c)} AND count(*) > 0" for c in columns]
        parts += [f"SELECT '{t}', '{a},{b}', 2, {most} FROM {t} HAVING count(*) > 0 AND count({a}) = count(*) AND count({b}) = count(*) AND NOT ({full(a)}) AND NOT ({full(b)}) AND count(DISTINCT ({a}, {b})) = count(*)" for a, b in combinations(sorted(columns), 2)] if most > 1 else []
    return " UNION ALL ".join(parts)


CONVERSATIONS = {"conv_id": LONG, "turn": LONG, "role": TEXT, "text": TEXT}


@query(keys_sql({"conversations": CONVERSATIONS, "nation": COLUMNS["nation"], "orders": COLUMNS["orders"], "part": COLUMNS["part"]}, 2))
def p3_key_candidates(spark, sf_dir):
    return keys.key_table(load(spark, sf_dir, "conversations", "nation", "orders", "part"), 2)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\" FROM {t} HAVING count(DISTINCT {c}) = count(*) AND count(*) > 0" for t, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")) for c in COLUMNS[t] if c != key))
def p4_unique_columns(spark, sf_dir):
    primary = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    rows = [(t, c) for t, df in load(spark, sf_dir, *primary).items() for c in keys.unique_columns(df, (primary[t],))]
    return spark.createDataFrame(rows, "table string, column string")


def inclusions_sql(tables: dict[str, dict[str, str]]) -> str:
    """Coverage of every pair of a column and a unique column of another table that agree in kind and of which one's range holds the other's."""
    kind = {LONG: "number", INT: "number", TEXT: "text"}
    parts = []
    for t, columns in tables.items():
        for u, others in tables.items():
            for c, a in columns.items():
                for d, b in others.items():
                    if t != u and kind.get(a) and kind.get(a) == kind.get(b):
                        parts.append(f"SELECT '{t}' AS child, '{c}' AS \"column\", '{u}' AS parent, '{d}' AS ref_column, CAST(count(DISTINCT {c}) FILTER ({c} IN (SELECT {d} FROM {u})) AS DOUBLE) / count(DISTINCT {c}) AS coverage FROM {t} HAVING min({c}) >= (SELECT min({d}) FROM {u}) AND max({c}) <= (SELECT max({d}) FROM {u}) AND (SELECT count(DISTINCT {d}) = count(*) FROM {u})")
    return " UNION ALL ".join(parts)


@query(inclusions_sql({t: COLUMNS[t] for t in ("region", "nation", "supplier", "customer")}))
def p5_inclusions_whatever_the_names(spark, sf_dir):
    return inclusions.foreign_keys(load(spark, sf_dir, "region", "nation", "supplier", "customer")).select("child", "column", "parent", "ref_column", "coverage")


def core_spec() -> SchemaSpec:
    big, key = {"type": "bigint"}, {"type": "bigint", "pk": True}
    return SchemaSpec.of({"orders": {"o_orderkey": key}, "part": {"p_partkey": key}, "supplier": {"s_suppkey": key}, "customer": {"c_custkey": key}, "lineitem": {"l_orderkey": big | {"fk": "orders.o_orderkey"}, "l_partkey": big | {"fk": "part.p_partkey"}, "l_suppkey": big | {"fk": "supplier.s_suppkey"}}})


@query("SELECT 'orders.o_orderkey' AS parent, o_orderkey AS key FROM orders UNION ALL SELECT 'part.p_partkey', p_partkey FROM part UNION ALL SELECT 'supplier.s_suppkey', s_suppkey FROM supplier")
def s3_preloaded_keys(spark, sf_dir):
    """The keys that lineitem refers to; customer, which it does not, is not read."""
    found = src.preload_keys(load(spark, sf_dir, *CORE), core_spec(), ["lineitem"])
    return reduce(DataFrame.unionByName, [df.select(F.lit(f"{t}.{c}").alias("parent"), "key") for (t, c), df in found.items()])


@query("SELECT * FROM (VALUES ('orders', 'o_clerk', NULL, 'string', NULL, 3), ('orders', 'o_custkey', 'bigint', 'int', 2, 2)) AS d(\"table\", \"column\", a_type, b_type, a_ordinal, b_ordinal), (SELECT count(*) AS a_rows, count(*) FILTER (o_custkey % 2 = 0) AS b_rows FROM orders)")
def v16_structure_differences(spark, sf_dir):
    """Orders against a copy of half of them that was written with another type and a further column."""
    orders, base = one(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), shared_folder(spark)
    other = orders.filter("o_custkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), F.lit("x").alias("o_clerk"))
    sinks.write_tables({"orders": other}, ["orders"], base)
    sides = {"a": {"orders": orders}, "b": src.load_tables(spark, base, ["orders"])}
    found = checks.structure_differences(*[depgraph.column_catalog(t) for t in sides.values()])
    for side, t in sides.items():
        found = found.join(src.row_counts(t).withColumnRenamed("n", f"{side}_rows"), "table")
    return found


@query("SELECT 'customer' AS \"table\", count(*) AS n, arg_min(to_json({'c_custkey': c_custkey, 'c_name': c_name}), c_custkey) AS sample FROM customer UNION ALL SELECT 'nation', count(*), arg_min(to_json({'n_nationkey': n_nationkey, 'n_name': n_name}), n_nationkey) FROM nation")
def r8_dry_run(spark, sf_dir):
    t = load(spark, sf_dir, "customer", "nation")
    return gaps.dry_run({"customer": t["customer"].select("c_custkey", "c_name"), "nation": t["nation"].select("n_nationkey", "n_name")}, {"customer": "c_custkey", "nation": "n_nationkey"})


def stored(spark, sf_dir: str, *names: str) -> str:
    """A new database that holds the given tables, below the shared folder."""
    folder = shared_folder(spark)
    name = "tables_" + folder.rsplit("-", 1)[-1][:12]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    sinks.write_tables(load(spark, sf_dir, *names), list(names), name, "table")
    return name


@query("SELECT \"table\", n AS before, CASE WHEN \"table\" = 'region' THEN n ELSE 0 END AS after, place FROM (SELECT 'region' AS \"table\", count(*) AS n, CAST(NULL AS INT) AS place FROM region UNION ALL SELECT 'nation', count(*), 2 FROM nation UNION ALL SELECT 'customer', count(*), 1 FROM customer)")
def k5_k6_truncated_tables(spark, sf_dir):
    """Customers and nations are emptied, children first, and nothing is made; regions stay."""
    names = ["region", "nation", "customer"]
    database = stored(spark, sf_dir, *names)
    counts = src.row_counts(load(spark, sf_dir, *names)).withColumnRenamed("n", "before")
    told: list[str] = []
    sinks.truncate_tables(spark, ["nation", "customer"], database, told.append)
    after = src.row_counts(src.load_tables(spark, database, names, "table")).withColumnRenamed("n", "after")
    places = spark.createDataFrame([(t, i) for i, t in enumerate(told, 1)], "table string, place int")
    return counts.join(after, "table").join(places, "table", "left")


@query("SELECT \"table\", n AS source_rows, CAST(0 AS BIGINT) AS clone_rows, CAST(0 AS BIGINT) AS differences, refused FROM (SELECT 'region' AS \"table\", count(*) AS n, true AS refused FROM region UNION ALL SELECT 'nation', count(*), true FROM nation)")
def k7_cloned_structure(spark, sf_dir):
    """The clone has the same columns and no rows; a second clone over it is refused unless told to drop."""
    names = ["region", "nation"]
    source = stored(spark, sf_dir, *names)
    target = f"{source}_clone"
    spark.sql(f"CREATE DATABASE {target} LOCATION '{shared_folder(spark)}'")
    sinks.clone_structure(spark, source, target, names)
    try:
        sinks.clone_structure(spark, source, target, names)
        refused = False
    except ValueError:
        refused = True
    sinks.clone_structure(spark, source, target, names, drop=True)
    held, made = (src.load_tables(spark, d, names, "table") for d in (source, target))
    differ = checks.structure_differences(depgraph.column_catalog(held), depgraph.column_catalog(made)).groupBy("table").agg(F.count("*").alias("differences"))
    counts = src.row_counts(held).withColumnRenamed("n", "source_rows").join(src.row_counts(made).withColumnRenamed("n", "clone_rows"), "table")
    return counts.join(differ, "table", "left").select("table", "source_rows", "clone_rows", F.coalesce("differences", F.lit(0)).alias("differences"), F.lit(refused).alias("refused"))
