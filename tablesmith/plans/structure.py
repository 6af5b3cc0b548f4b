"""Queries on wide keys, on profiles kept by part, and on the structure of stored tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablesmith.operators import keys, sketches
from tablesmith.plans.queries import one, query, shared_folder
from tablesmith.sources import catalog, sinks
from tablesmith.sources.tables import dense_index
from tablesmith.spec import SchemaSpec

#: The number of an order, written with five digits of a base that just suffices, and the sum of two of them.
DIGIT_COLUMNS = ["a", "b", "c", "d", "e", "o_orderstatus", "s"]
DIGITS_SQL = "SELECT k % r AS a, k // r % r AS b, k // (r * r) % r AS c, k // (r * r * r) % r AS d, k // (r * r * r * r) AS e, o_orderstatus, (k % r + k // r % r) % r AS s FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, CAST(ceil(pow(count(*) OVER (), 0.2)) AS BIGINT) AS r, o_orderstatus FROM orders)"


def wide_keys_sql() -> str:
    """Every set of columns counted, and those kept that are unique while no smaller one within is."""
    sets = [s for k in range(1, len(DIGIT_COLUMNS) + 1) for s in combinations(DIGIT_COLUMNS, k)]
    name = {s: f"u{i}" for i, s in enumerate(sets)}
    counted = ", ".join(f"count(DISTINCT ({', '.join(s)},)) = count(*) AS {n}" if len(s) > 1 else f"count(DISTINCT {s[0]}) = count(*) AS {n}" for s, n in name.items()).replace(",))", "))")
    parts = [f"SELECT 'orders' AS \"table\", '{','.join(s)}' AS key, {len(s)} AS n_columns, {len(DIGIT_COLUMNS)} AS searched FROM c WHERE {n}{''.join(f' AND NOT {m}' for t, m in name.items() if set(t) < set(s))}" for s, n in name.items()]
    return f"WITH t AS ({DIGITS_SQL}), c AS (SELECT {counted} FROM t) {' UNION ALL '.join(parts)}"


@query(wide_keys_sql())
def p3_keys_of_five_columns(spark, sf_dir):
    """Keys of five columns among seven, found without a bound on their width."""
    orders = one(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    n, k = orders.count(), F.col("idx")
    r = next(r for r in range(1, n + 2) if r**5 >= n)
    digit = lambda i: (F.floor(k / r**i) % r).cast("long")
    index = dense_index(orders.select(F.col("o_orderkey").alias("key"))).withColumnRenamed("key", "o_orderkey")
    named = [digit(i).alias(c) for i, c in enumerate("abcd")] + [F.floor(k / r**4).cast("long").alias("e"), "o_orderstatus", ((digit(0) + digit(1)) % r).alias("s")]
    return keys.key_table({"orders": orders.join(index, "o_orderkey").select(*named)})


ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
FLAGS = "count(DISTINCT {c}) = count(*) AS is_unique, count(DISTINCT {c}) BETWEEN 1 AND 12 AS is_enum"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, CASE WHEN count(DISTINCT {c}) = count(*) OR count(DISTINCT {c}) <= 12 THEN count(DISTINCT {c}) END AS distinct_values, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, max(length(CAST({c} AS VARCHAR))) AS longest, {FLAGS.format(c=c)} FROM orders" for c, kind in ORDERS.items()))
def p2_profile_of_a_growing_table(spark, sf_dir):
    """Orders of two thirds are sketched by part and kept; then the rest is, which alone is read, and the entries are added up."""
    orders = one(spark, sf_dir, "orders").select(*ORDERS, (F.col("o_orderkey") % 6).alias("part"))
    folder = shared_folder(spark)
    sketches.sketch_parts(orders.filter("part < 4"), "orders", "part").write.parquet(folder)
    known = spark.read.parquet(folder)
    sketches.sketch_parts(sketches.new_parts(orders, "part", known), "orders", "part").write.mode("append").parquet(folder)
    found = sketches.profile_from(spark.read.parquet(folder), orders)
    return found.select("column", "type", "rows", "nulls", F.when(F.col("is_unique") | F.col("is_enum"), F.col("distinct_values")).alias("distinct_values"), "low", "high", "longest", "is_unique", "is_enum")


def account_spec() -> SchemaSpec:
    columns = {
        "id": {"type": "bigint", "pk": True, "comment": "the order's number"}, "state": {"type": "varchar", "ddl_type": "varchar(20)", "default": "'it''s open'", "check_values": ["it's open", "closed"], "comment": "what became of it"},
        "net": {"type": "numeric", "ddl_type": "numeric(12,2)", "default": "0.00"}, "tax": {"type": "numeric", "ddl_type": "numeric(12,2)"}, "total": {"type": "numeric", "ddl_type": "numeric(13,2)", "generated": "net + tax"}, "customer_id": {"type": "bigint", "fk": "customer.id"},
    }
    return SchemaSpec(SchemaSpec.of({"account": columns}).tables, {"account": "one row for each order"})


@query("""SELECT step, 'account' AS "table", d.column, d.attribute, d.a_value, d.b_value, n AS rows, n AS right_totals, n AS defaults FROM (VALUES ('after', 'state', 'default', '''it''''s open''', '''closed'''), ('after', '', 'property fk.customer_id', 'customer.id', 'client.id'), ('after', 'net', 'comment', NULL, 'before tax')) AS d(step, "column", attribute, a_value, b_value), (SELECT count(*) AS n FROM orders)""")
def v16_catalog_differences(spark, sf_dir):
    """A clone with defaults, comments, checks and a generated column has the same catalog; then a default, a comment and a property are changed."""
    folder = shared_folder(spark)
    source = "catalog_" + folder.rsplit("-", 1)[-1][:12]
    target = f"{source}_clone"
    for name in (source, target):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}/{name}'")
    catalog.create_tables(spark, account_spec(), source, ["account"])
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(12,0)")
    rows = one(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (cents / 100).cast("decimal(12,2)").alias("net"), F.lit("1.50").cast("decimal(12,2)").alias("tax"), F.col("o_custkey").alias("customer_id"))
    catalog.insert_rows(rows, f"{source}.account")
    sinks.clone_structure(spark, source, target, ["account"])
    before = catalog.catalog_differences(*[catalog.catalog_rows(spark, d, ["account"]) for d in (source, target)]).withColumn("step", F.lit("before"))
    spark.sql(f"ALTER TABLE {target}.account ALTER COLUMN state SET DEFAULT 'closed'")
    spark.sql(f"ALTER TABLE {target}.account ALTER COLUMN net COMMENT 'before tax'")
    spark.sql(f"ALTER TABLE {target}.account SET TBLPROPERTIES ('fk.customer_id' = 'client.id')")
    after = catalog.catalog_differences(*[catalog.catalog_rows(spark, d, ["account"]) for d in (source, target)]).withColumn("step", F.lit("after"))
    held = spark.table(f"{source}.account").agg(F.count("*").alias("rows"), F.count_if(F.col("total") == F.col("net") + F.col("tax")).alias("right_totals"), F.count_if(F.col("state") == "it's open").alias("defaults"))
    return before.unionByName(after).join(F.broadcast(held))
