"""Queries on loads by level and on dependencies that are deep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import checks, depgraph, pages
from tablesmith.plans.queries import load, one, query, shared_folder
from tablesmith.sources import loads
from tablesmith.sources.tables import dense_index

CHAIN = [["region", "part"], ["nation"], ["customer", "supplier"], ["orders"]]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", {i} AS level, count(*) AS rows, count(*) AS held, {str(i < 2 or t == 'supplier').lower()} AS before_the_break FROM {t}" for i, names in enumerate(CHAIN) for t in names))
def k1_resumed_load(spark, sf_dir):
    """A load that breaks off in the third level, where customers fail and suppliers do not, and is taken up again: each row stands once."""
    tables, base = load(spark, sf_dir, *[t for names in CHAIN for t in names]), shared_folder(spark)
    broken = tables | {"customer": tables["customer"].withColumn("c_name", F.raise_error(F.lit("the source went away")).cast("string"))}
    try:
        loads.load_by_level(broken, CHAIN, base, "first")
        raise AssertionError("the load did not break off")
    except Exception as e:
        if "the source went away" not in str(e):
            raise
    before = loads.manifest(spark, base, "first").select("table", F.lit(True).alias("before_the_break"))
    noted = loads.load_by_level(tables, CHAIN, base, "first")
    held = []
    for t, df in sorted(tables.items()):
        back = loads.loaded(spark, base, t)
        same = back.exceptAll(df).agg(F.count("*").alias("more"))
        held.append(back.agg(F.count("*").alias("n")).withColumn("table", F.lit(t)).join(same.withColumn("table", F.lit(t)), "table").filter("more = 0").select("table", F.col("n").alias("held")))
    found = noted.select("table", "level", "rows").join(reduce(DataFrame.unionByName, held), "table").join(before, "table", "left")
    return found.withColumn("before_the_break", F.coalesce("before_the_break", F.lit(False)))


@query("SELECT '(' || o_custkey || ', ' || o_orderkey || ', ''' || o_orderpriority || ''')' AS tuple, true AS fits FROM orders")
def k2_batched_statements(spark, sf_dir):
    """Statements of up to 100 orders each; taken apart again, they hold each order once."""
    found = loads.insert_batches(one(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "orders", 100)
    body = F.regexp_extract("statement", r"^INSERT INTO \"orders\" \(\"o_custkey\", \"o_orderkey\", \"o_orderpriority\"\) VALUES \((.*)\);$", 1)
    tuples = F.split(body, r"\), \(")
    return found.select(F.explode(tuples).alias("t"), (F.size(tuples) <= 100).alias("fits")).select(F.concat(F.lit("("), F.col("t"), F.lit(")")).alias("tuple"), "fits")


#: Each order follows the one before it; every hundredth stands by itself, and the last chain is a long one.
LINKS = "SELECT k, CASE WHEN k > 0 AND (k % 100 > 0 OR k > n // 2) THEN k - 1 END AS up, n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)"


def order_links(spark, sf_dir) -> DataFrame:
    orders = one(spark, sf_dir, "orders")
    k, n = F.col("idx"), orders.count()
    return dense_index(orders.select(F.col("o_orderkey").alias("key"))).select(k.alias("k"), F.when((k > 0) & ((k % 100 > 0) | (k > n // 2)), k - 1).alias("up"))


START = "(CASE WHEN k > n // 2 THEN n // 2 // 100 * 100 ELSE k // 100 * 100 END)"


@query(f"SELECT k AS id, {START} AS root, k - {START} AS depth FROM ({LINKS})")
def v12_depths_of_long_chains(spark, sf_dir):
    return checks.depths(order_links(spark, sf_dir), "k", "up")


@query(f"SELECT 'o' || k AS \"table\", CAST(k - {START} AS INT) AS level FROM ({LINKS})")
def o2_levels_of_long_chains(spark, sf_dir):
    """As many levels as the longest chain has orders."""
    links = order_links(spark, sf_dir)
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    return depgraph.levels(links.select(name("k").alias("table")), links.filter("up IS NOT NULL").select(name("k").alias("child"), name("up").alias("parent")))


@query(f"WITH l AS (SELECT *, {START} AS root FROM ({LINKS})), s AS (SELECT k, root FROM l WHERE k % 70 = 69), m AS (SELECT root, max(k) AS last FROM s GROUP BY root) SELECT 'o' || l.k AS \"table\", l.k NOT IN (SELECT k FROM s) AS auto_added FROM l JOIN m ON m.root = l.root AND l.k <= last")
def o5_closure_over_long_chains(spark, sf_dir):
    links = order_links(spark, sf_dir)
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    edges = links.filter("up IS NOT NULL").select(name("k").alias("child"), name("up").alias("parent"), F.lit(False).alias("nullable"))
    return depgraph.close_selection(edges, links.filter("k % 70 = 69").select(name("k").alias("table")))


@query("SELECT page, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), (VALUES (0), (50), (90), (100)) AS p(page) WHERE k >= n * page // 100 - CASE WHEN page = 100 THEN 10 ELSE 0 END AND k < n * page // 100 + 40")
def r6_late_pages(spark, sf_dir):
    """Pages of 40 orders at the start, in the middle, at nine tenths, and the last ten."""
    orders = one(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n, written = orders.count(), pages.write_pages(orders, ["o_orderkey"], shared_folder(spark), 16)
    found = [written.page(n * p // 100 - (10 if p == 100 else 0), 40).select(F.lit(p).alias("page"), "o_orderkey", "o_custkey", "o_orderstatus") for p in (0, 50, 90, 100)]
    return reduce(DataFrame.unionByName, found)
