"""Registered queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.functions.hashing import Cells
from tablesmith.operators import checks, depgraph, gaps, inclusions, profile, synth
from tablesmith.sources import sinks
from tablesmith.sources import tables as src
from tablesmith.spec import SchemaSpec
from tablesmith.streaming import checks as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CORE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
SEED = 7


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return src.load_tables(spark, sf_dir, list(names))


def one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)[name]


def cells(table: str, column: str, row: str) -> Cells:
    return Cells(SEED, table, column, F.col(row), "md5")


def text_sql(table: str, column: str, row: str) -> str:
    return f"concat_ws('|', '{SEED}', '{table}', '{column}', CAST({row} AS VARCHAR))"


def h(table: str, column: str, row: str) -> str:
    return f"CAST('0x' || substr(md5({text_sql(table, column, row)}), 1, 15) AS BIGINT)"


def pick_sql(hash_sql: str, values: list[str]) -> str:
    return f"([{', '.join(f"'{v}'" for v in values)}])[{hash_sql} % {len(values)} + 1]"


EDGES = [("nation", "n_regionkey", "region", "r_regionkey", False), ("customer", "c_nationkey", "nation", "n_nationkey", False), ("supplier", "s_nationkey", "nation", "n_nationkey", True), ("orders", "o_custkey", "customer", "c_custkey", False), ("lineitem", "l_orderkey", "orders", "o_orderkey", False), ("lineitem", "l_partkey", "part", "p_partkey", False), ("lineitem", "l_suppkey", "supplier", "s_suppkey", True)]
LEVELS = {"region": 0, "part": 0, "supplier": 0, "nation": 1, "customer": 2, "orders": 3, "lineitem": 4}


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "child string, column string, parent string, ref_column string, nullable boolean")


def counts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, *CORE)
    return src.row_counts({t: df.filter(F.lit(False)) if t in ("lineitem", "supplier") else df for t, df in tables.items()})


COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in CORE)
GAP_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {'0 * count(*)' if t in ('lineitem', 'supplier') else 'count(*)'} AS n FROM {t}" for t in CORE)
EDGES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {str(e).lower()})" for a, b, c, d, e in EDGES) + ') AS e(child, "column", parent, ref_column, nullable)'
LEVELS_SQL = "(VALUES " + ", ".join(f"('{t}', {n})" for t, n in LEVELS.items()) + ') AS lv("table", level)'


# Row-level dependencies: every order depends on its customer, every customer and supplier on a nation, every nation on a region.
def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "orders", "customer", "supplier", "nation")
    parts = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = [t[name].select(F.concat(F.lit(a), F.col(k).cast("string")).alias("child"), F.lit(r).alias("column"), F.concat(F.lit(b), F.col(r).cast("string")).alias("parent"), F.lit("id").alias("ref_column"), F.lit(a == "s").alias("nullable")) for name, a, k, b, r in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


ROW_EDGES_SQL = """(SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent, false AS nullable FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, false FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, true FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, false FROM nation) AS e"""


@query(COUNTS_SQL)
def s1_table_row_counts(spark, sf_dir):
    return src.row_counts(load(spark, sf_dir, *CORE))


@query("SELECT DISTINCT o_custkey AS key FROM orders")
def s2_key_values(spark, sf_dir):
    return src.key_values(one(spark, sf_dir, "orders"), "o_custkey").distinct()


@query("SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key FROM (SELECT DISTINCT o_orderkey AS key FROM orders)")
def s4_dense_key_index(spark, sf_dir):
    return src.dense_index(one(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))


def profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        whole = kind in ("int", "bigint")
        parts.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, max(length(CAST({c} AS VARCHAR))) AS longest, count(DISTINCT {c}) = count(*) AS is_unique, {f'max({c}) - min({c}) + 1 = count(DISTINCT {c}) AND count(DISTINCT {c}) = count(*)' if whole else 'false'} AS is_sequence, count(DISTINCT {c}) BETWEEN 1 AND 12 AS is_enum FROM {table}")
    return " UNION ALL ".join(parts)


@query(profile_sql("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}))
def p2_profile_orders(spark, sf_dir):
    return profile.profile_table(one(spark, sf_dir, "orders"), "orders")


LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query(profile_sql("lineitem", LINEITEM))
def p8_profile_lineitem(spark, sf_dir):
    return profile.profile_table(one(spark, sf_dir, "lineitem"), "lineitem")


@query(" UNION ALL ".join(f"SELECT '{a}' AS child, '{b}' AS \"column\", '{c}' AS parent, '{d}' AS ref_column, CAST(count(DISTINCT {b}) FILTER ({b} IN (SELECT {d} FROM {c})) AS DOUBLE) / count(DISTINCT {b}) AS coverage FROM {a}" for a, b, c, d, _ in EDGES))
def p5_foreign_keys(spark, sf_dir):
    return inclusions.foreign_keys(load(spark, sf_dir, *CORE), names_only=True).filter("rank = 1 AND coverage > 0").select("child", "column", "parent", "ref_column", "coverage")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS domain, count(DISTINCT {c}) AS n_values FROM {t}" for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"))))
def p6_enum_domains(spark, sf_dir):
    return profile.enum_domains(one(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(f"SELECT child, parent FROM {ROW_EDGES_SQL} WHERE NOT nullable AND child <> parent")
def o1_hard_edges(spark, sf_dir):
    return depgraph.hard_edges(row_edges(spark, sf_dir)).select("child", "parent")


@query("SELECT 'r' || r_regionkey AS \"table\", 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 's' || s_suppkey, 0 FROM supplier UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders")
def o2_dependency_levels(spark, sf_dir):
    all_ = row_edges(spark, sf_dir)
    nodes = all_.select(F.col("child").alias("table")).unionByName(one(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("table")))
    return depgraph.levels(nodes, depgraph.hard_edges(all_))


@query("SELECT 'c' || c_custkey AS \"table\" FROM customer WHERE c_custkey % 50 < 3")
def o3_cycle_report(spark, sf_dir):
    customer, key = one(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    ring = customer.filter(key % 50 < 3).select(name(key).alias("child"), name(F.when(key % 50 == 0, key).otherwise(key - key % 50)).alias("parent"))
    loop = customer.filter(key % 50 == 0).select(name(key).alias("child"), name(key).alias("parent"))
    return depgraph.cycle_report(depgraph.levels(customer.select(name(key).alias("table")), ring.unionByName(loop)))


@query(f"WITH e AS (SELECT * FROM {ROW_EDGES_SQL}), u AS (SELECT child AS t, string_agg(DISTINCT parent, ',' ORDER BY parent) AS p FROM e GROUP BY 1), d AS (SELECT parent AS t, string_agg(DISTINCT child, ',' ORDER BY child) AS c FROM e GROUP BY 1) SELECT coalesce(u.t, d.t) AS \"table\", coalesce(p, '') AS parents, coalesce(c, '') AS children FROM u FULL JOIN d ON u.t = d.t")
def o4_neighbours(spark, sf_dir):
    return depgraph.neighbours(row_edges(spark, sf_dir))


@query("WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)) SELECT 'o' || o_orderkey AS \"table\", false AS auto_added FROM o UNION ALL SELECT 'c' || c_custkey, true FROM c UNION ALL SELECT 'n' || n_nationkey, true FROM n UNION ALL SELECT DISTINCT 'r' || n_regionkey, true FROM n")
def o5_selection_closure(spark, sf_dir):
    chosen = one(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("table"))
    return depgraph.close_selection(row_edges(spark, sf_dir), chosen)


def table_levels(spark: SparkSession) -> DataFrame:
    return depgraph.levels(spark.createDataFrame([(t,) for t in CORE], "table string"), depgraph.hard_edges(edges(spark)))


@query(f"WITH c AS ({COUNTS_SQL}), hd AS (SELECT child, list_sort(list(DISTINCT parent)) AS l FROM {EDGES_SQL} WHERE NOT nullable GROUP BY 1), s AS (SELECT child, list_sort(list(DISTINCT parent || '?')) AS l FROM {EDGES_SQL} WHERE nullable GROUP BY 1) SELECT lv.\"table\", level, n, array_to_string(list_concat(coalesce(hd.l, []), coalesce(s.l, [])), ',') AS dependencies FROM {LEVELS_SQL} JOIN c ON c.\"table\" = lv.\"table\" LEFT JOIN hd ON hd.child = lv.\"table\" LEFT JOIN s ON s.child = lv.\"table\"")
def o6_seed_plan(spark, sf_dir):
    return depgraph.seed_plan(table_levels(spark), edges(spark), s1_table_row_counts(spark, sf_dir))


@query(f"WITH c AS ({COUNTS_SQL}) SELECT child, \"column\", parent, ref_column, nullable, a.n AS child_rows, b.n AS parent_rows, false AS cyclic FROM {EDGES_SQL} JOIN c a ON a.\"table\" = child JOIN c b ON b.\"table\" = parent")
def o7_graph_payload(spark, sf_dir):
    return depgraph.graph_payload(edges(spark), s1_table_row_counts(spark, sf_dir), table_levels(spark))


@query(f"SELECT DISTINCT child, parent FROM {ROW_EDGES_SQL}")
def o8_display_parents(spark, sf_dir):
    return depgraph.display_parents(row_edges(spark, sf_dir))


@query(f"WITH c AS ({GAP_COUNTS_SQL}) SELECT c.\"table\", level FROM c JOIN {LEVELS_SQL} ON c.\"table\" = lv.\"table\" WHERE n = 0")
def r1_empty_tables(spark, sf_dir):
    return gaps.empty_tables(counts_with_gaps(spark, sf_dir), table_levels(spark))


@query(f"WITH c AS ({GAP_COUNTS_SQL}), p AS (SELECT DISTINCT child, parent FROM {EDGES_SQL}), d AS (SELECT child, string_agg(x, ', ' ORDER BY x) AS x FROM (SELECT child, parent || CASE WHEN n = 0 THEN ' (filling)' ELSE ' (' || n || ' rows)' END AS x FROM p JOIN c ON c.\"table\" = parent) GROUP BY 1) SELECT c.\"table\", n, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, coalesce(x, '') AS depends_on FROM c LEFT JOIN d ON d.child = c.\"table\"")
def r2_gap_report(spark, sf_dir):
    return gaps.gap_report(counts_with_gaps(spark, sf_dir), edges(spark))


@query(f"WITH c AS ({GAP_COUNTS_SQL}) SELECT count(*) AS tables, count(*) FILTER (n = 0) AS gaps, CAST(sum(CASE WHEN n = 0 THEN CASE WHEN \"table\" = 'lineitem' THEN 400 ELSE 25 END END) AS BIGINT) AS planned_rows FROM c")
def r3_gap_totals(spark, sf_dir):
    return gaps.gap_totals(counts_with_gaps(spark, sf_dir), 25, {"lineitem": 400, "supplier": 0})


@query(f"WITH c AS ({GAP_COUNTS_SQL}) SELECT c.\"table\", level FROM c JOIN {LEVELS_SQL} ON c.\"table\" = lv.\"table\" WHERE n = 0 AND c.\"table\" IN ('lineitem', 'orders', 'part', 'customer', 'nation', 'region')")
def r4_scoped_gaps(spark, sf_dir):
    return gaps.scoped_gaps(counts_with_gaps(spark, sf_dir), edges(spark), spark.createDataFrame([("lineitem",)], "table string"), table_levels(spark))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_name, coalesce(CAST(CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS VARCHAR), 'NULL') AS c_nationkey FROM customer ORDER BY customer.c_custkey LIMIT 100 OFFSET 7")
def r6_preview(spark, sf_dir):
    df = one(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("c_nationkey"))
    return gaps.preview(df, ["c_custkey"], 1000, 7)


@query(f"WITH c AS ({COUNTS_SQL}) SELECT coalesce(\"table\", '(total)') AS \"table\", CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ROLLUP (\"table\")")
def r7_counts_with_total(spark, sf_dir):
    return gaps.generated_counts(load(spark, sf_dir, *CORE))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3")
def v1_orphans(spark, sf_dir):
    t = load(spark, sf_dir, "orders", "customer")
    return checks.orphans(t["orders"], "o_custkey", t["customer"].filter("c_custkey % 7 <> 3"), "c_custkey").select("o_orderkey")


@query("SELECT 'lineitem.l_orderkey' AS \"check\", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey % 7 = 3 UNION ALL SELECT 'orders.o_orderkey null', count(*) FROM orders WHERE o_orderkey % 11 = 0")
def v_report(spark, sf_dir):
    t = load(spark, sf_dir, "orders", "customer", "lineitem")
    damaged = t["orders"].withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")))
    return checks.report({"lineitem.l_orderkey": checks.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), "orders.o_custkey": v1_orphans(spark, sf_dir), "orders.o_orderkey null": checks.nulls(damaged, "o_orderkey")})


@query("SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0")
def v2_nulls(spark, sf_dir):
    damaged = one(spark, sf_dir, "orders").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")))
    return checks.nulls(damaged, "o_orderkey").select("o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def v3_duplicates(spark, sf_dir):
    return checks.duplicates(one(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v4_composite_duplicates(spark, sf_dir):
    return checks.duplicates(one(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT l_quantity BETWEEN 5 AND 40")
def v5_out_of_range(spark, sf_dir):
    return checks.out_of_range(one(spark, sf_dir, "lineitem"), "l_quantity", 5, 40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def v6_outside_domain(spark, sf_dir):
    return checks.outside_domain(one(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 9")
def v7_too_long(spark, sf_dir):
    return checks.too_long(one(spark, sf_dir, "part"), "p_name", 9).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')")
def v8_malformed(spark, sf_dir):
    return checks.malformed(one(spark, sf_dir, "customer"), "c_name", "[02468]$").select("c_custkey", "c_name")


@query("SELECT value, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('X')) AS d(value) LEFT JOIN orders ON o_orderstatus = value GROUP BY 1 HAVING count(o_orderkey) * 2 < (SELECT count(*) FROM orders)")
def v9_undercovered(spark, sf_dir):
    orders = one(spark, sf_dir, "orders")
    return checks.undercovered(orders, "o_orderstatus", ["F", "O", "X"], -(-orders.count() // 2))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = 1 OR o_custkey % 9 = 0")
def v10_broken_chains(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    t["customer"], t["nation"] = t["customer"].filter("c_custkey % 9 <> 0"), t["nation"].filter("n_nationkey % 5 <> 1")
    return checks.broken_chains(t, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]).select("l_orderkey", "l_linenumber")


def managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a parent: a tree of digits of the key, but for keys that end in 7, which form cycles of themselves and the next."""
    return one(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") < 10, F.lit(None)).otherwise(F.floor(F.col("c_custkey") / 10)).cast("long").alias("manager"))


@query("SELECT c_custkey FROM customer WHERE c_custkey < 10")
def v11_roots(spark, sf_dir):
    return checks.roots(managed(spark, sf_dir), "manager", "c_custkey").select("c_custkey")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey >= 1000")
def v12_depth_violations(spark, sf_dir):
    return checks.depth_violations(managed(spark, sf_dir), "c_custkey", "manager", 2)


@query("SELECT 'orders' AS \"table\", 'empty' AS expected, count(*) AS n FROM orders UNION ALL SELECT 'part', '3', count(*) FROM part")
def v13_unexpected_counts(spark, sf_dir):
    return checks.unexpected_counts(load(spark, sf_dir, *CORE), {"orders": "empty", "part": 3, "region": "filled", "nation": 25})


@query("SELECT 'n' || n_nationkey AS child, CAST(1 AS BIGINT) AS n, CAST(2 AS BIGINT) AS n_expected FROM nation WHERE n_nationkey % 2 = 0")
def v15_fk_counts(spark, sf_dir):
    expected = row_edges(spark, sf_dir).select("child", F.when(F.col("child").startswith("n") & (F.substring("child", 2, 9).cast("long") % 2 == 0), F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n_expected"))
    return checks.fk_count_differences(row_edges(spark, sf_dir), expected)


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start, 'small' AS \"rule\", count(*) AS n FROM events WHERE NOT value < 50 GROUP BY 1 UNION ALL SELECT strftime(time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S'), 'known', count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def v_windowed_violations(spark, sf_dir):
    rules = {"small": F.col("value") < 50, "known": F.col("event_type").isin("click", "view")}
    found = streaming.windowed_counts(one(spark, sf_dir, "events"), rules, "ts")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def generated(spark: SparkSession, sf_dir: str, wanted: dict[str, str]) -> DataFrame:
    """``o_orderkey`` and generated columns: name, generator."""
    return one(spark, sf_dir, "orders").select("o_orderkey", *[G.generate(g, cells("t", name, "o_orderkey")).alias(name) for name, g in wanted.items()])


def ht(column: str, salt: str = "") -> str:
    return h("t", column + salt, "o_orderkey")


DAYS = (G.END - G.START).days + 1


@query(f"SELECT o_orderkey, 5 + {ht('num')} % 96 AS num, CAST((100 + {ht('cost')} % 99901) / 100.0 AS DECIMAL(18,2)) AS cost, {ht('flag')} % 2 = 0 AS flag, {pick_sql(ht('kind'), ['a b', 'c(d)', 'e'])} AS kind, CAST({ht('unit')} AS DOUBLE) / 1152921504606846976.0 < 0.5 AS low_half FROM orders")
def g1_numbers(spark, sf_dir):
    return generated(spark, sf_dir, {"num": "number(5,100)", "cost": "price(1,1000)", "flag": "bool", "kind": "randomstring( a b ,c(d), e)", "unit": "float64"}).select("o_orderkey", "num", "cost", "flag", "kind", (F.col("unit") < 0.5).alias("low_half"))


@query(f"SELECT o_orderkey, {pick_sql(ht('w'), G.WORDS)} AS w, {pick_sql(ht('n', 'f'), G.FIRST)} || ' ' || {pick_sql(ht('n', 'l'), G.LAST)} AS n, lower({pick_sql(ht('m', 'f'), G.FIRST)}) || '.' || lower({pick_sql(ht('m', 'l'), G.LAST)}) || ({ht('m')} % 1000000) || '@example.com' AS m, {pick_sql(ht('u', 'w'), G.WORDS)} || ({ht('u')} % 10000) AS u, lpad(CAST({ht('p')} % 10000000000 AS VARCHAR), 10, '0') AS p, lpad(CAST({ht('z')} % 100000 AS VARCHAR), 5, '0') AS z, ({ht('s')} % 999 + 1) || ' ' || {pick_sql(ht('s', 's'), G.STREETS)} AS s, 'https://example.com/' || {pick_sql(ht('l'), G.WORDS)} AS l FROM orders")
def g2_people_and_places(spark, sf_dir):
    return generated(spark, sf_dir, {"w": "word", "n": "name", "m": "email", "u": "username", "p": "phone", "z": "zip", "s": "street", "l": "url"})


@query(f"SELECT o_orderkey, {pick_sql(ht('c'), G.CITIES)} AS c, {pick_sql(ht('st'), G.STATES)} AS st, {pick_sql(ht('co'), G.COUNTRIES)} AS co, {pick_sql(ht('pr', 'a'), G.ADJECTIVES)} || ' ' || {pick_sql(ht('pr'), G.PRODUCTS)} AS pr, {pick_sql(ht('cm', 'l'), G.LAST)} || ' ' || {pick_sql(ht('cm'), G.SUFFIXES)} AS cm, {pick_sql(ht('jb', 'v'), G.LEVELS)} || ' ' || {pick_sql(ht('jb'), G.JOBS)} AS jb, CAST(({ht('la')} % 180000001) / 1000000.0 - 90 AS DECIMAL(12,6)) AS la FROM orders".replace(f"CAST(({ht('la')} % 180000001) / 1000000.0 - 90 AS DECIMAL(12,6))", f"CAST(CAST({ht('la')} % 180000001 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) - 90 AS DECIMAL(12,6))"))
def g3_business_words(spark, sf_dir):
    return generated(spark, sf_dir, {"c": "city", "st": "state", "co": "country", "pr": "productname", "cm": "company", "jb": "jobtitle", "la": "latitude"}).withColumn("la", F.col("la").cast("decimal(12,6)"))


D = f"md5({text_sql('t', '%s', 'o_orderkey')})"


@query(f"SELECT o_orderkey, substr({D % 'u'}, 1, 8) || '-' || substr({D % 'u'}, 9, 4) || '-4' || substr({D % 'u'}, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr({D % 'u'}, 17, 1) AS BIGINT) % 4 AS INT) + 1, 1) || substr({D % 'u'}, 18, 3) || '-' || substr({D % 'u'}, 21, 12) AS u, ({ht('i')} % 256) || '.' || (({ht('i')} // 256) % 256) || '.' || (({ht('i')} // 65536) % 256) || '.' || (({ht('i')} // 16777216) % 256) AS i, regexp_replace(substr({D % 'm'}, 1, 12), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS m, '#' || substr({D % 'x'}, 1, 6) AS x FROM orders")
def g4_identifiers(spark, sf_dir):
    return generated(spark, sf_dir, {"u": "uuid", "i": "ipv4", "m": "macaddress", "x": "hexcolor"})


@query(f"SELECT o_orderkey, DATE '2000-01-01' + CAST({ht('d')} % {DAYS} AS INT) AS d, lpad(CAST(({ht('c')} % 86400) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({ht('c')} % 86400) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ht('c')} % 60 AS VARCHAR), 2, '0') AS c, strftime(TIMESTAMP '2000-01-01' + to_seconds({ht('i')} % {DAYS * 86400}), '%Y-%m-%d %H:%M:%S') AS i FROM orders".replace(f"({ht('c')} % 60 AS", f"({ht('c')} % 86400 % 60 AS"))
def g5_dates_and_times(spark, sf_dir):
    return generated(spark, sf_dir, {"d": "date", "c": "time", "i": "datetime"}).withColumn("i", F.date_format("i", "yyyy-MM-dd HH:mm:ss"))


def words_sql(column: str, n: int) -> list[str]:
    return [pick_sql(h("t", column + "w", f"(CAST(o_orderkey AS VARCHAR) || '#{i}')"), G.WORDS) for i in range(1, n + 1)]


@query(f"SELECT o_orderkey, upper(left(s, 1)) || substr(s, 2) || '.' AS s, '{{\"key\":\"' || k || '\",\"value\":\"' || v || '\"}}' AS j, left(s, 9) AS cut FROM (SELECT o_orderkey, concat_ws(' ', {', '.join(words_sql('s', 5))}) AS s, {pick_sql(ht('j', 'k'), G.WORDS)} AS k, {pick_sql(ht('j', 'v'), G.WORDS)} AS v FROM orders)")
def g6_sentences_and_json(spark, sf_dir):
    return generated(spark, sf_dir, {"s": "sentence", "j": "json"}).withColumn("cut", F.lower(G.fit_length(F.col("s"), 9)))


def sentence_sql(words: list[str]) -> str:
    text = f"concat_ws(' ', {', '.join(words)})"
    return f"upper(left({text}, 1)) || substr({text}, 2) || '.'"


@query(f"SELECT o_orderkey, {" || ' ' || ".join(sentence_sql(words_sql('p', 24)[8 * i : 8 * i + 8]) for i in range(3))} AS p FROM orders")
def g7_paragraphs(spark, sf_dir):
    return generated(spark, sf_dir, {"p": "paragraph(1)"})


CUSTOMER_INDEX = "(SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey FROM customer)"


@query(f"SELECT o_orderkey, c.c_custkey AS custkey FROM orders JOIN {CUSTOMER_INDEX} c ON c.idx = {h('orders', 'custkey', 'o_orderkey')} % (SELECT count(*) FROM customer)")
def d5_foreign_keys_to_existing_rows(spark, sf_dir):
    t = load(spark, sf_dir, "orders", "customer")
    keys = src.dense_index(t["customer"].select(F.col("c_custkey").alias("key")))
    return synth.sample_keys(t["orders"].select("o_orderkey"), "o_orderkey", keys, t["customer"].count(), cells("orders", "custkey", "o_orderkey"), "custkey")


def synth_spec() -> SchemaSpec:
    """A shop whose customers exist already: new orders for them, notes that reply to notes, and links of notes and tags."""
    return SchemaSpec.of(
        {
            "customer": {"c_custkey": {"type": "bigint", "pk": True}},
            "purchase": {"id": {"type": "bigint", "pk": True}, "custkey": {"type": "bigint", "fk": "customer.c_custkey"}, "status": {"type": "varchar", "ddl_type": "varchar(6)", "generator": "randomstring(open,closed,cancelled)"}, "amount": {"type": "numeric", "ddl_type": "numeric(10,2)", "generator": "price(1,1000)"}, "code": {"type": "bigint", "unique": True}, "day": {"type": "date", "generator": "date"}},
            "note": {"id": {"type": "bigint", "pk": True}, "reply_to": {"type": "bigint", "fk": "note.id", "nullable": True}, "purchase_id": {"type": "bigint", "fk": "purchase.id"}},
            "tag": {"id": {"type": "bigint", "pk": True}, "name": {"type": "text", "generator": "word"}},
            "note_tag": {"note_id": {"type": "bigint", "fk": "note.id", "pk": True}, "tag_id": {"type": "bigint", "fk": "tag.id", "pk": True}},
            "reading": {"tag_id": {"type": "bigint", "fk": "tag.id", "pk": True}, "day": {"type": "date", "pk": True}, "value": {"type": "int", "generator": "number(1,9)"}},
        }
    )


def synthesized(spark: SparkSession, sf_dir: str, **options) -> synth.Synthesis:
    """As many rows of each table as there are customers (tags: 1 in 100), from the md5 hash that SQL has too."""
    customer = one(spark, sf_dir, "customer").select("c_custkey")
    n = customer.count()
    return synth.synthesize(spark, synth_spec(), rows=n, targets=["purchase", "note", "tag", "note_tag", "reading"], table_rows={"tag": max(2, n // 100)}, existing={"customer": customer}, seed=SEED, hash_kind="md5", **options)


ROWS_SQL = "(SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer)"
TAGS_SQL = "greatest(2, n // 100)"


@query(f"SELECT i + 1 AS id, c.c_custkey AS custkey, left({pick_sql(h('purchase', 'status', 'i'), ['open', 'closed', 'cancelled'])}, 6) AS status, CAST((100 + {h('purchase', 'amount', 'i')} % 99901) / 100.0 AS DECIMAL(10,2)) AS amount, i + 1 AS code, DATE '2000-01-01' + CAST({h('purchase', 'day', 'i')} % {DAYS} AS INT) AS day FROM {ROWS_SQL} JOIN {CUSTOMER_INDEX} c ON c.idx = {h('purchase', 'custkey', 'i')} % n")
def d1_synthesized_purchases(spark, sf_dir):
    return synthesized(spark, sf_dir).tables["purchase"]


@query(f"SELECT i + 1 AS id, CASE WHEN i > 0 THEN least(i - 1, 1) + 1 END AS reply_to, {h('note', 'purchase_id', 'i')} % n + 1 AS purchase_id FROM {ROWS_SQL}")
def d9_self_references(spark, sf_dir):
    return synthesized(spark, sf_dir).tables["note"]


@query(f"SELECT i % n + 1 AS note_id, i // n % {TAGS_SQL} + 1 AS tag_id FROM {ROWS_SQL}")
def d7_key_combinations(spark, sf_dir):
    return synthesized(spark, sf_dir).tables["note_tag"]


@query(f"SELECT count(*) AS rows, count(*) AS distinct_keys, CAST(0 AS BIGINT) AS orphans FROM {ROWS_SQL}")
def d4_composite_temporal_keys(spark, sf_dir):
    made = synthesized(spark, sf_dir).tables
    bad = checks.orphans(made["reading"], "tag_id", made["tag"], "id").agg(F.count("*").alias("orphans"))
    return made["reading"].agg(F.count("*").alias("rows"), F.count_distinct("tag_id", "day").alias("distinct_keys")).crossJoin(bad)


@query(f"SELECT i + 1 AS id, 1 + {h('line', 'quantity', 'i')} % 9 AS quantity, CAST(i * 3 AS BIGINT) AS price, (1 + {h('line', 'quantity', 'i')} % 9) * i * 3 AS total, CAST(NULL AS BIGINT) AS voucher FROM {ROWS_SQL}")
def d13_generated_pinned_and_optional_columns(spark, sf_dir):
    """A computed column, one pinned to an expression, and an optional reference to a table without rows."""
    spec = SchemaSpec.of({"line": {"id": {"type": "bigint", "pk": True}, "quantity": {"type": "bigint", "generator": "number(1,9)"}, "price": {"type": "bigint", "generator": "number(1,9)"}, "total": {"type": "bigint", "generated": "quantity * price"}, "voucher": {"type": "bigint", "fk": "voucher.id", "nullable": True}}, "voucher": {"id": {"type": "bigint", "pk": True}}})
    n = one(spark, sf_dir, "customer").count()
    return synth.synthesize(spark, spec, rows=n, targets=["line"], overrides={"line": {"price": F.col("_row") * 3}}, seed=SEED, hash_kind="md5").tables["line"]


@query("SELECT o_orderkey, i + 1 AS seq, DATE '2000-01-01' + CAST(i AS INT) AS day, strftime(TIMESTAMP '2000-01-01' + to_seconds(i), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def d8_sequences(spark, sf_dir):
    index = src.dense_index(one(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))
    return index.select(F.col("key").alias("o_orderkey"), (F.col("idx") + 1).alias("seq"), G.day(F.col("idx")).alias("day"), F.date_format(G.instant(F.col("idx")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT DISTINCT o_orderpriority AS value, unnest(range(0, 20)) AS number FROM orders")
def d10_rows_for_each_enum_value(spark, sf_dir):
    return synth.enum_rows(one(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")).distinct(), 20)


@query("SELECT value, 100000000 - count(o_orderkey) AS missing FROM (SELECT DISTINCT o_orderstatus AS value FROM orders UNION SELECT 'none') LEFT JOIN orders ON o_orderstatus = value GROUP BY 1")
def d11_enum_deficits(spark, sf_dir):
    orders = one(spark, sf_dir, "orders")
    domain = orders.select(F.col("o_orderstatus").alias("value")).unionByName(spark.createDataFrame([("none",)], "value string")).distinct()
    return synth.enum_deficits(orders, "o_orderstatus", domain, 100_000_000)


@query("SELECT status AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['open', 'closed', 'cancel']) AS status FROM customer) GROUP BY 1")
def d12_enum_top_up(spark, sf_dir):
    customer = one(spark, sf_dir, "customer").select("c_custkey")
    n = customer.count()
    made = synth.synthesize(spark, synth_spec(), rows=max(1, n // 5), targets=["purchase"], min_enum_rows=n, existing={"customer": customer}, seed=SEED, hash_kind="md5")
    return made.tables["purchase"].groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT i + 1 AS s_suppkey, n.n_nationkey AS s_nationkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_nationkey FROM nation) n ON n.idx = {h('supplier', 's_nationkey', 'i')} % (SELECT count(*) FROM nation)")
def r5_fill_empty_tables(spark, sf_dir):
    t = load(spark, sf_dir, "nation", "supplier", "customer")
    spec = SchemaSpec.of({"nation": {"n_nationkey": {"type": "int", "pk": True}}, "supplier": {"s_suppkey": {"type": "bigint", "pk": True}, "s_nationkey": {"type": "int", "fk": "nation.n_nationkey"}}})
    filled = gaps.fill_gaps(spark, spec, {"nation": t["nation"], "supplier": t["supplier"].filter(F.lit(False))}, rows=t["customer"].count(), seed=SEED, hash_kind="md5")
    return filled.tables["supplier"]


@query("SELECT CAST(NULL AS VARCHAR) AS \"table\", CAST(NULL AS BIGINT) AS n FROM customer WHERE false")
def v14_no_gaps_after_a_fill(spark, sf_dir):
    t = load(spark, sf_dir, "nation")
    return checks.gaps_left({**t, "supplier": r5_fill_empty_tables(spark, sf_dir)})


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    src.cut_lineage(spark.range(1))  # sets the folder where none is
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def k1_loaded_tables(spark, sf_dir):
    t, base = load(spark, sf_dir, "orders", "customer"), shared_folder(spark)
    sinks.write_tables(t, ["customer", "orders"], base)
    back = src.load_tables(spark, base, ["customer", "orders"])
    return back["orders"].join(back["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def k3_json_round_trip(spark, sf_dir):
    base = shared_folder(spark)
    sinks.write_text({"customer": one(spark, sf_dir, "customer")}, base, "json")
    return src.load_export(spark, f"{base}/customer", "json").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT 'INSERT INTO \"part\" (\"p_brand\", \"p_name\", \"p_partkey\", \"p_size\") VALUES (''' || p_brand || ''', ''' || replace(p_name || '''s', '''', '''''') || ''', ' || p_partkey || ', ' || coalesce(CAST(CASE WHEN p_size > 10 THEN p_size END AS VARCHAR), 'NULL') || ');' AS statement FROM part")
def k2_insert_statements(spark, sf_dir):
    part = one(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("'s")).alias("p_name"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), "p_brand")
    return sinks.insert_statements(part, "part")


@query("SELECT 'nation' AS _table, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def k4_csv_rows(spark, sf_dir):
    return sinks.csv_rows(one(spark, sf_dir, "nation"), "nation").select("_table", "n_nationkey", "n_name", "n_regionkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the gaps of the tables with lineitem and supplier emptied, as ``r2_gap_report``."""
    return r2_gap_report(spark, sf_dir)

