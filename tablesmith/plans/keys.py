"""Queries on keys of made tables, above all of tables that hold rows already, and on what synthesis fills in by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.operators import synth
from tablesmith.plans.queries import SEED, generated, h, ht, load, one, pick_sql, query, text_sql
from tablesmith.spec import SchemaSpec

KEY = {"type": "bigint", "pk": True}
N_SQL = "(SELECT count(*) AS n FROM customer)"


def made(spark, spec: dict, table: str, rows: int, existing: dict[str, DataFrame], **options) -> DataFrame:
    return synth.synthesize(spark, SchemaSpec.of(spec), rows=rows, targets=[table], existing=existing, seed=SEED, hash_kind="md5", **options).tables[table]


def with_held(held: DataFrame, more: DataFrame) -> DataFrame:
    """All rows of a table that was filled further, so that a key that both parts have shows twice."""
    return held.select(*more.columns, F.lit(False).alias("is_new")).unionByName(more.withColumn("is_new", F.lit(True)))


def uuid_sql(digest: str) -> str:
    return f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-4' || substr({digest}, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr({digest}, 17, 1) AS BIGINT) % 4 AS INT) + 1, 1) || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"


@query(f"""WITH held AS (SELECT {uuid_sql("md5('person' || c_custkey)")} AS id FROM customer), s AS (SELECT '#' || CAST(sum(CAST('0x' || substr(md5(id), 1, 8) AS BIGINT)) AS VARCHAR) AS salt, count(*) AS n FROM held)
SELECT id, false AS is_new FROM held UNION ALL SELECT {uuid_sql(f"md5({text_sql('person', 'id', '(i || salt)')})")}, true FROM (SELECT unnest(range(n)) AS i, salt FROM s)""")
def d3_refilled_uuid_keys(spark, sf_dir):
    held = one(spark, sf_dir, "customer").select(G.uuid(F.md5(F.concat(F.lit("person"), F.col("c_custkey").cast("string")))).alias("id"))
    return with_held(held, made(spark, {"person": {"id": {"type": "uuid", "pk": True}}}, "person", held.count(), {"person": held}))


DAYS = (G.END - G.START).days + 1


@query(f"""WITH held AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + 2922 AS DATE) AS day FROM orders), free AS (SELECT CAST(DATE '2000-01-01' + CAST(i AS INT) AS DATE) AS day FROM range({DAYS}) AS r(i))
SELECT day, false AS is_new FROM held UNION ALL SELECT day, true FROM (SELECT day FROM free WHERE day NOT IN (SELECT day FROM held) ORDER BY day LIMIT 2000)""")
def d4_refilled_dates(spark, sf_dir):
    held = one(spark, sf_dir, "orders").select(F.date_add(F.col("o_orderdate").cast("date"), 2922).alias("day")).distinct()
    return with_held(held, made(spark, {"calendar": {"day": {"type": "date", "pk": True}}}, "calendar", 2000, {"calendar": held}))


def clock_sql(seconds: str) -> str:
    return f"lpad(CAST({seconds} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({seconds} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({seconds} % 60 AS VARCHAR), 2, '0')"


@query(f"""WITH held AS (SELECT DISTINCT c_custkey * 7 % 86400 AS s FROM customer), n AS (SELECT least(count(*), 20000) AS n FROM held), free AS (SELECT i AS s FROM range(86400) AS r(i) WHERE i NOT IN (SELECT s FROM held))
SELECT {clock_sql('s')} AS at, false AS is_new FROM held UNION ALL SELECT {clock_sql('s')}, true FROM (SELECT s, row_number() OVER (ORDER BY s) AS k FROM free), n WHERE k <= n""")
def d4_refilled_times(spark, sf_dir):
    """As many more times as there are (up to 20,000), or all that are left of a day, which may be none."""
    held = one(spark, sf_dir, "customer").select(G.clock(F.col("c_custkey") * 7 % 86_400).alias("at")).distinct()
    n = held.count()
    return with_held(held, made(spark, {"bell": {"at": {"type": "time", "pk": True}}}, "bell", min(n, 20_000, 86_400 - n), {"bell": held}))


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS a, p_partkey FROM part), s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS b, s_suppkey FROM supplier),
held AS (SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem WHERE l_suppkey % 3 = 0), k AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers),
taken AS (SELECT a + b * parts AS i FROM held JOIN p ON p_partkey = part_id JOIN s ON s_suppkey = supplier_id, k), free AS (SELECT i, row_number() OVER (ORDER BY i) AS place FROM (SELECT unnest(range(parts * suppliers)) AS i FROM k) WHERE i NOT IN (SELECT i FROM taken))
SELECT part_id, supplier_id, false AS is_new FROM held UNION ALL SELECT p_partkey, s_suppkey, true FROM free, k, p, s WHERE place <= (SELECT n FROM {N_SQL}) AND p.a = i % parts AND s.b = i // parts""")
def d7_refilled_junction(spark, sf_dir):
    t = load(spark, sf_dir, "part", "supplier", "lineitem", "customer")
    held = t["lineitem"].filter("l_suppkey % 3 = 0").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")).distinct()
    spec = {"part": {"p_partkey": KEY}, "supplier": {"s_suppkey": KEY}, "offer": {"part_id": {"type": "bigint", "fk": "part.p_partkey", "pk": True}, "supplier_id": {"type": "bigint", "fk": "supplier.s_suppkey", "pk": True}}}
    return with_held(held, made(spark, spec, "offer", t["customer"].count(), {"part": t["part"], "supplier": t["supplier"], "offer": held}))


@query("""WITH held AS (SELECT c_custkey AS id, c_custkey * 3 AS code, CAST(DATE '2001-01-01' + CAST(c_custkey % 700 AS INT) AS DATE) AS day, lower(to_base(c_custkey * 5, 36, 6)) AS short FROM customer WHERE c_custkey % 10 = 1),
m AS (SELECT max(id) AS id, max(code) AS code, date_diff('day', DATE '2000-01-01', max(day)) + 1 AS day, count(*) AS n FROM held), free AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM (SELECT unnest(range(2 * n)) AS i FROM m) WHERE lower(to_base(i, 36, 6)) NOT IN (SELECT short FROM held))
SELECT id, code, day, short, false AS is_new FROM held UNION ALL SELECT m.id + 1 + k, m.code + 1 + k, CAST(DATE '2000-01-01' + CAST(m.day + k AS INT) AS DATE), lower(to_base(i, 36, 6)), true FROM free, m WHERE k < n""")
def d8_continued_sequences(spark, sf_dir):
    """Dense, unique integer, date and short text keys go on after those that one customer in ten gives."""
    key = F.col("c_custkey")
    held = one(spark, sf_dir, "customer").filter("c_custkey % 10 = 1").select(key.alias("id"), (key * 3).alias("code"), F.date_add(F.lit("2001-01-01").cast("date"), (key % 700).cast("int")).alias("day"), F.lpad(F.lower(F.conv((key * 5).cast("string"), 10, 36)), 6, "0").alias("short"))
    spec = {"item": {"id": KEY, "code": {"type": "bigint", "unique": True}, "day": {"type": "date", "unique": True}, "short": {"type": "varchar", "ddl_type": "varchar(6)", "unique": True}}}
    return with_held(held, made(spark, spec, "item", held.count(), {"item": held}))


@query("SELECT c_custkey AS owner_id, c_custkey % 4 <> 0 AS is_new FROM customer")
def d7_refilled_one_to_one(spark, sf_dir):
    """A quarter of the customers have a row; more are asked for than there are customers left, so each gets one."""
    customer = one(spark, sf_dir, "customer").select("c_custkey")
    held = customer.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("owner_id"))
    spec = {"customer": {"c_custkey": KEY}, "badge": {"id": KEY, "owner_id": {"type": "bigint", "fk": "customer.c_custkey", "unique": True}}}
    return with_held(held, made(spark, spec, "badge", customer.count(), {"customer": customer, "badge": held})).drop("id")


@query("SELECT c_custkey AS owner_id FROM customer")
def d11_top_up_of_bounded_keys(spark, sf_dir):
    """A one-to-one child, topped up beyond the number of its parents: each parent has one row, none has two."""
    customer = one(spark, sf_dir, "customer").select("c_custkey")
    n = customer.count()
    spec = {"customer": {"c_custkey": KEY}, "card": {"owner_id": {"type": "bigint", "fk": "customer.c_custkey", "pk": True}, "kind": {"type": "text", "generator": "randomstring(a,b)"}}}
    return made(spark, spec, "card", max(1, n // 2), {"customer": customer}, min_enum_rows=n).select("owner_id")


@query("SELECT 'offer' AS \"table\", parts * suppliers * 2 AS requested, parts * suppliers AS generated FROM (SELECT (SELECT count(*) FROM region) AS parts, (SELECT count(*) FROM nation) AS suppliers)")
def d15_capacity_warning(spark, sf_dir):
    t = load(spark, sf_dir, "region", "nation")
    n = t["region"].count() * t["nation"].count()
    spec = {"region": {"r_regionkey": {"type": "int", "pk": True}}, "nation": {"n_nationkey": {"type": "int", "pk": True}}, "offer": {"a": {"type": "int", "fk": "nation.n_nationkey", "pk": True}, "b": {"type": "int", "fk": "region.r_regionkey", "pk": True}}}
    found = synth.synthesize(spark, SchemaSpec.of(spec), rows=2 * n, targets=["offer"], existing=t)
    return found.warnings.select("table", "requested", "generated")


@query(f"SELECT n AS rows, n AS same, CAST(0 AS BIGINT) AS same_under_another_seed FROM {N_SQL}")
def d16_same_seed_same_rows(spark, sf_dir):
    """Two runs of one seed over differently dealt parents agree in every row; another seed gives other uuids."""
    customer = one(spark, sf_dir, "customer").select("c_custkey")
    n = customer.count()
    spec = SchemaSpec.of({"customer": {"c_custkey": KEY}, "note": {"id": {"type": "uuid", "pk": True}, "owner": {"type": "bigint", "fk": "customer.c_custkey"}, "text": {"type": "text", "generator": "sentence"}}})
    a, b, c = (synth.synthesize(spark, spec, rows=n, targets=["note"], existing={"customer": customer.repartition(parts)}, seed=seed).tables["note"] for parts, seed in ((1, 5), (7, 5), (3, 6)))
    same, other = a.join(b, ["id", "owner", "text"], "left_semi").agg(F.count("*").alias("same")), a.join(c, "id", "left_semi").agg(F.count("*").alias("same_under_another_seed"))
    return a.agg(F.count("*").alias("rows")).withColumn("k", F.lit(1)).join(same.withColumn("k", F.lit(1)), "k").join(other.withColumn("k", F.lit(1)), "k").drop("k")


@query(f"SELECT i + 1 AS id, CAST(NULL AS BIGINT) AS head_id, {h('department', 'head_id', 'i')} % n + 1 AS filled_head_id FROM (SELECT unnest(range(n)) AS i, n FROM {N_SQL})")
def d17_near_cycles(spark, sf_dir):
    """Departments have an optional head among employees, who come later: null, or filled where that is asked for."""
    n = one(spark, sf_dir, "customer").count()
    spec = SchemaSpec.of({"department": {"id": KEY, "head_id": {"type": "bigint", "fk": "employee.id", "nullable": True}}, "employee": {"id": KEY, "department_id": {"type": "bigint", "fk": "department.id"}}})
    plain = synth.synthesize(spark, spec, rows=n, seed=SEED, hash_kind="md5").tables["department"]
    filled = synth.synthesize(spark, spec, rows=n, seed=SEED, hash_kind="md5", fill_near_cycles=True).tables["department"]
    return plain.join(filled.select("id", F.col("head_id").alias("filled_head_id")), "id")


@query(f"SELECT 'tag' AS \"table\", 1 AS position, n FROM {N_SQL} UNION ALL SELECT 'note', 2, n FROM {N_SQL}")
def o9_selection_taken_literally(spark, sf_dir):
    """Without ordering, the tables come as they were named and no parents are added."""
    n = one(spark, sf_dir, "customer").count()
    spec = SchemaSpec.of({"owner": {"id": KEY}, "note": {"id": KEY, "owner_id": {"type": "bigint", "fk": "owner.id", "nullable": True}}, "tag": {"id": KEY}})
    found = synth.synthesize(spark, spec, rows=n, targets=["tag", "note"], order="none")
    counts = [found.tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(i).alias("position"), "n") for i, t in enumerate(found.order, 1)]
    return counts[0].unionByName(counts[1])


#: Types of few values, what a customer's number gives of them, and the same in SQL; the values in their order as SQL has them.
NARROW = {
    "smallint": ("smallint", "id", "id", "SELECT i AS v, i AS k FROM range(1, 32768) AS r(i)"),
    "numeric": ("numeric(3,0)", "id % 300 - 150", "id % 300 - 150", "SELECT i AS v, CASE WHEN i > 0 THEN i ELSE 1000 - i END AS k FROM range(-999, 1000) AS r(i)"),
    "tenths": ("numeric(3,1)", "cast(id % 300 AS decimal(5,0)) / 10", "CAST(id % 300 AS DECIMAL(5,1)) / 10", "SELECT CAST(i / 10.0 AS DECIMAL(3,1)) AS v, CASE WHEN i > 0 AND i % 10 = 0 THEN i // 10 WHEN i > 0 THEN 1000 + i ELSE 3000 - i END AS k FROM range(-999, 1000) AS r(i)"),
    "boolean": ("boolean", "true", "true", "SELECT * FROM (VALUES (false, 0), (true, 1)) AS b(v, k)"),
}


def narrow_sql() -> str:
    parts = []
    for name, (kind, _, value, domain) in NARROW.items():
        held = f"SELECT DISTINCT CAST({value} AS {kind}) AS v FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey <= 600)"
        n = "(SELECT least(count(*), 600) FROM customer)" if name != "boolean" else "1"
        parts.append(f"SELECT '{name}' AS kind, 'held' AS part, CAST(v AS VARCHAR) AS value FROM ({held})")
        parts.append(f"SELECT '{name}', 'more', CAST(v AS VARCHAR) FROM (SELECT v, row_number() OVER (ORDER BY k) AS place FROM ({domain}) WHERE v NOT IN ({held})) WHERE place <= {n}")
        parts.append(f"SELECT '{name}', 'fresh', CAST(v AS VARCHAR) FROM (SELECT v, row_number() OVER (ORDER BY k) AS place FROM ({domain})) WHERE place <= {n}")
    return " UNION ALL ".join(parts)


@query(narrow_sql())
def d8_bounded_numeric_keys(spark, sf_dir):
    """Keys of small types: those that customers give, as many more that these leave free, and as many of an empty table."""
    customer = one(spark, sf_dir, "customer").filter("c_custkey <= 600").select(F.col("c_custkey").alias("id"))
    n, parts = min(customer.count(), 600), []
    for name, (kind, value, _, _) in NARROW.items():
        spec = {name: {"k": {"type": kind.partition("(")[0], "ddl_type": kind, "pk": True}}}
        held = customer.select(F.expr(f"cast({value} AS {kind})").alias("k")).distinct()
        rows = 1 if name == "boolean" else n
        for part, df in (("held", held), ("more", made(spark, spec, name, rows, {name: held})), ("fresh", made(spark, spec, name, rows, {}))):
            parts.append(df.select(F.lit(name).alias("kind"), F.lit(part).alias("part"), F.col("k").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


HELD_DAYS = "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + 2922 AS DATE) AS day FROM orders"
FREE_DAYS = f"SELECT day, row_number() OVER (ORDER BY day) - 1 AS k FROM (SELECT CAST(DATE '2000-01-01' + CAST(i AS INT) AS DATE) AS day FROM range({DAYS}) AS r(i)) WHERE day NOT IN ({HELD_DAYS})"


def held_days(spark, sf_dir) -> DataFrame:
    return one(spark, sf_dir, "orders").select(F.date_add(F.col("o_orderdate").cast("date"), 2922).alias("day")).distinct()


@query(f"WITH free AS (SELECT * FROM ({FREE_DAYS}) WHERE k < 2000) SELECT f.day, p.day AS after, coalesce(p.day, f.day) AS hard_after FROM free f LEFT JOIN free p ON f.k > 0 AND p.k = least(f.k - 1, 1)")
def d9_refilled_self_references(spark, sf_dir):
    """A table keyed by days that holds rows: the new ones refer to days among themselves, which only then are known."""
    day = {"type": "date", "pk": True}
    held = held_days(spark, sf_dir)
    spec = {"shift": {"day": day, "after": {"type": "date", "fk": "shift.day", "nullable": True}, "hard_after": {"type": "date", "fk": "shift.day"}}}
    return made(spark, spec, "shift", 2000, {"shift": held.select("day", F.lit(None).cast("date").alias("after"), F.col("day").alias("hard_after"))})


SPREAD = f"({synth.MULTIPLIER % DAYS} * CAST(j AS HUGEINT) + {SEED}) % {DAYS}"


@query(f"""WITH t AS (SELECT i, {h('team', 'next_day', 'i')} % n AS j FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT least(count(*), 5000) AS n FROM customer)))
SELECT i + 1 AS id, CAST(NULL AS DATE) AS next_day, CAST(DATE '2000-01-01' + CAST({SPREAD} AS INT) AS DATE) AS filled_next_day FROM t""")
def d17_near_cycle_to_days(spark, sf_dir):
    """Teams have an optional day among shifts, which refer to teams, come later and are keyed by days: null, or filled once the shifts are there."""
    n = min(one(spark, sf_dir, "customer").count(), 5000)
    spec = SchemaSpec.of({"team": {"id": KEY, "next_day": {"type": "date", "fk": "shift.day", "nullable": True}}, "shift": {"day": {"type": "date", "pk": True}, "team_id": {"type": "bigint", "fk": "team.id"}}})
    plain, filled = (synth.synthesize(spark, spec, rows=n, seed=SEED, hash_kind="md5", fill_near_cycles=fill).tables for fill in (False, True))
    return plain["team"].join(filled["team"].select("id", F.col("next_day").alias("filled_next_day")), "id")


LINE = "line"


@query(f"SELECT i + 1 AS id, CAST(NULL AS VARCHAR) AS nothing, {pick_sql(h(LINE, 'odd', 'i'), G.WORDS)} AS odd, CAST(1 + {h(LINE, 'digits', 'i')} % 100000 AS VARCHAR) AS digits, left(CAST(1 + {h(LINE, 'cut', 'i')} % 100000 AS VARCHAR), 3) AS cut FROM (SELECT unnest(range(n)) AS i FROM {N_SQL})")
def g26_g27_g29_texts(spark, sf_dir):
    """No generator gives null, an unknown one a word; numbers become text, cut to the column's length."""
    text = {"type": "text"}
    spec = {LINE: {"id": KEY, "nothing": text | {"generator": ""}, "odd": text | {"generator": "unheard_of"}, "digits": text | {"generator": "number(1,100000)"}, "cut": {"type": "varchar", "ddl_type": "varchar(3)", "generator": "number(1,100000)"}}}
    return made(spark, spec, LINE, one(spark, sf_dir, "customer").count(), {})




@query(f"SELECT o_orderkey, {pick_sql(ht('f'), G.FIRST)} AS f, {pick_sql(ht('l'), G.LAST)} AS l, CAST({ht('u')} AS DOUBLE) / 1152921504606846976.0 AS u, CAST(CAST({ht('lo')} % 360000001 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) - 180 AS DECIMAL(13,6)) AS lo FROM orders")
def g5_g9_g20_names_fractions_longitudes(spark, sf_dir):
    return generated(spark, sf_dir, {"f": "firstname", "l": "lastname", "u": "float64", "lo": "longitude"}).withColumn("lo", F.col("lo").cast("decimal(13,6)"))
