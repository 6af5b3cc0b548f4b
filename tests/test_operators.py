import datetime as dt
import random
from itertools import combinations, permutations, product

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.functions.hashing import Cells
from tablesmith.operators import assign, checks, depgraph, domains, gaps, inclusions, keys, profile, sketches, synth
from tablesmith.sources import sinks
from tablesmith.sources import tables as src
from tablesmith.spec import ColumnSpec, SchemaSpec


def spec(**tables):
    return SchemaSpec.of({t: dict(c) for t, c in tables.items()})


ID = {"type": "bigint", "pk": True}


def ref(target, **more):
    return {"type": "bigint", "fk": target, **more}


ASSIGNED = [
    ("decimal", "decimal(20,0)", "x", {}, "number(1,100000)"), ("decimal", "decimal(4,0)", "x", {}, "number(1,9999)"), ("decimal", "decimal(10,2)", "x", {}, "price(1,1000)"), ("numeric", "numeric(3,2)", "x", {}, "price(1,9)"),
    ("numeric", "numeric(5,2)", "x", {}, "price(1,999)"), ("numeric", "numeric(4,1)", "x", {}, "price(1,999)"), ("numeric", "numeric(2,2)", "x", {}, "price(0,0.99)"), ("bigint", None, "x", {"unique": True}, "sequence"),
    ("date", None, "x", {"unique": True}, "sequence"), ("varchar", "varchar(50)", "x", {"unique": True}, "uuid"), ("money", None, "x", {}, "price(1,10000)"), ("varchar", None, "job_title", {}, "sentence"), ("varchar", None, "home_url", {}, "url"),
    ("boolean", None, "email", {}, "bool"), ("date", None, "total", {}, "date"), ("int", None, "id", {"pk": True}, ""), ("text", None, "s", {"enum_values": ["a", "b"]}, "randomstring(a,b)"), ("int", None, "s", {"check_min": 1, "check_max": 5}, "number(1,5)"),
    ("varchar", None, "s", {"check_values": ["x", "y"]}, "randomstring(x,y)"), ("int", None, "thing", {}, "number(1,10000)"), ("inet", None, "thing", {}, "ipv4"), ("bytea", None, "thing", {}, "word"),
]


def test_assignment_rules(spark):
    blank = {"pk": None, "unique": None, "enum_values": None, "check_values": None, "check_min": None, "check_max": None}
    rows = [(i, "t", name, kind, ddl, *{**blank, **more}.values()) for i, (kind, ddl, name, more, _) in enumerate(ASSIGNED)]
    catalog = spark.createDataFrame(rows, "i int, table string, column string, type string, ddl_type string, pk boolean, unique boolean, enum_values array<string>, check_values array<string>, check_min long, check_max long")
    got = {r.i: r.generator for r in assign.assign_generators(catalog).collect()}
    assert [got[i] for i in range(len(ASSIGNED))] == [a[-1] for a in ASSIGNED]
    mysql = spark.createDataFrame([("t", "a", "int", "mysql"), ("t", "b", "year", "mysql"), ("t", "c", "tinyint", "mysql"), ("t", "d", "bigint", "mysql")], "table string, column string, type string, dialect string")
    assert [r.generator for r in assign.assign_generators(mysql, {("t", "a"): "age"}).orderBy("column").collect()] == ["age", "number(2000,2025)", "bool", "number(1,100000)"]


def test_generator_strings(spark):
    texts = ["email", "number(1,2)", "number(1)", "price(0,0.99)", "paragraph", "paragraph(2)", "randomstring(a (b),c)", "randomstring()", "nothing", "float64(1,2)", "sequence", "email(1)", "", " word "]
    want = [True, True, True, True, False, True, True, True, False, True, True, False, True, True]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, g string").select("i", assign.recognized(F.col("g")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == want
    assert [G.valid(t) for t in texts] == want


def test_check_clauses(spark):
    clauses = {
        "CHECK ((status = ANY (ARRAY['pending'::character varying, 'active'::character varying])))": (["pending", "active"], None, None),
        "CHECK (((spice_level >= 0) AND (spice_level <= 5)))": ([], 0, 5),
        "(score between 1 and 10)": ([], 1, 10),
        "(x between -5 and -1)": ([], -5, -1),
        "CHECK ((price > 0))": ([], None, None),
        "(`role` in (_utf8mb4\\'admin\\',_utf8mb4\\'user\\'))": (["admin", "user"], None, None),
    }
    got = profile.parse_checks(spark.createDataFrame([(c,) for c in clauses], "clause string")).collect()
    assert {r.clause: (r.check_values, r.check_min, r.check_max) for r in got} == clauses


def test_every_generator_gives_values(spark):
    for kind in ("xxhash64", "md5"):
        names = [*G.BARE, "paragraph(2)", "number(3,3)", "price(1,9)", "randomstring(a,b)", "unheard_of"]
        row = spark.range(40).select(*[G.generate(g, Cells(1, "t", f"c{i}", F.col("id"), kind)).alias(f"c{i}") for i, g in enumerate(names)]).collect()
        assert all(v is not None for r in row for v in r)
    assert spark.range(3).select(G.generate("", Cells(1, "t", "c", F.col("id"))).alias("c")).filter("c IS NULL").count() == 3
    G.register_generator("doubled", lambda cells, args: cells.row * int(args[0]))
    assert [r.c for r in spark.range(3).select(G.generate("doubled(2)", Cells(1, "t", "c", F.col("id"))).alias("c")).collect()] == [0, 2, 4]


def test_results_do_not_depend_on_partitions_but_on_the_seed(spark):
    s = spec(a={"id": ID, "x": {"type": "int", "generator": "number(1,1000000)"}, "u": {"type": "uuid", "generator": "uuid"}})
    def make(seed, parts):
        cells = {c: Cells(seed, "a", c, F.col("id")) for c in ("x", "u")}
        return sorted(tuple(r) for r in spark.range(0, 3000, 1, parts).select("id", *[G.generate(s.tables["a"][c].generator, cells[c]).alias(c) for c in cells]).collect())
    assert make(1, 1) == make(1, 3) == make(1, 8) != make(2, 3)


def test_order_cycles_and_missing_tables(spark):
    near = spec(a={"id": ID, "b_id": ref("b.id", nullable=True)}, b={"id": ID, "a_id": ref("a.id")}, c={"id": ID, "c_id": ref("c.id")})
    assert depgraph.order_tables(near, spark) == ["a", "b", "c"] or depgraph.order_tables(near, spark) == ["a", "c", "b"]
    cycle = spec(a={"id": ID, "b_id": ref("b.id")}, b={"id": ID, "a_id": ref("a.id")}, z={"id": ID, "a_id": ref("a.id")}, y={"id": ID})
    with pytest.raises(ValueError, match="cycle among: a, b, z"):
        depgraph.order_tables(cycle, spark)
    with pytest.raises(ValueError, match="missing table: q"):
        depgraph.order_tables(spec(a={"id": ID, "q_id": ref("q.id")}), spark)
    nodes = spark.createDataFrame([(t,) for t in cycle.tables], "table string")
    assert [r["table"] for r in depgraph.cycle_report(depgraph.levels(nodes, depgraph.hard_edges(cycle.edges(spark)))).collect()] == ["a", "b", "z"]
    made = synth.synthesize(spark, near, rows=4)
    assert made.tables["a"].filter("b_id IS NULL").count() == 4
    filled = synth.synthesize(spark, near, rows=4, order="none", targets=["b", "a"], fill_near_cycles=True, table_rows={"a": 4}, existing={"a": spark.createDataFrame([(9, None)], "id long, b_id long")})
    assert {r.a_id for r in filled.tables["b"].collect()} <= {9}


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns).collect()]


def test_junctions_and_one_to_one(spark):
    links = {"a_id": ref("a.id", pk=True), "b_id": ref("b.id", pk=True)}
    s = spec(a={"id": ID}, b={"id": ID}, links=links)
    made = synth.synthesize(spark, s, rows=3)
    assert len(set(rows_of(made.tables["links"], "a_id", "b_id"))) == 3 and made.warnings.count() == 0
    capped = synth.synthesize(spark, s, rows=2, table_rows={"links": 10})
    assert capped.tables["links"].distinct().count() == 4
    assert [tuple(r)[:3] for r in capped.warnings.collect()] == [("links", 10, 4)]
    child = synth.synthesize(spark, spec(parent={"id": ID}, child={"parent_id": ref("parent.id", pk=True), "name": {"type": "text", "generator": "word"}}), rows=2, table_rows={"child": 5})
    assert child.tables["child"].count() == 2 and child.warnings.count() == 1


def test_composite_temporal_keys_and_exhaustion(spark):
    s = spec(sources={"id": ID}, snapshots={"source_id": ref("sources.id", pk=True), "snapshot_day": {"type": "date", "pk": True}, "total": {"type": "int", "generator": "number(1,9)"}})
    made = synth.synthesize(spark, s, rows=150, table_rows={"sources": 5})
    assert checks.duplicates(made.tables["snapshots"], "source_id", "snapshot_day").count() == 0 and made.tables["snapshots"].count() == 150
    small = dict(end_date=dt.date(2000, 1, 2), rows=5)
    with pytest.raises(ValueError, match="exhausted"):
        synth.synthesize(spark, s, table_rows={"sources": 2, "snapshots": 5}, **small)
    logs = synth.synthesize(spark, spec(log={"day": {"type": "date", "pk": True}}, mark={"at": {"type": "time", "pk": True}}, event={"at": {"type": "timestamp", "pk": True}}), rows=400)
    for t, c in (("log", "day"), ("mark", "at"), ("event", "at")):
        assert checks.duplicates(logs.tables[t], c).count() == 0 and logs.tables[t].count() == 400


def test_sequences_uuids_and_lengths(spark):
    s = spec(
        orders={"id": ID, "external_id": {"type": "bigint", "unique": True}, "day": {"type": "date", "unique": True}, "at": {"type": "timestamp", "unique": True}, "code": {"type": "varchar", "ddl_type": "varchar(8)", "unique": True}},
        parents={"id": {"type": "uuid", "pk": True}}, children={"id": ID, "parent_id": {"type": "uuid", "fk": "parents.id"}, "name": {"type": "varchar", "ddl_type": "varchar(4)", "generator": "sentence"}},
    )
    made = synth.synthesize(spark, s, rows=5000).tables
    for c in ("external_id", "day", "at", "code"):
        assert checks.duplicates(made["orders"], c).count() == 0, c
    assert checks.orphans(made["children"], "parent_id", made["parents"], "id").count() == 0
    assert checks.too_long(made["children"], "name", 4).count() == 0 == checks.too_long(made["orders"], "code", 8).count()
    assert checks.malformed(made["parents"], "id", "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").count() == 0


@pytest.mark.parametrize(("n", "depth"), [(1, 2), (3, 2), (5, 2), (9, 4), (4, 0)])
def test_self_references(spark, n, depth):
    for nullable in (True, False):
        made = synth.synthesize(spark, spec(t={"id": ID, "up": ref("t.id", nullable=nullable)}), rows=n, self_ref_depth=depth).tables["t"]
        level, want = [], []
        for i in range(n):  # the nearest row before that is not at the deepest level
            up = next((j for j in range(i - 1, -1, -1) if level[j] < depth), None) if depth else None
            level.append(0 if up is None else level[up] + 1)
            want.append((i + 1, (up + 1) if up is not None else (None if nullable else i + 1)))
        assert rows_of(made, "id", "up") == want
        assert checks.depth_violations(made, "id", "up", depth).count() == 0 and checks.roots(made, "up", "id").count() > 0
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 3)], "id long, up long")
    assert rows_of(checks.depth_violations(loop, "id", "up", 5), "id") == [(1,), (2,)]


def test_enum_coverage(spark):
    s = spec(t={"id": ID, "status": {"type": "text", "generator": "randomstring(pending, active,closed)"}}, u={"id": ID, "status": {"type": "text", "generator": "randomstring(open,closed)"}, "priority": {"type": "text", "generator": "randomstring(low,high)"}})
    made = synth.synthesize(spark, s, rows=2, min_enum_rows=3).tables
    assert checks.undercovered(made["t"], "status", ["pending", "active", "closed"], 3).count() == 0
    assert checks.duplicates(made["t"], "id").count() == 0
    assert checks.undercovered(made["u"], "priority", ["low", "high"], 3).count() == 0 == checks.undercovered(made["u"], "status", ["open", "closed"], 3).count()
    each = synth.synthesize(spark, s, rows=2, enum_rows=50, table_rows={"u": 7}).tables
    assert [tuple(r) for r in each["t"].groupBy("status").count().orderBy("status").collect()] == [("active", 50), ("closed", 50), ("pending", 50)]
    assert each["u"].count() == 7


def test_generated_and_pinned_columns(spark):
    s = spec(o={"id": ID, "a": {"type": "int", "generator": "number(1,5)"}, "total": {"type": "int", "generated": "a * 2"}, "hidden": {"type": "int", "generated": True}})
    made = synth.synthesize(spark, s, rows=20, overrides={"o": {"a": F.col("_row") + 100}}).tables["o"]
    assert made.columns == ["id", "a", "total"] and made.filter("total <> a * 2 OR a < 100").count() == 0


def test_fill_continues_existing_keys_and_leaves_no_gap(spark):
    s = spec(parent={"id": ID}, child={"id": ID, "parent_id": ref("parent.id")}, grand={"child_id": ref("child.id", unique=True), "id": ID})
    held = {"parent": spark.createDataFrame([(5,), (70,)], "id long"), "child": spark.createDataFrame([], "id long, parent_id long"), "grand": spark.createDataFrame([], "child_id long, id long")}
    made = gaps.fill_gaps(spark, s, held, rows=30)
    assert set(made.tables) == {"child", "grand"}
    assert {r.parent_id for r in made.tables["child"].collect()} == {5, 70}
    assert checks.duplicates(made.tables["grand"], "child_id").count() == 0
    assert checks.gaps_left({**held, **made.tables}).count() == 0
    more = synth.synthesize(spark, s, rows=4, targets=["parent", "child"], existing={"parent": held["parent"]}).tables
    assert rows_of(more["parent"], "id") == [(71,), (72,), (73,), (74,)]
    assert checks.orphans(more["child"], "parent_id", more["parent"].unionByName(held["parent"]), "id").count() == 0
    assert gaps.fill_gaps(spark, s, {"parent": held["parent"]}).tables == {}


def test_checks_report_damage(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, None, 50.0), (None, "zz", None)], "k long, s string, v double")
    assert checks.duplicates(df, "k").count() == 1 and checks.nulls(df, "k", "s").count() == 2
    assert checks.out_of_range(df, "v", 0, 10).count() == 1 and checks.outside_domain(df, "s", ["a"]).count() == 1
    assert checks.outside_domain(df, "s", spark.createDataFrame([("a",)], "x string")).count() == 1
    assert checks.too_long(df, "s", 1).count() == 1 and checks.malformed(df, "s", "^a$").count() == 1
    assert checks.unexpected_counts({"t": df}, {"t": 3}).count() == 0 and checks.unexpected_counts({"t": df}, {"t": "empty"}).count() == 1


def test_profile_of_keys(spark):
    df = spark.createDataFrame([(i, i // 2, i % 2, "x" * (i % 3 + 1)) for i in range(20)], "id long, a long, b long, s string")
    assert keys.key_candidates(df) == [("id",), ("a", "b"), ("a", "s")]
    assert keys.unique_columns(df, ("id",)) == []
    got = {r["column"]: r for r in profile.profile_table(df, "t").collect()}
    assert got["id"].is_sequence and got["id"].is_unique and got["s"].longest == 3 and got["b"].is_enum and not got["a"].is_sequence
    parents = spark.createDataFrame([(i,) for i in range(10)], "p_id long")
    child = spark.createDataFrame([(i % 10,) for i in range(50)] + [(None,)], "c_id long")
    edge = inclusions.foreign_keys({"parent": parents, "child": child}).collect()
    assert [(e.child, e["column"], e.parent, e.coverage) for e in edge] == [("child", "c_id", "parent", 1.0)]


def test_sinks(spark, tmp_path):
    s = spec(b={"id": ID, "a_id": ref("a.id")}, a={"id": ID, "name": {"type": "text", "generator": "word"}})
    made = synth.synthesize(spark, s, rows=6)
    assert sinks.write_tables(made.tables, made.order, str(tmp_path / "p")) == ["a", "b"]
    back = src.load_tables(spark, str(tmp_path / "p"), ["a", "b"])
    assert all(back[t].exceptAll(made.tables[t]).count() == 0 and back[t].count() == 6 for t in back)
    for fmt in ("json", "csv", "sql"):
        sinks.write_text(made.tables, str(tmp_path / fmt), fmt)
    assert src.load_export(spark, str(tmp_path / "csv/a"), "csv").columns == ["_table", "id", "name"]
    assert src.load_export(spark, str(tmp_path / "json/b"), "json").count() == 6
    assert spark.read.text(str(tmp_path / "sql/a")).filter("value LIKE 'INSERT INTO \"a\" (\"id\", \"name\") VALUES (%'").count() == 6
    spark.sql("CREATE DATABASE IF NOT EXISTS one")
    sinks.write_tables(made.tables, made.order, "one", "table")
    assert sinks.clone_structure(spark, "one", "two", made.order, s, drop=True) == ["a", "b"]
    assert spark.table("two.b").count() == 0 and spark.table("two.a").dtypes == spark.table("one.a").dtypes
    assert any(r["key"] == "fk.a_id" and r["value"] == "a.id" for r in spark.sql("SHOW TBLPROPERTIES two.b").collect())
    with pytest.raises(ValueError, match="already has"):
        sinks.clone_structure(spark, "one", "two", made.order)
    seen = []
    assert sinks.truncate_tables(spark, made.order, "one", seen.append) == ["b", "a"] == seen
    assert checks.unexpected_counts({t: spark.table(f"one.{t}") for t in made.order}, {"a": "empty", "b": "empty"}).count() == 0
    assert gaps.dry_run({"a": made.tables["a"]}, {"a": "id"}).first()["n"] == 6


def test_spec_round_trip():
    s = spec(a={"id": ID, "n": {"type": "numeric", "ddl_type": "numeric(5,2)"}, "c": {"type": "varchar", "ddl_type": "character varying(7)"}})
    again = SchemaSpec.of(s.json())
    assert again == s and again.tables["a"]["n"].precision() == (5, 2) and again.tables["a"]["c"].length() == 7
    assert ColumnSpec("bigint", fk="a.b.c").parent == ("a", "b.c") and ColumnSpec("bigint", fk="a").parent is None


def test_preload_reads_referenced_parents_only(spark):
    s = spec(a={"id": ID}, b={"id": ID, "a_id": ref("a.id")}, c={"id": ID})
    tables = {t: spark.createDataFrame([(1,)], "id long") for t in ("a", "c")}
    assert list(src.preload_keys(tables, s, ["b"])) == [("a", "id")]
    index = src.dense_index(spark.createDataFrame([(x,) for x in (9, 3, 3, 7)], "key long")).orderBy("idx").collect()
    assert [(r.idx, r.key) for r in index] == [(0, 3), (1, 7), (2, 9)]


REFILLS = [
    ("pairs", {"a": {"id": ID}, "b": {"id": ID}, "pairs": {"a_id": ref("a.id", pk=True), "b_id": ref("b.id", pk=True)}}, 3, 3),
    ("day", {"day": {"at": {"type": "date", "pk": True}}}, 5, 5),
    ("bell", {"bell": {"at": {"type": "time", "pk": True}}}, 5, 5),
    ("moment", {"moment": {"at": {"type": "timestamp", "pk": True}}}, 5, 5),
    ("snap", {"a": {"id": ID}, "snap": {"a_id": ref("a.id", pk=True), "day": {"type": "date", "pk": True}}}, 4, 4),
    ("short", {"short": {"k": {"type": "varchar", "ddl_type": "varchar(2)", "pk": True}}}, 300, 300),
    ("badge", {"a": {"id": ID}, "badge": {"id": ID, "a_id": ref("a.id", unique=True)}}, 2, 2),
    ("mixed", {"mixed": {"id": {"type": "uuid", "pk": True}, "d": {"type": "date", "unique": True}, "t": {"type": "timestamp", "unique": True}, "c": {"type": "time", "unique": True}, "x": {"type": "varchar", "ddl_type": "varchar(8)", "unique": True}, "m": {"type": "numeric", "ddl_type": "numeric(10,2)", "unique": True}, "e": {"type": "text", "unique": True}}}, 5, 5),
]


@pytest.mark.parametrize("table, columns, rows, more", REFILLS, ids=[r[0] for r in REFILLS])
def test_a_filled_table_goes_on_without_repeated_keys(spark, table, columns, rows, more):
    s = spec(**columns)
    held = {"a": spark.range(3, 12), "b": spark.range(7, 9)}
    for k in range(3):
        made = synth.synthesize(spark, s, rows=rows if k == 0 else more, targets=[table], existing=held).tables[table]
        held[table] = src.cut_lineage(made if table not in held else held[table].unionByName(made))
        assert held[table].count() == rows + k * more
        keys = [s.keys(table), *[[c] for c, v in s.tables[table].items() if v.unique]]
        assert all(checks.duplicates(held[table], *key).count() == 0 for key in keys if key)


def test_exhausted_domains(spark):
    two = spec(t={"k": {"type": "varchar", "ddl_type": "varchar(2)", "unique": True}})
    assert synth.synthesize(spark, two, rows=1296).tables["t"].distinct().count() == 1296
    with pytest.raises(ValueError, match="exhausted"):
        synth.synthesize(spark, two, rows=1297)
    clock = spec(t={"at": {"type": "time", "unique": True}})
    with pytest.raises(ValueError, match="exhausted"):
        synth.synthesize(spark, clock, rows=5, existing={"t": spark.createDataFrame([("23:59:57",)], "at string")})
    child = spec(p={"id": ID}, c={"p_id": ref("p.id", pk=True), "s": {"type": "text", "generator": "randomstring(a,b)"}})
    made = synth.synthesize(spark, child, rows=2, targets=["c"], existing={"p": spark.range(3)}, min_enum_rows=4)
    assert made.tables["c"].count() == made.tables["c"].select("p_id").distinct().count() == 3 and made.warnings.count() == 1


def test_children_of_a_refilled_table_refer_to_old_and_new_keys(spark):
    s = spec(day={"at": {"type": "date", "pk": True}}, visit={"id": ID, "at": {"type": "date", "fk": "day.at"}})
    held = spark.createDataFrame([("2000-01-01",), ("2000-01-03",)], "at string").selectExpr("cast(at as date) as at")
    made = synth.synthesize(spark, s, rows=40, table_rows={"day": 3}, existing={"day": held}).tables
    days = held.unionByName(made["day"])
    assert days.distinct().count() == 5 and checks.orphans(made["visit"], "at", days, "at").count() == 0
    assert made["visit"].select("at").distinct().count() == 5


def test_tables_go_to_a_database_and_back(spark):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = "jdbc:derby:memory:one;create=true"
    df = spark.range(50).selectExpr("id as k", "cast(id as string) as name")
    assert sinks.write_tables({"a": df}, ["a"], url, "jdbc", **options) == ["a"]
    back = src.load_jdbc(spark, url, ["a"], partitionColumn="k", lowerBound="0", upperBound="50", numPartitions="3", **options)["a"]
    assert back.rdd.getNumPartitions() == 3 and sorted((r[0], r[1]) for r in back.collect()) == [(i, str(i)) for i in range(50)]


def test_inclusions_against_sets(spark):
    rng = random.Random(8)
    tables, data = {}, {}
    for t in range(3):
        rows = [tuple(rng.choice([None, *range(rng.choice([3, 6, 9]))]) for _ in range(4)) + (rng.choice(["a", "b", "x" * 100, "x" * 101]),) for _ in range(rng.randint(1, 12))]
        names = [f"c{i}" for i in range(4)] + ["s"]
        data[f"t{t}"] = {c: [r[i] for r in rows] for i, c in enumerate(names)}
        tables[f"t{t}"] = spark.createDataFrame(rows, "c0 long, c1 int, c2 smallint, c3 long, s string").withColumn("c3", F.col("c3").cast("decimal(9,0)"))
    tables["empty"] = spark.createDataFrame([], "c0 long, s string")

    def of(t, columns):
        return [v for v in zip(*(data[t][c] for c in columns), strict=True) if None not in v]

    def unique(t, columns):
        n = len(data[t]["s"])
        return n > 0 and len(of(t, columns)) == n == len(set(of(t, columns)))

    kind = {"c0": 0, "c1": 0, "c2": 0, "c3": 0, "s": 1}
    want = set()
    for t, u in permutations(data, 2):
        for c, d in product(kind, kind):
            own = set(of(t, [c]))
            if kind[c] == kind[d] and own and own <= set(of(u, [d])):
                want.add((t, c, u, d, 1, len(own), 1.0, unique(u, [d])))
    assert set(map(tuple, inclusions.inclusions(tables).collect())) == want
    singles = {(t, c, u, d) for t, c, u, d, *_ in want}
    pairs = set()
    for t, u in permutations(data, 2):
        for (a, b), (c, d) in product(combinations(sorted(kind), 2), permutations(sorted(kind), 2)):
            own = set(of(t, [a, b]))
            if {(t, a, u, c), (t, b, u, d)} <= singles and own and own <= set(of(u, [c, d])) and unique(u, [c, d]) and not unique(u, [c]) and not unique(u, [d]):
                pairs.add((t, f"{a},{b}", u, f"{c},{d}", 2, len(own), 1.0, True))
    assert set(map(tuple, inclusions.composite_inclusions(tables).collect())) == pairs


def test_composite_inclusions_of_three_columns(spark):
    keys = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    parent = spark.createDataFrame([(*k, 0) for k in keys], "x long, y long, z long, w long")
    child = spark.createDataFrame([(*k, 7) for k in keys[::2]] + [(None, 1, 99, 7)], "p long, q long, r long, v long").filter("r < 99")
    [found] = [tuple(r) for r in inclusions.composite_inclusions({"parent": parent, "child": child}, 3).filter("child = 'child' AND ref_column = 'x,y,z'").collect()]
    assert found == ("child", "p,q,r", "parent", "x,y,z", 3, 14, 1.0, True)
    plan = inclusions.inclusions({"parent": parent, "child": child})
    assert {tuple(r)[:4] for r in plan.collect()} >= {("child", c, "parent", d) for c, d in product("pqr", "xyz")}


def domain_cases():
    c = lambda kind, **more: ColumnSpec(kind.partition("(")[0], kind, **more)
    return {
        "smallint": (c("smallint"), 65_536), "numeric(3,0)": (c("numeric(3,0)"), 1999), "numeric(3,1)": (c("numeric(3,1)"), 1999), "numeric(2,2)": (c("numeric(2,2)"), 199), "boolean": (c("boolean"), 2), "year": (c("year"), 255), "date": (c("date"), 9497), "time": (c("time"), 86_400),
        "char(2)": (c("char(2)"), 1296), "checked": (c("int", check_min=-3, check_max=9), 13), "listed": (c("text", check_values=["x", "y", "z"]), 3), "int": (c("int"), 1 << 32), "real": (c("real"), (1 << 25) + 1),
    }


@pytest.mark.parametrize("name", list(domain_cases()))
def test_domains_number_their_values(spark, name):
    c, size = domain_cases()[name]
    d = domains.of(c, G.END)
    assert d.size == size
    few = spark.range(min(size, 100_000)).select("id", d.value(F.col("id")).alias("raw")).withColumn("v", F.col("raw").cast(c.spark_type()))
    assert few.filter("v IS NULL").count() == 0 and few.select("v").distinct().count() == few.count()
    assert few.filter(~d.number(F.col("v")).eqNullSafe(F.col("id"))).count() == 0
    ends = spark.createDataFrame([(0,), (size - 1,)], "id long").select("id", d.value(F.col("id")).cast(c.spark_type()).alias("v"))
    assert ends.filter(d.number(F.col("v")) != F.col("id")).count() == 0


def test_narrow_keys(spark):
    s = spec(a={"k": {"type": "smallint", "pk": True}, "code": {"type": "numeric", "ddl_type": "numeric(3,0)", "unique": True}}, b={"on": {"type": "boolean", "pk": True}, "k": ref("a.k", pk=True, type="smallint")})
    made = synth.synthesize(spark, s, rows=1500, table_rows={"b": 3000}).tables
    assert made["a"].agg(F.min("k"), F.max("k"), F.count_distinct("k"), F.count_distinct("code"), F.min("code")).first() == (1, 1500, 1500, 1500, -500)
    assert checks.duplicates(made["b"], "k", "on").count() == 0 and made["b"].count() == 3000 and checks.orphans(made["b"], "k", made["a"], "k").count() == 0
    more = synth.synthesize(spark, s, rows=400, targets=["a"], existing={"a": made["a"]}).tables["a"]
    assert checks.duplicates(made["a"].unionByName(more), "k").count() == 0 == checks.duplicates(made["a"].unionByName(more), "code").count() and more.count() == 400
    child = synth.synthesize(spark, s, table_rows={"b": 50}, targets=["a", "b"], rows=100, existing={"a": made["a"]}).tables
    assert checks.orphans(child["b"], "k", made["a"].select("k").unionByName(child["a"].select("k")), "k").count() == 0
    with pytest.raises(ValueError, match="exhausted.*code of a has 499 values for 500"):
        synth.synthesize(spark, s, rows=500, targets=["a"], existing={"a": made["a"]})


def test_small_types_are_refused_before_any_job(spark):
    broken = spark.range(5).select(F.raise_error(F.lit("a job ran")).cast("smallint").alias("k"))
    for kind, rows in (("numeric(2,0)", 200), ("boolean", 3), ("smallint", 70_000), ("char(1)", 37), ("year", 256)):
        with pytest.raises(ValueError, match="exhausted"):
            synth.synthesize(spark, spec(t={"k": {"type": kind.partition("(")[0], "ddl_type": kind, "pk": True}}), rows=rows, existing={"t": broken})


def test_int_keys_go_back_when_they_reach_the_end(spark):
    held = spark.createDataFrame([(1,), (3,), (2_147_483_640,)], "id int")
    s = spec(t={"id": {"type": "int", "pk": True}})
    assert rows_of(synth.synthesize(spark, s, rows=4, existing={"t": held}).tables["t"], "id") == [(2_147_483_641 + i,) for i in range(4)]
    assert rows_of(synth.synthesize(spark, s, rows=9, existing={"t": held}).tables["t"], "id") == [(2,), *((i,) for i in range(4, 12))]


def test_deferred_references(spark):
    s = spec(day={"day": {"type": "date", "pk": True}, "up": {"type": "date", "fk": "day.day", "nullable": True}, "boss": {"type": "date", "fk": "day.day"}})
    held = spark.sql("SELECT date_add(DATE '2000-01-01', cast(id * 2 AS int)) AS day, cast(NULL AS date) AS up, DATE '2000-01-01' AS boss FROM range(30)")
    for depth in (0, 1, 3):
        made = synth.synthesize(spark, s, rows=50, existing={"day": held}, self_ref_depth=depth).tables["day"]
        assert made.count() == 50 and checks.duplicates(held.select("day").unionByName(made.select("day")), "day").count() == 0
        assert checks.orphans(made, "boss", made, "day").count() == 0 == checks.depth_violations(made, "day", "boss", depth).count() == checks.depth_violations(made, "day", "up", depth).count()
        assert made.filter("up IS NULL").count() == (50 if depth == 0 else 1)
    near = spec(dept={"id": ID, "head": {"type": "date", "fk": "emp.day", "nullable": True, "unique": True}}, emp={"day": {"type": "date", "pk": True}, "dept_id": ref("dept.id")})
    made = synth.synthesize(spark, near, rows=40, table_rows={"emp": 30}, fill_near_cycles=True).tables
    assert made["dept"].filter("head IS NOT NULL").count() == 30 == made["dept"].select("head").distinct().count() - 1 and checks.orphans(made["dept"], "head", made["emp"], "day").count() == 0
    assert synth.synthesize(spark, near, rows=40).tables["dept"].filter("head IS NOT NULL").count() == 0


def test_keys_against_all_sets(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = list({tuple(rng.randrange(k) for k in (2, 3, 3, 4, 2)) for _ in range(rng.randint(2, 40))})
        df = spark.createDataFrame([(*r, None if i % 2 else 1, "x" * 70 + str(r[0])) for i, r in enumerate(rows)], "a long, b int, c long, d string, e double, hole int, long string".replace("d string", "d int").replace("e double", "e long"))
        data = {c: [r[i] for r in rows] for i, c in enumerate("abcde")} | {"long": [r[0] for r in rows]}
        unique = {s for k in range(1, 7) for s in combinations(sorted(data), k) if len(set(zip(*(data[c] for c in s), strict=True))) == len(rows)}
        want = sorted((s for s in unique if not any(set(t) < set(s) for t in unique)), key=lambda s: (len(s), s))
        assert keys.key_candidates(df) == want
        assert keys.key_candidates(df, max_columns=2) == [s for s in want if len(s) <= 2]
    twice = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert keys.key_candidates(twice) == [] and keys.key_candidates(twice.limit(0)) == [] and keys.key_candidates(twice.limit(1)) == [("a",), ("b",)]
    assert keys.key_candidates(spark.range(3000).selectExpr("id % 50 AS a", "id % 60 AS b", "id div 300 AS c", "id % 7 AS d")) == [("a", "b", "c"), ("a", "c", "d"), ("b", "c", "d")]


def test_sketches_add_up(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 5).cast("string").alias("few"), (F.col("id") * 7 % 1000).cast("int").alias("some"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double") - 1000).alias("holes"), (F.col("id") % 3).cast("string").alias("part"))
    parts = [sketches.sketch_parts(df.filter(f"part = '{p}'"), "t", "part") for p in "012"]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = {r["column"]: r for r in sketches.profile_from(sketches.sketch_parts(df, "t", "part"), df).collect()}
    got = {r["column"]: r for r in sketches.profile_from(merged, df).collect()}
    exact = {side: {c: r if r.exact else tuple(r)[:5] + tuple(r)[6:] for c, r in found.items()} for side, found in (("got", got), ("whole", whole))}
    assert exact["got"] == exact["whole"] and all(abs(got[c].distinct_values - r.distinct_values) <= 0.03 * r.distinct_values for c, r in whole.items())
    assert set(got) == {"id", "few", "some", "holes"}
    assert got["id"].is_unique and got["few"].is_enum and got["few"].distinct_values == 5 and not got["some"].exact and abs(got["some"].distinct_values - 1000) < 50
    assert (got["holes"].rows, got["holes"].nulls, float(got["holes"].low), float(got["holes"].high)) == (3000, 750, -999.0, 1999.0) and (got["id"].low, got["id"].high) == ("0", "2999")
    assert sketches.new_parts(df, "part", parts[0].unionByName(parts[1])).select("part").distinct().collect() == [("2",)]
    assert sketches.profile_from(sketches.sketch_parts(df.limit(0), "t", "part"), df.limit(0)).count() == 0
