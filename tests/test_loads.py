import random

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import checks, depgraph, gaps, pages, synth
from tablesmith.sources import external, loads, sinks
from tablesmith.spec import SchemaSpec

ID = {"type": "bigint", "pk": True}


def test_levels_and_closure_of_random_graphs(spark):
    rng = random.Random(3)
    for n, more, cycles in ((12, 2, False), (40, 1, False), (30, 2, True), (60, 1, True)):
        edges = set()
        for v in range(1, n):
            for _ in range(rng.choice([0, 1, 1, 1, more])):
                edges.add((v, rng.randrange(max(0, v - 4), v)))
        if cycles:
            edges |= {(n // 2, n // 2 + 3), (n // 2 + 3, n // 2)}
        parents = {v: {p for c, p in edges if c == v} for v in range(n)}
        want, left = {}, dict(parents)
        while ready := [v for v, ps in left.items() if ps <= set(want)]:
            for v in ready:
                want[v] = 1 + max((want[p] for p in parents[v]), default=-1)
            left = {v: ps for v, ps in left.items() if v not in want}
        nodes = spark.createDataFrame([(f"t{v}",) for v in range(n)], "table string")
        frame = spark.createDataFrame([(f"t{c}", f"t{p}", False) for c, p in edges] or [("x", "x", False)], "child string, parent string, nullable boolean")
        assert {r.table: r.level for r in depgraph.levels(nodes, frame).collect()} == {f"t{v}": want.get(v) for v in range(n)}
        chosen = set(rng.sample(range(n), 4))
        closed, todo = set(chosen), list(chosen)
        while todo:
            for p in parents[todo.pop()] - closed:
                closed.add(p)
                todo.append(p)
        got = depgraph.close_selection(frame, spark.createDataFrame([(f"t{v}",) for v in chosen], "table string")).collect()
        assert {(r.table, r.auto_added) for r in got} == {(f"t{v}", v not in chosen) for v in closed} and len(got) == len(closed)


def test_depths(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1000), (1001, 1000), (2000, 2001), (2001, 2000), (2002, 2001), (3000, 9999), (None, None)]
    got = {r.id: (r.root, r.depth) for r in checks.depths(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()}
    assert all(got[i] == (0, i) for i in range(300))
    assert got[1001] == (1000, 1) and got[1000] == (1000, 0) and got[2000] == got[2001] == got[2002] == (None, None) and got[3000] == (9999, 1)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = depgraph.cut_lineage
    monkeypatch.setattr(depgraph, "cut_lineage", lambda df: rounds.append(1) or real(df))
    links = spark.range(100_000).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    assert checks.depths(links, "id", "up").agg(F.max("depth"), F.count("*")).first() == (99_999, 100_000) and len(rounds) < 25
    rounds.clear()
    text = links.select(F.col("id").cast("string").alias("table"), F.col("up").cast("string").alias("parent"))
    assert depgraph.levels(text.select("table"), text.filter("parent IS NOT NULL").select(F.col("table").alias("child"), "parent")).agg(F.max("level")).first()[0] == 99_999 and len(rounds) < 40


def test_resumed_loads(spark, tmp_path):
    spec = SchemaSpec.of({"a": {"id": ID}, "b": {"id": ID, "a_id": {"type": "bigint", "fk": "a.id"}}, "c": {"id": ID}, "d": {"id": ID, "b_id": {"type": "bigint", "fk": "b.id"}}})
    assert depgraph.spec_levels(spec) == [["a", "c"], ["b"], ["d"]]
    made, base = synth.synthesize(spark, spec, rows=30).tables, str(tmp_path / "x")
    assert loads.manifest(spark, base, "one").count() == 0
    broken = made | {"b": made["b"].withColumn("id", F.when(F.col("id") < 20, F.col("id")).otherwise(F.raise_error(F.lit("gone"))))}
    for _ in range(2):
        with pytest.raises(Exception, match="gone"):
            loads.load_spec(broken, spec, base, "one")
        assert sorted(r.table for r in loads.manifest(spark, base, "one").collect()) == ["a", "c"]
    for _ in range(2):
        assert sorted((r.table, r.level, r.rows) for r in loads.load_spec(made, spec, base, "one").collect()) == [("a", 0, 30), ("b", 1, 30), ("c", 0, 30), ("d", 2, 30)]
    assert all(loads.loaded(spark, base, t).exceptAll(df).count() == 0 and loads.loaded(spark, base, t).count() == 30 for t, df in made.items())
    loads.load_spec(made, spec, base, "two")  # another load adds its rows
    assert loads.loaded(spark, base, "d").count() == 60
    spark.sql(f"CREATE DATABASE loads_db LOCATION '{tmp_path / 'db'}'")
    with pytest.raises(Exception, match="gone"):
        loads.load_spec(broken, spec, "loads_db", "one", fmt="table", notes=base + "_notes")
    for load in ("one", "two", "one"):
        loads.load_spec(made, spec, "loads_db", load, fmt="table", notes=base + "_notes")
    assert loads.loaded(spark, "loads_db", "b", "table").count() == 60 == loads.loaded(spark, "loads_db", "b", "table").select("id").join(made["b"], "id").count()


def test_batches(spark):
    df = spark.createDataFrame([(i, "it's" if i % 2 else None) for i in range(25)], "b long, a string").coalesce(1)
    got = [r.statement for r in loads.insert_batches(df, "t", 10, "mysql").collect()]
    assert [g.count("), (") + 1 for g in got] == [10, 10, 5] and got[0].startswith("INSERT INTO `t` (`a`, `b`) VALUES (NULL, 0), ('it''s', 1), ") and got[2].endswith("(NULL, 24);")
    assert loads.insert_batches(df.limit(0), "t").count() == 0 and loads.insert_batches(df.repartition(4), "t", 1).count() == 25
    with pytest.raises(ValueError):
        loads.insert_batches(df, "t", 0)


def test_pages(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), (F.col("id") % 5).alias("g"))
    written = pages.write_pages(df, ["k"], str(tmp_path / "p"), 8)
    for offset, limit in ((0, 25), (899, 100), (990, 50), (1000, 10), (5000, 3), (-4, 1)):
        assert sorted(map(tuple, written.page(offset, limit).collect())) == sorted(map(tuple, gaps.preview(df, ["k"], limit, offset).collect()))
    late = written.page(900, 5)
    assert len({f.rsplit("/", 2)[1] for f in late.inputFiles()}) == 1 or "PartitionFilters: [isnotnull(_part" in late._jdf.queryExecution().executedPlan().toString()
    grouped = pages.write_pages(df, ["g", "k"], str(tmp_path / "g"), 4)
    assert [tuple(r) for r in grouped.page(195, 10).collect()] == [tuple(r) for r in gaps.preview(df, ["g", "k"], 10, 195).collect()]
    empty = pages.write_pages(df.limit(0), ["k"], str(tmp_path / "e"), 4)
    assert empty.page(0).count() == 0


def test_external_tables_are_split_evenly(spark):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    options, url = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "jdbc:derby:memory:split;create=true"
    skewed = spark.range(4000).selectExpr("cast(pow(id, 3) AS bigint) AS k", "concat('n', id) AS name", "date_add(DATE '2020-01-01', cast(id % 50 AS int)) AS day")
    one = spark.createDataFrame([(5, "x")], "k long, name string")
    sinks.write_tables({"a": skewed, "b": one, "c": one.limit(0)}, ["a", "b", "c"], url, "jdbc", **options)
    tables = external.load_split(spark, url, {"a": "k", "b": "k", "c": "k"}, 8, **options)
    sizes = [len(x) for x in tables["a"].rdd.glom().collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 1.2 * min(sizes)
    assert tables["a"].exceptAll(skewed).count() == 0 and tables["b"].count() == 1 and tables["c"].count() == 0
    plan = tables["a"].select("k")._jdf.queryExecution().executedPlan().toString()
    assert "name" not in plan.split("ReadSchema")[1]
    days = external.load_split(spark, url, {"a": "day"}, 5, **options)["a"]
    assert days.count() == 4000 and days.rdd.getNumPartitions() == 5
    assert external.key_ranges([3, 7], "k") == ["k < 3 OR k IS NULL", "k >= 3 AND k < 7", "k >= 7"]
    with pytest.raises(ValueError):
        external.plan_ranges(spark, url, "a", "name", 4, **options)
