"""What fails only on larger tables, provoked by small ones."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import checks, depgraph, inclusions, keys
from tablesmith.plans import registry, schema36


@pytest.fixture
def folder(sf, tmp_path):
    """The smallest tables, some of which a test replaces."""
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)

    def put(df, name):
        path = tmp_path / f"{name}.parquet"
        if path.is_symlink():
            path.unlink()
        df.write.mode("overwrite").parquet(str(path))

    put.path = str(tmp_path)
    return put


def answers(spark, path, name):
    """The rows of a query and of its SQL, sorted, columns by name."""
    df, con = registry.QUERIES[name](spark, path), duckdb.connect()
    for f in os.listdir(path):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}/{f}{'/*.parquet' if os.path.isdir(f'{path}/{f}') else ''}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, df.select(*columns).collect())), sorted(want.fetchall())


def test_estimated_sizes_do_not_grow_by_rounds(spark):
    """A checkpoint's estimate squares in each round; read back from files it does not."""
    links = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("target"), F.lit(1).alias("dist"))
    tables = links.select(F.col("node").cast("string").alias("table"))
    edges = links.filter("target IS NOT NULL").select(F.col("node").cast("string").alias("child"), F.col("target").cast("string").alias("parent"))
    for df in (depgraph.jump(links), depgraph.levels(tables, edges), depgraph.close_selection(edges.withColumn("nullable", F.lit(False)), tables.filter("table = '199'"))):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 120


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contracted_links_lead_to_the_same_ends(spark, monkeypatch, kind):
    rows = [(i, i - 1) for i in range(1, 500)] + [(i, 7 if i % 2 else 600 + i // 2 % 90) for i in range(700, 1500)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(3000, 2000), (3001, None), (3002, 3001), (3003, 9999)]
    links = spark.createDataFrame(rows, "node long, target long").select(F.col("node").cast(kind).alias("node"), F.col("target").cast(kind).alias("target"), F.lit(2).alias("dist"))
    found = []
    for most in (1_000_000, 300):
        monkeypatch.setattr(depgraph, "DOUBLED", most, raising=False)
        found.append(sorted((r.node, None if r.stuck else (r.end, r.dist), r.stuck) for r in depgraph.jump(links).collect()))
    assert len(found[0]) == len(rows) and found[0] == found[1]
    ends = {int(n): (e, stuck) for n, e, stuck in found[1]}
    of = int if kind == "long" else str
    assert ends[499] == ((of(0), 998), False) and ends[3002] == ((None, 4), False) and ends[2003] == ends[3000] == (None, True) and ends[3003] == ((of(9999), 2), False)


def test_a_day_without_free_times(spark, folder):
    folder(spark.range(1, 90_001).select(F.col("id").alias("c_custkey")), "customer")
    df = registry.QUERIES["d4_refilled_times"](spark, folder.path)
    assert {(r.is_new, r["count"]) for r in df.groupBy("is_new").count().collect()} == {(False, 86_400)}
    folder(spark.range(1, 80_001).select(F.col("id").alias("c_custkey")), "customer")
    df = registry.QUERIES["d4_refilled_times"](spark, folder.path)
    assert {(r.is_new, r["count"]) for r in df.groupBy("is_new").count().collect()} == {(False, 80_000), (True, 6_400)} and df.select("at").distinct().count() == 86_400


@pytest.mark.parametrize("name", ["x1_orphans_of_36_tables", "x2_keys_and_domains_of_36_tables", "x3_trees_of_36_tables"])
def test_more_rows_than_days(spark, folder, name):
    folder(spark.range(1, 12_001).select(F.col("id").alias("s_suppkey")), "supplier")
    got, want = answers(spark, folder.path, name)
    assert got == want
    assert set(schema36.full_tables(schema36.SPEC, 12_000)) == {"closing_day"} and set(schema36.full_tables(schema36.SPEC, 90_000)) == {"closing_day", "bell"}


def test_inclusions_without_a_common_value(spark, folder):
    """A range within another one counts though no value is shared."""
    folder(spark.createDataFrame([(5, "b"), (15, "d")], "r_regionkey int, r_name string"), "region")
    folder(spark.createDataFrame([(0, "a", 5), (10, "c", 5), (20, "e", 15)], "n_nationkey int, n_name string, n_regionkey int"), "nation")
    got, want = answers(spark, folder.path, "p5_inclusions_whatever_the_names")
    assert got == want and ("region", "r_regionkey", "nation", "n_nationkey", 0.0) in got and ("region", "r_name", "nation", "n_name", 0.0) in got


def test_depths_of_contracted_chains(spark, monkeypatch):
    monkeypatch.setattr(depgraph, "DOUBLED", 500, raising=False)
    links = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 1000 > 0, F.col("id") - 1).alias("up"))
    assert checks.depths(links, "id", "up").filter("depth = id % 1000 AND root = id - id % 1000").count() == 3000


def test_sets_that_are_no_keys_cost_no_shuffle_of_all_rows(spark, monkeypatch):
    """Sets are ruled out in a share of their groups; a set of which a hash repeats is counted by its rows."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    monkeypatch.setattr(keys, "GROUPED", 2000, raising=False)
    monkeypatch.setattr(keys, "SAMPLE", 20)
    halves = spark.range(20_000).select(*[(F.floor(F.col("id") / 2 ** (i + 1)) * 2**i + F.col("id") % 2**i).alias(f"c{i}") for i in range(8)])
    before = written()
    assert keys.key_candidates(halves, max_columns=1) == [] and written() - before < 2 * 20_000
    df = spark.range(20_736).selectExpr("id % 12 AS a", "id div 12 % 12 AS b", "id div 144 % 12 AS c", "id div 1728 AS d", "id % 3 AS e", "'x' AS f", "(id % 12 + id div 12) % 12 AS s")
    assert keys.key_candidates(df) == [("a", "b", "c", "d"), ("a", "c", "d", "s"), ("b", "c", "d", "s")]
    assert keys.key_candidates(df.unionByName(df.limit(1))) == []
    few = spark.range(30_000).selectExpr("if(id = 29999, 7, id) AS a", "if(id = 29998, 7, id) AS b", "id % 2 AS c")
    assert keys.key_candidates(few) == [("a", "b"), ("b", "c")]


def test_lists_that_a_share_of_the_values_disproves_are_not_compared_in_full(spark, monkeypatch):
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    monkeypatch.setattr(inclusions, "FIRST_VALUES", 500, raising=False)
    pairs = spark.range(20_000).select((F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y")).filter("(x * 7 + y) % 2 = 0")
    child = pairs.select(F.col("x").alias("a"), F.col("y").cast("decimal(20,0)").alias("b"), F.pmod(F.xxhash64("x", "y"), F.lit(100)).alias("c"))
    before = written()
    got = sorted(map(tuple, inclusions.composite_inclusions({"child": child, "parent": pairs}).collect()))
    assert got == [("child", "a,b", "parent", "x,y", 2, 10_000, 1.0, True), ("parent", "x,y", "child", "a,b", 2, 10_000, 1.0, True)]
    assert written() - before < 30_000


def test_numbers_of_all_types_are_equal_where_their_values_are(spark):
    big = 10**25
    a = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "k int, m int").select("k", F.col("m").cast("decimal(30,0)").alias("m"))
    b = spark.sql(f"SELECT * FROM VALUES (1BD), (2BD), (3BD), ({big}BD) AS t(d)").select(F.col("d").cast("decimal(38,0)").alias("d"))
    found = inclusions.inclusions({"a": a, "b": b, "c": spark.sql(f"SELECT CAST({big} AS decimal(38,0)) AS e")})
    assert {(r.child, r.column, r.parent, r.ref_column) for r in found.collect()} == {("a", "k", "b", "d"), ("c", "e", "b", "d")}
    assert inclusions.Overlaps({"b": b}, [("b", ("d",))]).range[0] == (1, big)
