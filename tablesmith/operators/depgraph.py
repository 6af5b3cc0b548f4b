"""Dependency operators over edge tables (child, column, parent, ref_column, nullable)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.sources.tables import stored as cut_lineage


def hard_edges(edges: DataFrame) -> DataFrame:
    """Edges that force an order: not nullable, not to the table itself, both ends named."""
    return edges.filter(~F.coalesce("nullable", F.lit(False)) & (F.col("parent") != F.col("child")) & (F.col("parent") != ""))


#: Links that are followed by doubling alone; of more, most are taken out first.
DOUBLED = 1_000_000


def jump(links: DataFrame) -> DataFrame:
    """Follow links of one target each to their ends: ``node``, ``end`` (not itself the node of a link; null where a target is null), ``dist`` (the
    sum of the links' ``dist``) and ``stuck`` (the way runs into a cycle).

    ``links``: node, target, dist. Many links are contracted first: by a coin for each node, about a quarter is taken out in each round, no two that
    follow each other, and links to one taken out lead to its target from then on. All rounds together so take a few times as many rows as there are
    links. Few links are doubled: each round doubles the way a link spans, so the rounds grow with the logarithm of the longest way.
    """
    kind = links.select(F.coalesce("node", "target").alias("either")).schema["either"].dataType
    state = cut_lineage(links.select("node", "target", F.col("dist").cast("long").alias("dist")))
    out, idle, n = [], 0, state.count()
    while n > DOUBLED and idle < 5 and not isinstance(kind, T.FractionalType):  # equal fractions may be written in several ways
        node, target = (F.xxhash64(F.col(c).cast(kind), F.lit(len(out))).bitwiseAND(F.lit(1)) == 1 for c in ("node", "target"))
        leaves = node & (F.col("target").isNull() | ~target)
        out.append(cut_lineage(state.filter(leaves)))
        over = out[-1].select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("dist").alias("more"))
        rest = state.filter(~leaves).join(over, "target", "left")
        state = cut_lineage(rest.select("node", F.when(F.col("more").isNotNull(), F.col("next")).otherwise(F.col("target")).alias("target"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
        before, n = n, state.count()
        idle = idle + 1 if n > 0.9 * before else 0
    found = _doubled(state)
    for way in reversed(out):
        ahead = found.select(F.col("node").alias("target"), "end", F.col("dist").alias("more"), "stuck")
        back = way.join(ahead, "target", "left").select("node", F.when(F.col("more").isNotNull(), F.col("end")).otherwise(F.col("target")).alias("end"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("stuck", F.lit(False)).alias("stuck"))
        found = found.unionByName(cut_lineage(back))
    return found


def _doubled(links: DataFrame) -> DataFrame:
    state = cut_lineage(links.select("node", F.col("target").alias("end"), "dist", F.col("target").isNull().alias("done")))
    for _ in range(state.count().bit_length() + 1):
        ahead = state.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        went = state.filter("NOT done").join(ahead, "end", "left")
        on = F.col("ends").isNotNull()
        went = went.select("node", F.when(on, F.col("next")).otherwise(F.col("end")).alias("end"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("ends", F.lit(True)).alias("done"))
        state = cut_lineage(state.filter("done").unionByName(went))
        if state.filter("NOT done").isEmpty():
            break
    return state.select("node", "end", "dist", (~F.col("done")).alias("stuck"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``table`` and ``level``: the longest path from a root; null for tables on or below a cycle.

    Tables of one parent are not placed one by one: ``jump`` takes each to the nearest table above it that has several parents or is placed, however
    long the chain. The edges of tables of several parents then lead there, the longest of parallel ones counts, and what is left with one parent
    goes the same way in the next turn. Turns grow with the number of such tables on a path, not with its length.
    """
    left = cut_lineage(edges.select(F.col("child").alias("node"), F.col("parent").alias("target")).distinct().withColumn("dist", F.lit(1).cast("long")))
    roots = nodes.select(F.col("table").alias("node")).distinct().join(left.select("node").distinct(), "node", "left_anti")
    placed = cut_lineage(roots.select("node", F.lit(0).cast("long").alias("level")))  # in one frame
    known, passed = placed, []  # placed last; and tables whose level is that of another one and a distance
    while True:
        # Of an edge from a placed table only the length counts, so all of these are one.
        end = F.when(F.col("level").isNull(), F.col("target")).alias("target")
        left = left.join(known.select(F.col("node").alias("target"), "level"), "target", "left").select("node", end, (F.col("dist") + F.coalesce("level", F.lit(0))).alias("dist"))
        left = cut_lineage(left.groupBy("node", "target").agg(F.max("dist").alias("dist")))
        alone = left.groupBy("node").agg(F.count("*").alias("n")).filter("n = 1").select("node")
        went = cut_lineage(jump(left.join(alone, "node", "left_semi")).filter("NOT stuck"))
        if went.isEmpty():
            break
        known = cut_lineage(went.filter("end IS NULL").select("node", F.col("dist").alias("level")))
        placed = cut_lineage(placed.unionByName(known))
        passed.append(went.filter("end IS NOT NULL").select("node", "end", "dist"))
        left = left.join(went.select("node"), "node", "left_anti")
        via = passed[-1].select(F.col("node").alias("target"), "end", F.col("dist").alias("more"))
        left = left.join(via, "target", "left").select("node", F.coalesce("end", "target").alias("target"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
    for way in reversed(passed):
        below = way.join(placed.select(F.col("node").alias("end"), "level"), "end").select("node", (F.col("level") + F.col("dist")).alias("level"))
        placed = cut_lineage(placed.unionByName(below))
    return nodes.select("table").distinct().join(placed.withColumnRenamed("node", "table"), "table", "left").select("table", F.col("level").cast("int").alias("level"))


def missing_tables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents that no table has: ``child``, ``column``, ``parent``."""
    return hard_edges(edges).join(nodes.select(F.col("table").alias("parent")), "parent", "left_anti").select("child", "column", "parent")


def cycle_report(ranked: DataFrame) -> DataFrame:
    """Tables without a level, sorted: those on a cycle and those below one."""
    return ranked.filter("level IS NULL").select("table").orderBy("table")


def spec_levels(spec) -> list[list[str]]:
    """The tables of a spec by level on the driver, each level sorted: those that need no table of the same or a later one; raises on a missing parent or a cycle."""
    parents = {t: {v.parent[0] for v in columns.values() if v.parent and not v.nullable and v.parent[0] != t} for t, columns in spec.tables.items()}
    absent = sorted(p for ps in parents.values() for p in ps if p not in parents)
    if absent:
        raise ValueError(f"missing table: {', '.join(absent)}")
    found: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(parents):
        ready = sorted(t for t, ps in parents.items() if t not in done and ps <= done)
        if not ready:
            raise ValueError(f"cycle among: {', '.join(sorted(set(parents) - done))}")
        found.append(ready)
        done |= set(ready)
    return found


def order_tables(spec, spark) -> list[str]:
    """Parents first, ties by name."""
    return [t for level in spec_levels(spec) for t in level]


def neighbours(edges: DataFrame) -> DataFrame:
    """``table``, ``parents`` and ``children`` (each sorted and comma-joined) over the edges given."""
    up = edges.groupBy(F.col("child").alias("table")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("parents"))
    down = edges.groupBy(F.col("parent").alias("table")).agg(F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))
    return up.join(down, "table", "full_outer").select("table", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children"))


def close_selection(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``table`` and ``auto_added``: the selection with all of its hard parents.

    Where tables have one parent, steps of 1, 2, 4 ... parents reach all that stand above in a logarithmic number of rounds; only tables of several
    parents are passed one at a time.
    """
    pairs = cut_lineage(hard_edges(edges).select("child", "parent").distinct())
    alone = pairs.groupBy("child").agg(F.count("*").alias("n")).filter("n = 1").select("child")
    steps = [cut_lineage(pairs.join(alone, "child", "left_semi"))]
    while len(steps) <= steps[0].count().bit_length():
        twice = steps[-1].join(steps[-1].select(F.col("child").alias("parent"), F.col("parent").alias("next")), "parent").select("child", F.col("next").alias("parent"))
        steps.append(cut_lineage(twice))
        if steps[-1].isEmpty():
            break
    several = cut_lineage(pairs.join(alone, "child", "left_anti"))
    chosen = cut_lineage(selected.select("table").distinct())
    new = seen = chosen
    while True:
        for step in steps:  # what is reached by steps of any length so far, and from there by this one
            found = step.join(new.select(F.col("table").alias("child")), "child", "left_semi").select(F.col("parent").alias("table"))
            new = cut_lineage(new.unionByName(found).distinct())
        seen = cut_lineage(seen.unionByName(new).distinct())
        over = several.join(new.select(F.col("table").alias("child")), "child", "left_semi").select(F.col("parent").alias("table")).distinct()
        new = cut_lineage(over.join(seen, "table", "left_anti"))
        if new.isEmpty():
            break
    return seen.join(chosen.withColumn("chosen", F.lit(True)), "table", "left").select("table", F.col("chosen").isNull().alias("auto_added"))


def seed_plan(ranked: DataFrame, edges: DataFrame, volumes: DataFrame) -> DataFrame:
    """``table``, ``level``, ``n`` and ``dependencies``: hard parents sorted, then optional ones marked ``?``."""
    hard = hard_edges(edges).groupBy(F.col("child").alias("table")).agg(F.array_sort(F.collect_set("parent")).alias("hard"))
    soft = edges.filter(F.col("nullable") & (F.col("parent") != F.col("child"))).groupBy(F.col("child").alias("table")).agg(F.array_sort(F.collect_set(F.concat("parent", F.lit("?")))).alias("soft"))
    none = F.array().cast("array<string>")
    dependencies = F.array_join(F.concat(F.coalesce("hard", none), F.coalesce("soft", none)), ",").alias("dependencies")
    full = ranked.join(volumes, "table", "left").join(hard, "table", "left").join(soft, "table", "left")
    return full.select("table", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"), dependencies)


def graph_payload(edges: DataFrame, counts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every edge between two tables, nullable ones included, with both ends' rows and whether either is on or below a cycle."""
    stuck = ranked.select("table", F.col("level").isNull().alias("stuck"))
    ends = counts.join(stuck, "table", "left")
    child = ends.select(F.col("table").alias("child"), F.col("n").alias("child_rows"), F.col("stuck").alias("a"))
    parent = ends.select(F.col("table").alias("parent"), F.col("n").alias("parent_rows"), F.col("stuck").alias("b"))
    cyclic = (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("cyclic")
    both = edges.filter("child <> parent").join(child, "child", "left").join(parent, "parent", "left")
    return both.select("child", "column", "parent", "ref_column", "nullable", "child_rows", "parent_rows", cyclic)


def display_parents(edges: DataFrame) -> DataFrame:
    """``child`` and ``parent`` of every edge to another table, nullable ones included, each pair once."""
    return edges.filter("child <> parent").select("child", "parent").dropDuplicates()


def column_catalog(tables: dict[str, DataFrame], spec=None) -> DataFrame:
    """One row for each (table, column): ordinal and type, with a spec's marks where there is one."""
    rows = []
    for name, df in sorted(tables.items()):
        for i, (column, kind) in enumerate(df.dtypes, 1):
            c = spec.tables.get(name, {}).get(column) if spec else None
            rows.append((name, column, i, kind, bool(c and c.pk), c.fk if c else None, bool(c.nullable) if c else True, bool(c and c.unique)))
    session = next(iter(tables.values())).sparkSession
    return session.createDataFrame(rows, "table string, column string, ordinal int, type string, pk boolean, fk string, nullable boolean, unique boolean")
