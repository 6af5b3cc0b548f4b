"""Synthesis of relational tables as pure column expressions: narrow jobs over ``spark.range``.

Every key of a synthesized table is a function of the row number, so a foreign key is that function at a random row of the
parent: no join, no shuffle, and any table can be made without the others. Only keys of tables that hold rows already are looked up
(by a join on their dense index). Uniqueness comes from bijections: dense numbers, mixed radix, affine permutations.

A table that holds rows already is continued without repeating a key: integer and sequence keys start after the largest, uuids are
salted by the keys held, and keys of a bounded domain (dates, times, short texts, combinations of parents, parents of a
one-to-one reference) take the numbers of that domain that an anti join leaves free.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from math import gcd, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import generators as G
from tablesmith.functions.hashing import Cells
from tablesmith.operators import domains
from tablesmith.operators.depgraph import order_tables
from tablesmith.operators.domains import Domain, div
from tablesmith.sources.tables import cut_lineage, dense_index
from tablesmith.spec import FRACTIONS, INTEGER_KEYS, ColumnSpec, SchemaSpec

MULTIPLIER = 2_654_435_761


@dataclass
class Parent:
    """Rows that a table has already (their keys by dense index) and rows that are made for it."""

    existing: int = 0
    made: int = 0
    index: dict[str, DataFrame] = field(default_factory=dict)
    next_key: dict[str, int] = field(default_factory=dict)
    held: DataFrame | None = None
    rows: int = 0
    salt: dict[str, str] = field(default_factory=dict)
    taken: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.existing + self.made


@dataclass
class Synthesis:
    tables: dict[str, DataFrame]
    order: list[str]
    warnings: DataFrame


def permuted(row: Column, size: int, seed: int) -> Column:
    """An affine permutation of 0 .. size-1."""
    a = MULTIPLIER % size or 1
    while gcd(a, size) != 1:
        a += 1
    return ((row.cast("decimal(38,0)") * a + seed % size) % size).cast("long")


def digits(number: Column, sizes: list[int]) -> list[Column]:
    """Mixed radix: the place within each of ``sizes``, the first running fastest."""
    out, step = [], 1
    for size in sizes:
        out.append(div(number, step) % size if step > 1 else number % size)
        step *= size
    return out


def self_parent(row: Column, depth: int) -> Column:
    """The parent's row in a tree of at most ``depth`` steps: a chain of ``depth`` rows, all others below its last; null at the root."""
    if depth <= 0:
        return F.lit(None).cast("long")
    return F.when(row > 0, F.least(row - 1, F.lit(depth - 1)))


class Synthesizer:
    """Makes the target tables of a spec; see ``synthesize``."""

    def __init__(self, spark: SparkSession, spec: SchemaSpec, seed: int, hash_kind: str, end: dt.date, depth: int, fill_near_cycles: bool):
        self.spark, self.spec, self.seed, self.kind, self.end, self.depth, self.fill = spark, spec, seed, hash_kind, end, max(0, depth), fill_near_cycles
        self.parents: dict[str, Parent] = {}
        self.warned: list[tuple[str, int, int, str]] = []
        self.placed: list[str] = []
        self.planned: dict[str, int] = {}
        self.deferred: dict[str, list[str]] = {}

    def cells(self, table: str, column: str, row: Column) -> Cells:
        return Cells(self.seed, table, column, row, self.kind)

    def domain(self, c: ColumnSpec) -> int | None:
        """The number of values of a temporal key."""
        days = (self.end - G.START).days + 1
        kind = c.type.lower()
        return days if kind == "date" else 86_400 if kind.startswith("time") and not kind.startswith("timestamp") else days * 86_400 if kind in ("datetime",) or kind.startswith("timestamp") else None

    def bound(self, table: str, name: str) -> Domain | None:
        """The domain that a key column draws from by number: that of a small type, of a temporal primary key, or of a type whose sequence would end too soon."""
        c, p = self.spec.tables[table][name], self.parents[table]
        found = None if c.parent or not (c.pk or c.unique) else domains.of(c, self.end)
        if found is None or (found.kind == "temporal" and not c.pk):
            return None
        if found.kind == "whole" and found.size >= domains.OPEN and c.check_min is None:
            top = (found.size - 1) // 2
            return found if p.next_key.get(name, 1) - 1 + self.planned.get(table, 0) > top else None
        return found

    def key_sizes(self, table: str) -> tuple[list[str], list[int] | None]:
        """A table's key columns by name and their numbers of values; none if one of them is a dense row number."""
        keys = self.spec.keys(table)
        sizes = []
        for k in keys:
            c, d = self.spec.tables[table][k], self.bound(table, k)
            size = self.parents[c.parent[0]].size if c.parent and c.parent[0] != table else d.size if d else None
            if size is None:
                return keys, None
            sizes.append(size)
        return keys, sizes

    def bounded(self, table: str) -> dict[str, tuple[list[str], list[int]]]:
        """The keys of a bounded domain, by name (empty: the primary key): their columns and each column's number of values."""
        keys, sizes = self.key_sizes(table)
        out = {"": (keys, sizes)} if keys and sizes is not None else {}
        for name, c in self.spec.tables[table].items():
            if c.unique and c.parent and c.parent[0] != table and keys != [name]:
                if not (c.nullable and self.later(c)):
                    out[name] = [name], [self.parents[c.parent[0]].size]
            elif (d := self.bound(table, name)) is not None and ((c.unique and keys != [name]) or (d.kind == "text" and "" not in out)):
                out[name] = [name], [d.size]
        return out

    def held_numbers(self, table: str, columns: list[str], sizes: list[int]) -> DataFrame:
        """``number``: those of a bounded domain that the table's rows take up."""
        at, step, number = self.parents[table].held.select(*columns), 1, F.lit(0).cast("long")
        for name, size in zip(columns, sizes, strict=True):
            c = self.spec.tables[table][name]
            if c.parent:
                index = self.parents[c.parent[0]].index.get(c.parent[1])
                if index is None:
                    return at.select(F.lit(0).cast("long").alias("number")).filter(F.lit(False))
                at = at.join(index.select(F.col("key").alias(name), F.col("idx").alias(f"_p_{name}")), name)
                place = F.col(f"_p_{name}")
            else:
                place = self.bound(table, name).number(F.col(name))
            at = at.filter((place >= 0) & (place < size))
            number, step = number + place * step, step * size
        return at.select(number.alias("number")).distinct()

    def take_stock(self, table: str) -> None:
        """Count the numbers that the table's rows take up in each bounded domain."""
        p = self.parents[table]
        if p.rows and not p.taken:
            for group, (columns, sizes) in self.bounded(table).items():
                held = cut_lineage(self.held_numbers(table, columns, sizes))
                p.taken[group] = held, held.count()

    def free(self, table: str, group: str, n: int) -> DataFrame:
        """``_row`` (0 .. n-1) and the free numbers of a bounded domain, in order."""
        held, taken = self.parents[table].taken[group]
        size = prod(self.bounded(table)[group][1])
        left = self.spark.range(min(size, n + taken)).select(F.col("id").alias("key")).join(held.select(F.col("number").alias("key")), "key", "left_anti")
        return dense_index(left).filter(F.col("idx") < n).select(F.col("idx").alias("_row"), F.col("key").alias(f"_n_{group}"))

    def number(self, table: str, group: str, row: Column, spread: int | None = None) -> Column:
        """A row's number in a bounded domain: a free one where the table holds rows, else the row itself or an affine permutation."""
        if group in self.parents[table].taken:
            return F.col(f"_n_{group}")
        return row if spread is None else permuted(row, spread, self.seed)

    def key_number(self, table: str, row: Column, sizes: list[int]) -> Column:
        """A row's number among the combinations of its key: in order for parents and for one number or text, spread out for the others."""
        keys = self.spec.keys(table)
        plain = all(self.spec.tables[table][k].parent for k in keys) or (len(keys) == 1 and self.bound(table, keys[0]).kind != "temporal")
        return self.number(table, "", row, None if plain else prod(sizes))

    def key(self, table: str, column: str, row: Column) -> Column:
        """The value of a key (or sequence) column of a made table at a row, as a function of the row alone."""
        c, p = self.spec.tables[table][column], self.parents[table]
        d = self.bound(table, column)
        if c.pk:
            keys, sizes = self.key_sizes(table)
            if sizes is not None and keys:
                at = digits(self.key_number(table, row, sizes), sizes)[keys.index(column)]
                return self.parent_key(c, at) if c.parent else d.value(at)
            if c.type.lower() in INTEGER_KEYS | FRACTIONS and not c.parent:
                dense = next((k for k in keys if self.spec.tables[table][k].type.lower() in INTEGER_KEYS | FRACTIONS and not self.spec.tables[table][k].parent and self.bound(table, k) is None), None)
                if column == dense:
                    return row + p.next_key.get(column, 1)
            if d is not None and d.kind != "text" and not c.unique:
                return d.value(self.cells(table, column, row).h() % d.size)
            if d is None and c.type.lower() in INTEGER_KEYS | FRACTIONS and not c.parent:
                return self.cells(table, column, row).h() % 1_000_000
        if (c.pk or c.unique) and not c.parent:
            if d is not None:
                return d.value(self.number(table, column, row))
            if c.unique and c.type.lower() in INTEGER_KEYS | FRACTIONS:
                return row + p.next_key.get(column, 1)
            if c.unique and self.domain(c):
                return domains.of(c, self.end).value(row + p.next_key.get(column, 0))
            if self.domain(c) is None:
                salted = F.concat(row.cast("string"), F.lit(p.salt[column])) if column in p.salt else row
                return G.fit_length(G.uuid(self.cells(table, column, salted).digest()), c.length())
        return G.generate(c.generator, self.cells(table, column, row), self.end)

    def parent_key(self, c: ColumnSpec, at: Column) -> Column:
        """The referenced column of a made parent at place ``at`` of its keys."""
        table, ref = c.parent
        held = self.parents[table].existing
        return self.key(table, ref, at - held if held else at)

    def reference(self, table: str, name: str, c: ColumnSpec, row: Column) -> tuple[Column | None, Column | None]:
        """A foreign key's value, and the index into the parent's existing keys where that must be looked up."""
        parent, ref = c.parent
        if parent == table:
            if "" in self.parents[table].taken or ref in self.parents[table].taken:
                self.deferred.setdefault(table, []).append(name)
                return F.lit(None), None
            at = self_parent(row, self.depth)
            value = self.key(table, ref, at)
            own = self.key(table, ref, row)
            return (F.when(at.isNotNull(), value) if c.nullable else F.when(at.isNotNull(), value).otherwise(own)), None
        p = self.parents.get(parent, Parent())
        if self.later(c):
            if self.fill and parent in self.planned and c.nullable:
                self.deferred.setdefault(table, []).append(name)
                return F.lit(None), None
        if p.size == 0 or self.later(c):
            if c.nullable:
                return F.lit(None), None
            raise ValueError(f"no keys of {parent} for {table}.{name}")
        if c.pk and (sizes := self.key_sizes(table)[1]) is not None:
            at = digits(self.key_number(table, row, sizes), sizes)[self.spec.keys(table).index(name)]
        elif c.unique:
            at = self.number(table, name, row, p.size)
        else:
            at = self.cells(table, name, row).h() % p.size
        made = self.key(parent, ref, at - p.existing if p.existing else at) if p.made else F.lit(None)
        if not p.existing:
            return made, None
        return (F.when(at >= p.existing, made) if p.made else None), at

    def later(self, c: ColumnSpec) -> bool:
        """Whether a reference leads to a table that has no rows yet."""
        return c.parent[0] not in self.placed and not self.parents.get(c.parent[0], Parent()).existing

    def fill_deferred(self, table: str, name: str, full: DataFrame) -> DataFrame:
        """Put in a reference that had to wait for keys: those of the table's own rows, now fixed, or those of a table made later."""
        c, row, (parent, ref) = self.spec.tables[table][name], F.col("_row"), self.spec.tables[table][name].parent
        p, kind = self.parents[parent], c.spark_type()
        if parent == table:
            if self.depth == 0:
                return full if c.nullable else full.withColumn(name, F.col(ref).cast(kind))
            first = full.filter(row < self.depth).select(row.alias("_at"), F.col(ref).alias("_key"))  # so many rows as the tree is deep
            found = full.withColumn("_at", self_parent(row, self.depth)).join(F.broadcast(first), "_at", "left")
            value = F.col("_key") if c.nullable else F.coalesce("_key", ref)
        elif p.size == 0:
            return full
        else:
            at = F.when(row < p.size, permuted(row, p.size, self.seed)) if c.unique else self.cells(table, name, row).h() % p.size
            if not p.existing:
                return full.withColumn(name, self.key(parent, ref, at).cast(kind))
            keys = p.index[ref].select(F.col("idx").alias("_at"), F.col("key").alias("_key"))
            found = full.withColumn("_at", at).join(keys, "_at", "left")
            value = F.coalesce("_key", self.key(parent, ref, F.col("_at") - p.existing)) if p.made else F.col("_key")
        return found.withColumn(name, value.cast(kind)).select(*full.columns)

    def check_types(self, table: str, wanted: int) -> None:
        """Raise where the types of a key have too few values for so many rows, whatever the table holds."""
        columns = self.spec.tables[table]
        for group, (names, sizes) in self.bounded(table).items():
            if prod(sizes) < wanted and not any(columns[k].parent for k in names):
                raise ValueError(f"exhausted: {'the key' if not group else group} of {table} has {prod(sizes)} values for {wanted} rows")

    def limit(self, table: str, wanted: int) -> int:
        """The rows a table can have; warns where keys made of foreign keys are fewer than wanted, raises where a key is exhausted."""
        self.check_types(table, wanted)
        self.take_stock(table)
        p, most, columns = self.parents[table], wanted, self.spec.tables[table]
        for group, (names, sizes) in self.bounded(table).items():
            capacity = prod(sizes) - p.taken.get(group, (None, 0))[1]
            if capacity >= wanted:
                continue
            if not all(columns[k].parent for k in names):
                raise ValueError(f"exhausted: {'the key' if not group else group} of {table} has {capacity} values for {wanted} rows")
            most = min(most, capacity)
        for name, c in columns.items():
            if c.unique and not c.parent and not c.pk and self.domain(c):
                room = (86_400 if self.domain(c) == 86_400 else self.domain(c) * 300) - p.next_key.get(name, 0)  # dates go on after the end
                if wanted > room:
                    raise ValueError(f"exhausted: {table}.{name} has {room} values for {wanted} rows")
        if most < wanted:
            self.warned = [w for w in self.warned if w[0] != table]  # of a table that is topped up the last request counts
            self.warned.append((table, wanted, most, f"the keys of its parents make {most} combinations"))
        return most

    def rows(self, table: str, start: int, upto: int, pinned: dict[str, Column] | None = None) -> DataFrame:
        """Rows ``start`` to ``upto`` (exclusive) of a table; ``pinned`` columns take the given values (expressions of ``_row``)."""
        base = self.spark.range(start, upto).select(F.col("id").alias("_row"))
        columns, lookups = {}, {}
        for name, c in self.spec.tables[table].items():
            row = F.col("_row")
            if pinned and name in pinned:
                value = pinned[name]
            elif c.generated:
                continue
            elif c.parent:
                value, at = self.reference(table, name, c, row)
                if at is not None:
                    lookups[name] = (c.parent, at)
                    value = F.lit(None) if value is None else value
            elif c.pk or c.unique:
                value = self.key(table, name, row)
            else:
                value = G.generate(c.generator, self.cells(table, name, row), self.end)
            columns[name] = value
        for group in self.parents[table].taken:
            base = base.join(self.free(table, group, upto), "_row")
        out = base.select("_row", *[v.alias(n) for n, v in columns.items()], *[at.alias(f"_at_{n}") for n, (_, at) in lookups.items()])
        for name, ((parent, ref), _) in lookups.items():
            keys = self.parents[parent].index[ref].select(F.col("idx").alias(f"_at_{name}"), F.col("key").alias(f"_key_{name}"))
            out = out.join(keys, f"_at_{name}", "left").withColumn(name, F.coalesce(f"_key_{name}", name)).drop(f"_at_{name}", f"_key_{name}")
        typed = [G.fit_length(F.col(n).cast("string"), c.length()).alias(n) if c.length() else F.col(n).cast(c.spark_type()).alias(n) for n, c in self.spec.tables[table].items() if n in columns]
        out = out.select("_row", *typed)
        for name, c in self.spec.tables[table].items():
            if isinstance(c.generated, str):
                out = out.withColumn(name, F.expr(c.generated).cast(c.spark_type()))
        return out

    def describe(self, table: str, held: DataFrame) -> None:
        """Note how a table's keys go on after the rows it holds."""
        p, after, text = self.parents[table], [], []
        for name, c in self.spec.tables[table].items():
            if name not in held.columns or c.parent or not (c.pk or c.unique):
                continue
            kind, value = c.type.lower(), F.col(name)
            if kind in INTEGER_KEYS | FRACTIONS:
                after.append((F.floor(F.max(value)) + 1).cast("long").alias(name))
            elif self.domain(c) and c.unique and not c.pk:
                last = F.max(value)
                if kind == "date":
                    after.append(F.greatest(F.datediff(last, F.lit(G.START)) + 1, F.lit(0)).cast("long").alias(name))
                elif self.domain(c) == 86_400:
                    after.append((F.unix_timestamp(F.concat(F.lit("1970-01-01 "), last.cast("string"))) - F.unix_timestamp(F.lit("1970-01-01 00:00:00")) + 1).alias(name))
                else:
                    after.append(F.greatest(F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), last.cast("timestamp_ntz")) + 1, F.lit(0)).cast("long").alias(name))
            elif self.bound(table, name) is None and self.domain(c) is None:
                text.append(F.sum(F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(name))
        facts = held.agg(F.count("*").alias("_n"), *after, *text).first().asDict()
        p.held, p.rows = held, facts.pop("_n")
        p.existing = min([index.count() for index in p.index.values()] or [p.rows])
        p.next_key = {c: int(v) for c, v in facts.items() if v is not None and not isinstance(v, str)}
        p.salt = {c: f"#{v}" for c, v in facts.items() if isinstance(v, str)} if p.rows else {}

    def settle(self, table: str, made: DataFrame) -> DataFrame:
        """Make a table with free keys fixed, and its keys, old and new, addressable."""
        made, p = cut_lineage(made), self.parents[table]
        if p.index:
            p.index = {ref: dense_index(index.select("key").unionByName(made.select(F.col(ref).alias("key")))) for ref, index in p.index.items()}
            p.existing, p.made = min(index.count() for index in p.index.values()), 0
        return made

    def enum_columns(self, table: str) -> dict[str, list[str]]:
        """Columns of a fixed list of at most 12 values, by name, with the trimmed values."""
        found = {}
        for name, c in sorted(self.spec.tables[table].items()):
            kind, args = G.parse(c.generator or "")
            if kind == "randomstring" and 0 < len(args) <= 12 and not c.parent and not c.pk:
                found[name] = args
        return found


def synthesize(
    spark: SparkSession,
    spec: SchemaSpec,
    rows: int = 50,
    targets: list[str] | None = None,
    enum_rows: int = 0,
    min_enum_rows: int = 0,
    table_rows: dict[str, int] | None = None,
    existing: dict[str, DataFrame] | None = None,
    overrides: dict[str, dict[str, Column]] | None = None,
    seed: int = 1,
    hash_kind: str = "xxhash64",
    end_date: dt.date = G.END,
    self_ref_depth: int = 2,
    fill_near_cycles: bool = False,
    order: str = "dependency",
) -> Synthesis:
    """Make ``targets`` (all tables of the spec if none are named), lazily.

    Volume: a ``table_rows`` entry above 0 wins; else ``enum_rows`` makes so many rows for each value of the first enum column;
    else ``rows``, topped up until each value of each enum column has ``min_enum_rows``. ``existing`` holds the current rows of
    tables, whose keys may be drawn and are continued. ``overrides`` pins columns of a table to expressions (of ``_row``).
    """
    ordered = order_tables(spec, spark) if order == "dependency" else list(targets or sorted(spec.tables))
    wanted = [t for t in ordered if t in (targets or spec.tables)]
    s = Synthesizer(spark, spec, seed, hash_kind, end_date, self_ref_depth, fill_near_cycles)
    referred = {v.parent for t in wanted for v in spec.tables[t].values() if v.parent}
    s.parents = {t: Parent() for t in spec.tables}
    for t in wanted:
        override, enums = (table_rows or {}).get(t, 0), s.enum_columns(t)
        s.planned[t] = override if override > 0 else enum_rows * len(next(iter(enums.values()))) if enum_rows and enums else rows
        s.check_types(t, s.planned[t])
    for t in spec.tables:
        p = s.parents[t]
        held = (existing or {}).get(t)
        if held is None:
            continue
        refs = sorted({ref for table, ref in referred if table == t and ref in held.columns})
        p.index = {ref: dense_index(held.select(F.col(ref).alias("key")).filter("key IS NOT NULL")) for ref in refs}
        s.describe(t, held)
    made: dict[str, DataFrame] = {}
    for t in wanted:
        override, enums = (table_rows or {}).get(t, 0), s.enum_columns(t)
        pinned = dict((overrides or {}).get(t, {}))
        n = s.limit(t, s.planned[t])
        if override <= 0 and enum_rows and enums:
            name, values = next(iter(enums.items()))
            pinned[name] = F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("_row") / enum_rows) + 1).cast("int"))
        if n < 0:
            raise ValueError(f"rows of {t} below zero")
        s.parents[t].made = n
        out = s.rows(t, 0, n, pinned)
        if min_enum_rows and override <= 0 and not enum_rows:
            out, n = top_up(s, t, out, n, enums, min_enum_rows, pinned)
            s.parents[t].made = n
        s.placed.append(t)
        made[t] = s.settle(t, out) if s.parents[t].taken else out
    for t, names in s.deferred.items():
        for name in dict.fromkeys(names):
            made[t] = s.fill_deferred(t, name, made[t])
    made = {t: df.drop("_row") for t, df in made.items()}
    for t in wanted:
        for name, c in spec.tables[t].items():
            if c.generator and not G.usable(c.generator) and not c.parent and not c.pk:
                s.warned.append((t, 0, 0, f"unknown generator {c.generator} of {name}: word"))
    warnings = spark.createDataFrame(s.warned, "table string, requested long, generated long, reason string")
    return Synthesis(made, wanted, warnings)


def top_up(s: Synthesizer, table: str, out: DataFrame, n: int, enums: dict[str, list[str]], least: int, pinned: dict[str, Column]) -> tuple[DataFrame, int]:
    """Further rows until every value of every enum column has ``least``; columns by name, counting the rows added before."""
    for name, values in enums.items():
        held = {r[name]: r["n"] for r in out.groupBy(name).agg(F.count("*").alias("n")).collect()}  # at most 12 rows
        stored = {v: held.get(v[: s.spec.tables[table][name].length()], 0) for v in values}  # a value may be cut to the column's length
        lacking = [(v, least - n_held) for v, n_held in stored.items() if n_held < least]
        if not lacking:
            continue
        room = s.limit(table, n + sum(k for _, k in lacking)) - n
        start, value = n, F.lit(None).cast("string")
        for v, k in lacking:
            k = min(k, n + room - start)
            value = F.when((F.col("_row") >= start) & (F.col("_row") < start + k), F.lit(v)).otherwise(value)
            start += k
        if start > n:
            out, n = out.unionByName(s.rows(table, n, start, {**pinned, name: value})), start
    return out, n


def capacity_warnings(spark: SparkSession, requests: list[tuple[str, int, list[int]]]) -> DataFrame:
    """Tables of which more rows are asked for than the keys of their parents combine to: table, requested, generated, reason."""
    rows = [(t, n, prod(sizes), f"the keys of its parents make {prod(sizes)} combinations") for t, n, sizes in requests if n > prod(sizes)]
    return spark.createDataFrame(rows, "table string, requested long, generated long, reason string")


def type_capacity(spec: SchemaSpec, table: str, end: dt.date = G.END) -> int | None:
    """The most rows that the types of a table's key columns allow; none if one of them has no bound or refers to another table."""
    found = [None if spec.tables[table][k].parent else domains.of(spec.tables[table][k], end) for k in spec.keys(table)]
    return prod(d.size for d in found) if found and all(found) else None


def enum_rows(values: DataFrame, n: int) -> DataFrame:
    """``n`` rows for each value (column ``value``), numbered from 0 within the value."""
    return values.select("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("number"))


def enum_deficits(df: DataFrame, column: str, domain: DataFrame, least: int) -> DataFrame:
    """``value`` and ``missing`` for each value of a domain (column ``value``) that lacks rows."""
    held = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return domain.join(held, "value", "left").select("value", (F.lit(least) - F.coalesce("n", F.lit(0))).alias("missing")).filter("missing > 0")


def sample_keys(children: DataFrame, row: str, keys: DataFrame, size: int, cells: Cells, name: str = "key") -> DataFrame:
    """``children`` with a uniformly drawn key of a dense index (idx, key) of ``size`` rows."""
    drawn = children.withColumn("_at", cells.at(F.col(row)).h() % size)
    return drawn.join(keys.select(F.col("idx").alias("_at"), F.col("key").alias(name)), "_at").drop("_at")
