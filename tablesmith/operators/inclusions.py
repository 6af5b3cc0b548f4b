"""Inclusions between columns, and between lists of columns, from one pass over each table.

Every row gives one entry for each column (or list of columns) it has a value in. Grouped by value, the entries become the set of columns that
hold the value, a few machine words that tasks combine before the only large shuffle. How many values have the same set is all that is kept: columns that
meet in a set share so many values, a column is unique if it has as many values as rows, and what is included in what follows. The tables left
after the shuffle have a size that the schema bounds, not the rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.sources.tables import cut_lineage

#: Columns in one machine word of a set.
WORD = 62
#: Longer texts are compared by their digest, so that an entry has a bounded size.
LONGEST_VALUE = 64
#: Of lists of several columns about so many rows' values are compared before all are.
FIRST_VALUES = 200_000
#: A table and some of its columns.
Columns = tuple[str, tuple[str, ...]]


def kind_of(kind: T.DataType) -> str | None:
    """Columns are compared within a kind: whole numbers, texts, dates, instants. Others are no keys."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "n"
    return {T.StringType: "s", T.VarcharType: "s", T.CharType: "s", T.DateType: "d", T.TimestampType: "t", T.TimestampNTZType: "t"}.get(type(kind))


def key_columns(tables: dict[str, DataFrame]) -> list[Columns]:
    """Each column of a comparable kind, by itself."""
    return [(t, (f.name,)) for t, df in sorted(tables.items()) for f in df.schema if kind_of(f.dataType)]


def comparable(df: DataFrame, column: str) -> Column:
    """A value as a text of bounded size that is equal where the values are."""
    value = F.col(f"`{column}`")
    if kind_of(df.schema[column].dataType) == "s":
        return F.when(F.octet_length(value) <= LONGEST_VALUE, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))
    return value.cast("string")


def _value(df: DataFrame, columns: tuple[str, ...], width: int) -> list[Column]:
    """A row's value in a list of columns, equal where the values are: whole numbers as such, in ``width`` places, and what is none (or too large) as texts, null if there is none."""
    numbers, texts = [], []
    for c in columns:
        kind = df.schema[c].dataType
        number = F.col(f"`{c}`").try_cast("long") if kind_of(kind) == "n" else F.lit(None).cast("long")
        numbers.append(number)
        texts.append(F.when(number.isNull(), comparable(df, c)) if isinstance(kind, T.DecimalType) or kind_of(kind) != "n" else None)
    none = F.lit(None).cast("string")
    own = [none if x is None else x for x in texts]
    text = F.lit(None).cast("array<string>") if not any(x is not None for x in texts) else F.when(F.coalesce(*own).isNotNull(), F.array(*own))
    return [*numbers, *[F.lit(None).cast("long")] * (width - len(columns)), text]


def _entries(df: DataFrame, own: list[tuple[int, tuple[str, ...]]], table: int, words: int, width: int, one_in: int) -> DataFrame:
    """An entry for each list of columns without a null, and one that tells which lists these are (``#``: null for all of them). With ``one_in``, for about one of so many values."""

    def entry(kind: str, value: list[Column], number: int | None) -> Column:
        sets = [F.lit(1 << number % WORD if number is not None and number // WORD == w else 0).cast("long").alias(f"w{w}") for w in range(words)]
        return F.struct(F.lit(kind).alias("kind"), *[x.alias(f"x{i}") for i, x in enumerate(value[:-1])], value[-1].alias("text"), *sets)

    values = {number: _value(df, columns, width) for number, columns in own}
    full = {number: reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in columns]) for number, columns in own}
    if one_in > 1:
        full = {number: there & (F.pmod(F.xxhash64(*values[number]), F.lit(one_in)) == 0) for number, there in full.items()}
    filled = F.when(~reduce(Column.__and__, full.values()), F.array(*[F.when(there, F.lit(str(number))).otherwise(F.lit("")) for number, there in full.items()]))
    row = entry("#", [F.lit(table).cast("long"), *[F.lit(None).cast("long")] * (width - 1), filled], None)
    found = [F.when(full[number], entry("".join(kind_of(df.schema[c].dataType) for c in columns), values[number], number)) for number, columns in own]
    return df.select(F.explode(F.array(F.when(reduce(Column.__or__, full.values()), row) if one_in > 1 else row, *found)).alias("e")).filter("e IS NOT NULL").select("e.*")


class Overlaps:
    """How many distinct values lists of columns have (``distinct``), which are ``unique`` (a value in each row, none twice), the ``rows`` of their
    tables, how many values two lists share (``shared``, by their places in ``lists``), and the ``range`` of the values of lists of one column (of
    texts that are longer than an entry holds, that of their digests).

    With ``one_in`` all this is of about one of so many values, each with all its rows: what is not included there, or ``repeated``, is not at all."""

    def __init__(self, tables: dict[str, DataFrame], lists: list[Columns], one_in: int = 1):
        self.lists, self.place = lists, {x: i for i, x in enumerate(lists)}
        names, words = sorted({t for t, _ in lists}), len(lists) // WORD + 1
        masks = [f"w{w}" for w in range(words)]
        self.shared: dict[tuple[int, int], int] = {}
        self.range: dict[int, tuple] = {}
        self.rows: dict[str, int] = defaultdict(int)
        filled: dict[int, int] = defaultdict(int)
        if lists:
            width = max(len(c) for _, c in lists)
            parts = [_entries(tables[t], [(i, c) for i, (u, c) in enumerate(lists) if u == t], k, words, width, one_in) for k, t in enumerate(names)]
            held = reduce(DataFrame.unionByName, parts).groupBy("kind", *[f"x{i}" for i in range(width)], "text").agg(F.count("*").alias("n"), *[F.bit_or(m).alias(m) for m in masks])
            one, number, row = F.element_at("text", 1), F.col("kind") == "n", F.col("kind") == "#"
            values = {"number": F.when(number, F.col("x0")), "large": F.when(number, one.try_cast("decimal(38,0)")), "text": F.when(~number, one)} if width == 1 else {}
            ranges = [f(x).alias(f"{side}_{k}") for k, x in values.items() for side, f in (("low", F.min), ("high", F.max))]
            sets = cut_lineage(held.groupBy(F.when(row, F.col("x0")).alias("of"), F.when(row, F.col("text")).alias("filled"), *masks).agg(F.sum("n").alias("n"), F.count("*").alias("values"), *ranges))
            members = F.array_compact(F.array(*[F.when(F.col(f"w{i // WORD}").bitwiseAND(F.lit(1 << i % WORD)) != 0, F.lit(i)) for i in range(len(lists))]))
            meet = sets.filter("of IS NULL").select("values", members.alias("m")).select("values", "m", F.explode("m").alias("a")).select("values", "a", F.explode("m").alias("b"))
            self.shared = {(r["a"], r["b"]): r["values"] for r in meet.groupBy("a", "b").agg(F.sum("values").alias("values")).collect()}  # a row for two lists at most
            ends = [f(f"{side}_{k}").alias(f"{side}_{k}") for k in values for side, f in (("low", F.min), ("high", F.max))]
            for r in sets.filter("of IS NULL").withColumn("a", F.explode(members)).groupBy("a").agg(*ends).collect() if ends else ():  # a row for each list
                numbers = [[r[f"{side}_{k}"] for k in ("number", "large") if r[f"{side}_{k}"] is not None] for side in ("low", "high")]
                self.range[r["a"]] = (min(numbers[0]), max(numbers[1])) if numbers[0] else (r["low_text"], r["high_text"])
            for r in sets.filter("of IS NOT NULL").select("of", "filled", "n").collect():  # a row for each pattern of nulls
                table = names[r["of"]]
                self.rows[table] += r["n"]
                for i in [i for i, (t, _) in enumerate(lists) if t == table] if r["filled"] is None else map(int, filter(None, r["filled"])):
                    filled[i] += r["n"]
        self.distinct = [self.shared.get((i, i), 0) for i in range(len(lists))]
        self.repeated = [filled[i] > self.distinct[i] for i in range(len(lists))]
        self.unique = [0 < self.rows[t] == filled[i] == self.distinct[i] for i, (t, _) in enumerate(lists)]

    def coverage(self, child: Columns, parent: Columns) -> float:
        """The part of the child's values that the parent has; 0 for a child without values."""
        a, b = self.place[child], self.place[parent]
        return self.shared.get((a, b), 0) / self.distinct[a] if self.distinct[a] else 0.0


SCHEMA = "child string, column string, parent string, ref_column string, n_columns int, distinct_values long, coverage double, parent_unique boolean"


def _row(found: Overlaps, child: Columns, parent: Columns) -> tuple:
    return child[0], ",".join(child[1]), parent[0], ",".join(parent[1]), len(child[1]), found.distinct[found.place[child]], found.coverage(child, parent), found.unique[found.place[parent]]


def inclusions(tables: dict[str, DataFrame], least: float = 1.0) -> DataFrame:
    """Every pair of columns of two tables of which the second holds at least ``least`` of the first's distinct values (and one of them):
    child, column, parent, ref_column, n_columns, distinct_values, coverage, parent_unique. Columns without values are included in none."""
    found = Overlaps(tables, key_columns(tables))
    pairs = [(found.lists[a], found.lists[b]) for a, b in sorted(found.shared) if found.lists[a][0] != found.lists[b][0]]
    return next(iter(tables.values())).sparkSession.createDataFrame([_row(found, a, b) for a, b in pairs if found.coverage(a, b) >= least], SCHEMA)


def composite_inclusions(tables: dict[str, DataFrame], max_columns: int = 2) -> DataFrame:
    """References of two and more columns, as ``inclusions``: lists of columns whose values (rows without a null among them) all are values of a
    unique list of another table's columns no part of which is unique.

    Level by level: a list is looked at if its columns are included one by one and, from three columns on, all lists of one column less are included
    in theirs. Each level is one pass over the tables, for large tables after one over a share of the values, which leaves out what these disprove.
    """
    found = Overlaps(tables, key_columns(tables))
    single = {(a, b) for a, b in found.shared if found.lists[a][0] != found.lists[b][0] and found.shared[a, b] == found.distinct[a]}
    keys = {(t, frozenset(c)) for (t, c), unique in zip(found.lists, found.unique, strict=True) if unique}
    held = {((found.lists[a][0], found.lists[b][0]), ((found.lists[a][1][0], found.lists[b][1][0]),)) for a, b in single}
    rows = []
    for size in range(2, max_columns + 1):
        of_tables: dict[tuple[str, str], set] = defaultdict(set)
        for ends, pairs in held:
            of_tables[ends].add(pairs)
        wanted = []
        for ends, included in sorted(of_tables.items()):
            columns = sorted({pair for pairs in included for pair in pairs})
            for pairs in combinations(columns, size):
                child, parent = zip(*pairs, strict=True)
                apart = len(set(child)) == len(set(parent)) == size
                if apart and not any(t == ends[1] and k <= set(parent) for t, k in keys) and all(part in included for part in combinations(pairs, size - 1)):
                    wanted.append((ends, pairs))
        if not wanted:
            break
        sides = lambda ends, pairs: [(ends[side], tuple(p[side] for p in pairs)) for side in (0, 1)]
        one_in = max(found.rows.values()) // FIRST_VALUES
        if one_in > 1:
            some, kept = Overlaps(tables, sorted({x for w in wanted for x in sides(*w)}), one_in), []
            for w in wanted:
                child, parent = sides(*w)
                disproved = some.distinct[some.place[child]] and some.coverage(child, parent) < 1.0
                if not disproved and not (size == max_columns and some.repeated[some.place[parent]]):
                    kept.append(w)
            wanted = kept
        lists = sorted({x for w in wanted for x in sides(*w)})
        level = Overlaps(tables, lists)
        held = set()
        for ends, pairs in wanted:
            child, parent = sides(ends, pairs)
            if level.distinct[level.place[child]] and level.coverage(child, parent) == 1.0:
                held.add((ends, pairs))
                if level.unique[level.place[parent]]:
                    rows.append(_row(level, child, parent))
        keys |= {(t, frozenset(c)) for (t, c), unique in zip(level.lists, level.unique, strict=True) if unique}
    return next(iter(tables.values())).sparkSession.createDataFrame(sorted(rows), SCHEMA)


def _bare(column: str) -> str:
    """A column's name without a short table prefix."""
    prefix, _, rest = column.partition("_")
    return rest if rest and len(prefix) <= 2 else column


def foreign_keys(tables: dict[str, DataFrame], names_only: bool = False) -> DataFrame:
    """Ranked candidates: child, column, parent, ref_column, coverage, name_match, rank.

    Parents are unique columns of the child's kind whose range holds the child's; their coverage may be 0. With ``names_only`` the names must agree too (which leaves out references
    of another name), else names only rank the candidates. Inclusion does not prove a foreign key.
    """
    found = Overlaps(tables, key_columns(tables))
    kind = {(t, c): kind_of(tables[t].schema[c].dataType) for t, (c,) in found.lists}
    rows = []
    for (child, (column,)), (parent, (ref,)) in permutations(found.lists, 2):
        a, b, match = found.place[child, (column,)], found.place[parent, (ref,)], _bare(column) == _bare(ref)
        if child == parent or kind[child, column] != kind[parent, ref] or not found.distinct[a] or not found.unique[b]:
            continue
        coverage, (low, high), (first, last) = found.coverage(found.lists[a], found.lists[b]), found.range[a], found.range[b]
        if first <= low and high <= last and (match or not names_only):
            rows.append((child, column, parent, ref, coverage, match, found.rows[parent]))
    place = Window.partitionBy("child", "column").orderBy(F.desc("name_match"), F.desc("coverage"), "parent_rows", "parent")
    pairs = next(iter(tables.values())).sparkSession.createDataFrame(rows, "child string, column string, parent string, ref_column string, coverage double, name_match boolean, parent_rows long")
    return pairs.withColumn("rank", F.row_number().over(place)).drop("parent_rows")
