"""Keys of any number of columns.

Two rows that agree in some columns show that no set of these alone is a key: each key has a column in which they differ. The smallest sets that
meet what is known of such differences are the only possible keys. A bounded sample gives the first differences. Then each set proposed is looked at in
whole groups of rows, those whose values' hash falls into a small share: rows that agree in it rule it out, for a shuffle of bounded size. A set
that this does not rule out is counted exactly, over a hash of its values in every row; where hashes repeat, the rows themselves are compared. What is
left in the end are all smallest keys.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.inclusions import comparable
from tablesmith.sources.tables import stored

#: Rows whose pairs give the first differences.
SAMPLE = 500
#: About so many rows are grouped to rule a set out before all of them are.
GROUPED = 50_000
#: Sets looked at in one job, and differences that one returns.
AT_ONCE, RETURNED = 12, 2000


def smallest(sets: set[int]) -> list[int]:
    """Those of some sets (as bits) that hold no other one, by size."""
    out: list[int] = []
    for s in sorted(sets, key=lambda s: (s.bit_count(), s)):
        if not any(o & s == o for o in out):
            out.append(s)
    return out


def meeting(found: list[int], difference: int, most: int) -> list[int]:
    """The smallest sets that meet all differences so far and one more, of at most ``most`` columns."""
    held = [s for s in found if s & difference]
    grown = {s | (1 << b) for s in found if not s & difference for b in range(difference.bit_length()) if difference >> b & 1}
    return smallest({*held, *(s for s in grown if s.bit_count() <= most)})


def _of(rows: np.ndarray) -> set[int]:
    """The differences of all pairs of some rows of values."""
    codes = np.stack([np.unique(rows[:, i], return_inverse=True)[1] for i in range(rows.shape[1])], axis=1)
    bits = 1 << np.arange(min(rows.shape[1], 62), dtype=np.int64)
    out: set[int] = set()
    for i in range(1, len(codes)):
        differ = codes[:i, : len(bits)] != codes[i]
        out.update(np.unique(differ @ bits).tolist())
    return out - {0}


def _differences(groups: DataFrame, names: list[str]) -> list[tuple[int, int]]:
    """Of groups of rows (``s``, ``n``, ``a`` and ``b``: two of them), how two of a group differ: ``s`` and the difference, those of the fewest columns first."""
    same = [F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), "0").otherwise("1") for c in reversed(names)]
    masks = groups.filter("n > 1").select("s", F.concat(*same).alias("mask")).distinct()
    first = masks.orderBy(F.length(F.replace("mask", F.lit("0"), F.lit(""))), "s", "mask").limit(RETURNED).collect()  # a bounded number
    return [(int(r["s"], 16), int(r["mask"], 2)) for r in first]


def _ends(names: list[str]) -> list:
    return [F.count("*").alias("n"), F.min(F.struct(*names)).alias("a"), F.max(F.struct(*names)).alias("b")]


def _in_some_groups(values: DataFrame, sets: dict[int, list[str]], one_in: int) -> DataFrame:
    """Groups of rows that agree in a set's columns, whole ones, for about one in ``one_in`` of its different values; one pass over the table."""
    names = values.columns
    own = [F.when(F.pmod(F.xxhash64(*c), F.lit(one_in)) == 0, F.struct(F.lit(format(s, "x")).alias("s"), F.array(*c).alias("value"))) for s, c in sets.items()]
    chosen = values.select(*names, F.explode(F.array_compact(F.array(*own))).alias("e"))
    return chosen.groupBy("e.s", "e.value").agg(*_ends(names))


def _repeated(values: DataFrame, sets: dict[int, list[str]]) -> dict[int, DataFrame]:
    """The sets of which a hash repeats, with these hashes (``h``): every row counts, and of a row its hash alone is shuffled."""
    hashes = {s: values.select(F.xxhash64(*c).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h") for s, c in sets.items()}
    found = reduce(DataFrame.unionByName, [h.agg(F.count("*").alias("n")).select(F.lit(format(s, "x")).alias("s"), "n") for s, h in hashes.items()]).collect()  # a row for each set
    return {s: hashes[s] for s in (int(r["s"], 16) for r in found if r["n"])}


def key_candidates(df: DataFrame, columns: list[str] | None = None, max_columns: int | None = None) -> list[tuple[str, ...]]:
    """The smallest sets of columns without nulls whose values are unique, by size and name; of at most ``max_columns`` columns if that is given.

    Nothing else bounds the search: it ends when every proposed set has been counted. Tables that repeat whole rows have no key.
    """
    fields = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]
    columns = sorted(columns or fields)
    if not columns:
        return []
    values = stored(df.select(*[comparable(df, c).alias(f"v{i}") for i, c in enumerate(columns)]))
    stats = values.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in values.columns]).first()
    places = [i for i in range(len(columns)) if stats[f"v{i}"] == stats["n"]]
    if not stats["n"] or not places:
        return []
    full, names = [columns[i] for i in places], [f"v{i}" for i in places]
    most = min(max_columns or len(full), len(full))
    values = values.select(*names)
    sample = np.array(values.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect(), dtype=object)  # a bounded sample
    found = [1 << i for i in range(len(full))]
    for difference in smallest(_of(sample.astype(str))) if len(sample) > 1 and len(full) <= 62 else []:
        found = meeting(found, difference, most)
    columns_of = lambda sets: {s: [names[i] for i in range(len(full)) if s >> i & 1] for s in sets}
    one_in, looked, keys = stats["n"] // GROUPED, set(), set()
    while open_ := [s for s in found if s not in keys]:
        if one_in > 1 and (new := [s for s in open_ if s not in looked][:AT_ONCE]):
            looked.update(new)
            ruled_out = _differences(_in_some_groups(values, columns_of(new), one_in), names)
        else:
            counted = open_[:AT_ONCE]
            repeated = _repeated(values, columns_of(counted))
            of = columns_of(repeated)
            rows = [values.withColumn("h", F.xxhash64(*of[s])).join(h, "h", "left_semi").groupBy(*of[s]).agg(*_ends(names)).select(F.lit(format(s, "x")).alias("s"), "n", "a", "b") for s, h in repeated.items()]
            ruled_out = _differences(reduce(DataFrame.unionByName, rows), names) if rows else []
            known = set(repeated) if len(ruled_out) == RETURNED else {s for s, _ in ruled_out}  # with so many, not every set need be among them
            keys.update(set(counted) - known)
        for difference in smallest({d for _, d in ruled_out}):
            if not difference:
                return []  # rows that are equal in every column
            found = meeting(found, difference, most)
    return sorted((tuple(full[i] for i in range(len(full)) if s >> i & 1) for s in keys), key=lambda k: (len(k), k))


def key_table(tables: dict[str, DataFrame], max_columns: int | None = None) -> DataFrame:
    """``table``, ``key`` (columns, comma-joined), ``n_columns`` and ``searched``: the most columns a key could have been found with."""
    rows = [(t, ",".join(k), len(k), max_columns or len(df.columns)) for t, df in sorted(tables.items()) for k in key_candidates(df, max_columns=max_columns)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, key string, n_columns int, searched int")


def unique_columns(df: DataFrame, primary: tuple[str, ...] = ()) -> list[str]:
    """Single columns of unique values, but for the chosen primary key."""
    return [k[0] for k in key_candidates(df, max_columns=1) if k != primary]
