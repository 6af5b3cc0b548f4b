"""Queries on references between tables, found from the data in one pass."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from tablesmith.operators import inclusions
from tablesmith.plans.queries import load, query
from tablesmith.sources.tables import stored

#: Columns of comparable kinds of the given tables: whole numbers, texts, instants.
NUMBERS = {
    "benchmark": "item_id", "conversations": "conv_id turn", "customer": "c_custkey c_nationkey", "documents": "doc_id n_chars", "embeddings": "vec_id label", "events": "event_id user_id", "labels": "doc_id quality toxic", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber",
    "nation": "n_nationkey n_regionkey", "orders": "o_orderkey o_custkey", "pages": "page_id", "part": "p_partkey p_size", "region": "r_regionkey", "supplier": "s_suppkey s_nationkey",
}
TEXTS = {
    "benchmark": "text", "conversations": "role text", "customer": "c_name c_mktsegment", "documents": "text lang source", "events": "event_type props", "lineitem": "l_returnflag l_linestatus", "nation": "n_name",
    "orders": "o_orderstatus o_orderpriority", "pages": "url html", "part": "p_name p_brand p_type", "region": "r_name", "supplier": "s_name",
}
INSTANTS = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}


def values_sql() -> str:
    """All distinct values of all columns, one below another."""
    parts = []
    for kind, columns in (("n", NUMBERS), ("s", TEXTS), ("t", INSTANTS)):
        parts += [f"SELECT DISTINCT '{kind}' AS kind, '{t}' AS tab, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, own in columns.items() for c in own.split()]
    return " UNION ALL ".join(parts)


def rows_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n FROM {t}" for t in NUMBERS)


@query(f"""WITH v AS ({values_sql()}), d AS (SELECT tab, col, count(*) AS n FROM v GROUP BY tab, col), t AS ({rows_sql()}),
meet AS (SELECT a.tab AS child, a.col AS "column", b.tab AS parent, b.col AS ref_column, count(*) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v AND a.tab <> b.tab GROUP BY ALL)
SELECT child, "column", parent, ref_column, 1 AS n_columns, d.n AS distinct_values, CAST(1 AS DOUBLE) AS coverage, p.n = t.n AS parent_unique
FROM meet JOIN d ON d.tab = child AND d.col = "column" JOIN d p ON p.tab = parent AND p.col = ref_column JOIN t ON t.tab = parent WHERE meet.n = d.n""")
def p5_inclusions_of_all_tables(spark, sf_dir):
    """Every inclusion between two columns of all tables, in one pass over each."""
    return inclusions.inclusions(load(spark, sf_dir, *NUMBERS))


#: Of the tables compared below: the rows they hold and their columns.
COMPARED = {
    "lineitem": ("SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem", ["l_linenumber", "l_partkey", "l_suppkey"]),
    "offer": ("SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem", ["part_id", "supplier_id"]),
    "conversations": ("SELECT conv_id, turn FROM conversations", ["conv_id", "turn"]),
    "answer": ("SELECT conv_id AS of_conv, turn AS of_turn FROM conversations WHERE role = 'assistant'", ["of_conv", "of_turn"]),
}


def composite_sql() -> str:
    """Each pair of columns of one table against each pair of another, both ways round."""
    parts = []
    for (child, (_, own)), (parent, (_, others)) in permutations(COMPARED.items(), 2):
        for a, b in combinations(own, 2):
            for c, d in permutations(others, 2):
                alone = " OR ".join(f"(SELECT count(DISTINCT {x}) = count(*) FROM t_{parent})" for x in (c, d))
                inside = f"(SELECT count(*) FROM (SELECT {a}, {b} FROM t_{child} EXCEPT SELECT {c}, {d} FROM t_{parent}))"
                unique = f"(SELECT count(DISTINCT ({c}, {d})) = count(*) FROM t_{parent})"
                parts.append(f"SELECT '{child}' AS child, '{a},{b}' AS \"column\", '{parent}' AS parent, '{c},{d}' AS ref_column, 2 AS n_columns, count(DISTINCT ({a}, {b})) AS distinct_values, CAST(1 AS DOUBLE) AS coverage, true AS parent_unique FROM t_{child} HAVING count(*) > 0 AND {unique} AND NOT ({alone}) AND {inside} = 0")
    return f"WITH {', '.join(f't_{t} AS ({sql})' for t, (sql, _) in COMPARED.items())} {' UNION ALL '.join(parts)}"


@query(composite_sql())
def p5_composite_inclusions(spark, sf_dir):
    """References of two columns: line items to the pairs of part and supplier that are offered, answers to turns of conversations."""
    t = load(spark, sf_dir, "lineitem", "conversations")
    line, talk = t["lineitem"], t["conversations"]
    tables = {
        "lineitem": line.select("l_partkey", "l_suppkey", "l_linenumber"),
        "offer": stored(line.select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")).distinct()),
        "conversations": talk.select("conv_id", "turn"),
        "answer": talk.filter("role = 'assistant'").select(F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn")),
    }
    return inclusions.composite_inclusions(tables)
