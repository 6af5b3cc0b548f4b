"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; an item is the multiset of its five-word shingles (an item of fewer words is
one shingle). A window of a document is as many words as the item has, or less at the document's end. A document leaks an item
if the weighted Jaccard similarity of some window (each shingle weighs as often as it occurs) is at least 0.8.

The best window can be taken to begin with a shingle of the item: otherwise the window one word further on is no worse. So only
positions whose shingle is the item's are windows, and only those where enough of the following positions are; equal windows of a
document are one. Each window keeps the item that it may leak and gets a SimHash over its shingles. Fingerprints are cut into
``radius + 1`` blocks; those within ``radius`` bits agree in one block at least, so an equi-join on item and block finds every
window within the radius of its item. The exact similarity then decides. A window beyond the radius may still be similar enough
(similarity 0.8 leaves 10 of 64 bits different on average, with a deviation of 3), so where the blocks led to no leak of an item by a
document, its other windows are compared exactly too: nothing is lost to the radius.

Only positions and item numbers leave the stage that cuts documents into shingles; the windows themselves are cut from the few
documents that have any.

Edge cases: null and empty texts have no windows; items without words match nothing; repeated documents and items are compared
as one and returned once for each (id, item id); of windows of equal similarity the first counts; texts of any length are read whole,
and a very long text whose shingles recur has as many windows as it has different ones; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.components import cut, small

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 12


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words_col: str, width: int) -> Column:
    """The hashes of a word array's shingles in order; none if there are fewer words."""
    return F.expr(f"CASE WHEN size({words_col}) >= {width} THEN transform(sequence(1, size({words_col}) - {width - 1}), i -> xxhash64(slice({words_col}, i, {width}))) ELSE array() END")


def fingerprint(hashes: str) -> Column:
    """SimHash of an array of hashes: a bit is 1 if set in over half of them."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | IF(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def blocks(fp: str, radius: int) -> Column:
    """``radius + 1`` numbered blocks of a fingerprint, together all of its bits."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1 if b - a < 64 else -1}L").alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``item_col``, ``start`` (word, from 0), ``similarity`` and ``differing_bits`` of the best window of each leak.

    Windows beyond ``radius`` count only where none within it leaks the item.
    """
    item = items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    found = None
    for width in sorted(r["width"] for r in item.select("width").distinct().collect()):
        mine = item.filter(F.col("width") == width).select("item", shingles("w", width).alias("hs"))
        mine = mine.select("item", "hs", F.size("hs").alias("m"), fingerprint("hs").alias("fp"), F.xxhash64("hs").alias("same")).dropDuplicates(["item", "same"])
        index = mine.select("item", "same", "m", F.explode(F.array_distinct("hs")).alias("h"))
        rows = index.count()
        part = _leaks_of_width(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), mine, index, rows, width, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = items.schema[item_col].dataType
        found = df.select(F.col(id_col).alias("id"), F.lit(None).cast(kind).alias("item"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"), F.lit(0).alias("differing_bits")).filter(F.lit(False))
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), (-F.col("differing_bits")).alias("bits"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.before")).alias("start"), F.col("b.similarity").alias("similarity"), (-F.col("b.bits")).alias("differing_bits"))


def _leaks_of_width(docs: DataFrame, items: DataFrame, index: DataFrame, rows: int, width: int, similarity: float, radius: int) -> DataFrame:
    docs = docs.select("id", "text", F.xxhash64("text").alias("t"))
    # The outer forms add no filter on an array's size, which would be pushed below and computed with the words inlined in it.
    places = docs.select("id", "t", words(F.col("text")).alias("w")).select("id", "t", F.posexplode_outer(shingles("w", width)).alias("pos", "h"))
    starts = places.join(small(index, rows), "h").groupBy("id", "t", "item", "same", "m").agg(F.sort_array(F.collect_set("pos")).alias("s"))
    need = f"cast(ceil({similarity} * m - 0.000000001) as int)"
    dense = starts.select("id", "t", "item", "same", "m", F.explode_outer(F.expr(f"filter(s, (x, i) -> coalesce(get(s, i + {need} - 1) < x + m, false))")).alias("start"))
    dense = cut(dense.filter("start IS NOT NULL"))
    n = dense.count()
    ids = dense.select(F.col("id").alias("d_id"), F.col("t").alias("d_t")).distinct()
    own = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_t"))
    matched = docs.join(small(ids, n), own, "left_semi").select("id", "t", words(F.col("text")).alias("w")).select("id", "t", shingles("w", width).alias("hs"))
    matched = cut(matched).dropDuplicates(["id", "t"])
    windows = matched.join(small(dense.withColumnsRenamed({"id": "d_id", "t": "d_t"}), n), own).select("id", "item", "same", "m", "start", F.expr("slice(hs, start + 1, m)").alias("win"))
    windows = windows.groupBy("id", "item", "same", "m", "win").agg(F.min("start").alias("start"))
    windows = cut(windows.withColumn("fp", fingerprint("win")))
    by_block = items.select("item", "same", F.col("fp").alias("item_fp"), F.explode(blocks("fp", radius)).alias("b")).select("item", "same", "item_fp", "b.*")
    probes = windows.select("id", "item", "same", "start", "fp", F.explode_outer(blocks("fp", radius)).alias("b")).select("id", "item", "same", "start", "fp", "b.*")
    within = probes.join(small(by_block, rows * (radius + 1)), ["item", "same", "block", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    within = within.select(F.col("id").alias("p_id"), F.col("item").alias("p_item"), F.col("same").alias("p_same"), F.col("start").alias("p_start")).distinct()
    of_item = F.col("id").eqNullSafe(F.col("p_id")) & F.col("item").eqNullSafe(F.col("p_item"))
    near = _verify(windows.join(within, of_item & (F.col("same") == F.col("p_same")) & (F.col("start") == F.col("p_start")), "left_semi"), items, rows, similarity)
    known = near.select(F.col("id").alias("p_id"), F.col("item").alias("p_item")).distinct()
    return near.unionByName(_verify(windows.join(known, of_item, "left_anti"), items, rows, similarity))


def _verify(windows: DataFrame, items: DataFrame, rows: int, similarity: float) -> DataFrame:
    """The windows whose weighted Jaccard similarity with their item suffices."""
    own = items.select(F.col("item").alias("i_item"), F.col("same").alias("i_same"), F.col("hs").alias("own"), F.col("fp").alias("item_fp"))
    pairs = windows.join(small(own, rows), F.col("item").eqNullSafe(F.col("i_item")) & (F.col("same") == F.col("i_same")))
    shared = F.expr("aggregate(array_distinct(own), 0, (n, h) -> n + least(size(filter(own, x -> x = h)), size(filter(win, x -> x = h))))")
    pairs = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("win") + F.col("m") - F.col("shared")))
    return pairs.filter(F.col("similarity") >= similarity).select("id", "item", "start", "similarity", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("differing_bits"))


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` (all columns) whose id is not that of a row that leaks an item. Rows without an id stay."""
    leaks = cut(find_leaks(df, items, id_col, text_col, **options).select(id_col).distinct())
    return df.join(small(leaks, leaks.count()), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
