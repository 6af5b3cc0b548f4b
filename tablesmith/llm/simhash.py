"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact verification.

A 64-bit fingerprint becomes a vector of bit counts, one for each of 32 two-bit segments. The Manhattan distance of two such
vectors is never above the fingerprints' Hamming distance, so all pairs within radius R are within Manhattan distance R.
The segments are dealt into G groups; a pair within R differs in at most R groups, hence agrees in some set of G - R groups
and meets in the grid cell that this set's counts name. Every cell is then joined in one task: pairs within Manhattan
distance R are verified by exact Hamming distance, and only links that join different local components leave the task, so a
cell of m fingerprints gives at most about m rows whatever the number of its pairs. A cell of more than ``CELL`` fingerprints is dealt
into chunks, and each pair of chunks is a task's group of its own: every pair still meets, and no group grows with the input. Equal
fingerprints count once throughout.

Edge cases: null and empty texts have fingerprint zero, linked like any other; a text of fewer words than a shingle is hashed
whole, very long ones in steps; equal rows share a component; an empty table gives an empty result; null ids are never a component's name unless a
component has no other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import id_and_text, steps, texts
from tablesmith.llm.components import components, cut, small

SEED = 42
#: Fingerprints of one group of a grid's cell.
CELL = 1 << 14
ODD = 0x5555555555555555


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: splits at ASCII white space, lowers A-Z
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 8192], stops[i : i + 8192], strict=True)])
        total += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (long) of every row."""
    src = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(t, width) for t in texts(batch)], pa.int64())], names=[id_col, "fp"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, fp long")


def counts_vector(fp: Column) -> Column:
    """The 32 segment counts in unary (0: 00, 1: 01, 2: 11), so that Manhattan distance is the number of differing bits."""
    other = F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(other)).bitwiseAND(F.lit(ODD)).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(F.lit(ODD)), 1))


def masks(groups: int, radius: int) -> list[int]:
    """The bits of every set of ``groups - radius`` groups of segments, as signed 64-bit integers."""
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    bits = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(chosen) for chosen in combinations(bits, groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def join_cells(grid: np.ndarray, cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the local components of each cell; rows are sorted by (grid, cell)."""
    n = len(fp)
    vector = ((fp | (fp >> np.uint64(1))) & np.uint64(ODD)) | (((fp & (fp >> np.uint64(1))) & np.uint64(ODD)) << np.uint64(1))
    new = np.concatenate([[True], (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])]) if n else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group) if n else np.zeros(0, np.int64)
    left_in_group = (np.cumsum(size)[group] - np.arange(n)) if n else np.zeros(0, np.int64)
    label = np.arange(n)
    out_a, out_b = [], []
    active = np.flatnonzero(left_in_group > 1)
    k = 1
    while len(active):
        a, b = active, active + k
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        near = np.bitwise_count(vector[a] ^ vector[b]) <= radius
        a, b = a[near], b[near]
        same = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[same], b[same]
        if len(a):
            out_a.append(fp[a])
            out_b.append(fp[b])
            label = _merge(label, a, b)
        if k >= 8 and not k & (k - 1):  # a cell that is one component already needs no more pairs
            first = np.flatnonzero(new)
            apart = np.zeros(len(size), dtype=bool)
            apart[group[label != label[first][group]]] = True
            active = active[apart[group[active]]]
        k += 1
        active = active[left_in_group[active] > k]
    if not out_a:
        return fp[:0], fp[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): every row has the smallest label of its component."""
    u, v = label[a], label[b]
    root = np.arange(len(label))
    while True:
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(deeper := root[root], root):
            root = deeper
        if np.array_equal(root[u], root[v]):
            return root[label]


def fitting_groups(n: int, radius: int) -> int:
    """The fewest groups for which a cell of ``n`` evenly spread fingerprints holds some 16 of them at most (10 at least as fine as any)."""
    for groups in range(radius + 3, 10):
        if n <= 16 * 2 ** (1.5 * 32 * (groups - radius) / groups):  # a two-bit segment's count has 1.5 bits
            return groups
    return 10


def links(fps: DataFrame, radius: int = 3, groups: int | None = None) -> DataFrame:
    """``a`` and ``b``: links that connect all fingerprints (distinct rows of ``fp``) within ``radius`` bits as all pairs would."""
    vector = counts_vector(F.col("fp"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), vector.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks(groups or fitting_groups(fps.count(), radius), radius))]))
    dealt = fps.select("fp", cells.alias("c")).select("c.grid", "c.cell", "fp")
    large = cut(dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL))
    if n := large.count():
        chunks = F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: (F.least(own, other) * F.col("chunks") + F.greatest(own, other)).cast("long") * 1000 + F.col("grid"))
        dealt = dealt.join(small(large, n), ["grid", "cell"], "left").withColumn("chunks", chunks).select(F.explode(met).alias("grid"), "cell", "fp")
    dealt = dealt.repartition("grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = join_cells(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(3)]
            rows[2] = rows[2].view(np.uint64)
            kept = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            if len(kept[0]) < 1 << 16:
                continue
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            if len(last):
                stop = last[-1] + 1
                yield out([x[:stop] for x in kept])
                kept = [x[stop:] for x in kept]
        yield out(kept)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, groups: int | None = None) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable by links) of every row.

    ``groups`` sets the grids' selectivity: with more groups a cell fixes more segments, at C(groups, radius) rows for each
    distinct fingerprint. It follows from the number of distinct fingerprints unless given.
    """
    docs = cut(fingerprints(df, id_col, text_col, width))
    own = docs.groupBy("fp").agg(F.min(id_col).alias("least"))
    member = components(links(own.select("fp"), radius, groups))
    named = own.join(member, own.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(of_root, "root").select("fp", "component_id")
    return docs.join(of_fp, "fp").select(id_col, "fp", "component_id")
