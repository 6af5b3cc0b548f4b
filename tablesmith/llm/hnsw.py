"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one class, so that copies cost nothing. Classes are dealt into shards by a hash; each shard's task builds
a layered graph and then reads every class as a query, in batches. A beam is widened until an audit of some queries of each batch
against all vectors of the shard finds enough of their links to other vectors; a query whose whole beam is linked is compared with all
members, by products of bounded size. Audits are pooled over batches; until they have seen ``FLOOR`` true links, more queries are audited and the beam is twice as
wide. The links that all audits saw, and those of them that were found, are returned.
Cosines are verified in double precision. A task gives each query's number of links and only those links that join different
local components, so a large group of near copies never becomes all of its pairs.

Every shard is queried with every class: the work is classes times shards times the logarithm of a shard's size. The number of shards stays
the same until a shard would exceed ``shard_rows``.

Edge cases: a cosine of exactly ``least``, as double precision gives it, is a link; ids are cast to long; vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows without an
id; vectors of different length do not link; rows that share an id are one vertex; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import apart
from tablesmith.llm.components import components, cut

DEGREE, BUILD_BEAM, BEAM, BATCH = 12, 32, 24, 1024
#: Audited queries of a batch (four times as many below the floor), the share of their links that must be found, true links to be seen.
AUDIT, RECALL, FLOOR = 48, 0.99, 100
#: Cosines that a product of queries and members gives at once.
PRODUCT = 1 << 22


class Graph:
    """A layered graph over unit vectors, built by inserting batches."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        self.top = int(np.sort(level)[-1]) if n else 0
        self.adjacent = [np.full((n, 2 * DEGREE if layer == 0 else DEGREE), -1, dtype=np.int32) for layer in range(self.top + 1)]
        order = np.argsort(-level, kind="stable")  # upper layers first, so that every insertion finds its layers
        self.entry = int(order[0]) if n else -1
        done = min(n, 1)
        while done < n:
            step = order[done : done + max(1, min(done, 512))]
            self._insert(step, level)
            done += len(step)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        ids = np.full((len(new), 1), self.entry, dtype=np.int32)
        for layer in range(self.top, -1, -1):
            ids, sims = self.beam(self.v[new], ids, layer, BUILD_BEAM if layer <= level[new].max() else 1)
            rows = np.flatnonzero(level[new] >= layer)
            if not len(rows):
                continue
            own = new[rows]
            within = self.v[own] @ self.v[own].T
            np.fill_diagonal(within, -2)
            k = min(BUILD_BEAM, len(own) - 1)
            near = np.argpartition(-within, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(own), 0), dtype=int)
            cand = np.concatenate([ids[rows], own[near]], axis=1).astype(np.int32)
            sims_ = np.concatenate([sims[rows], np.take_along_axis(within, near, axis=1)], axis=1)
            kept = self._select(cand, sims_, DEGREE)
            self.adjacent[layer][own, :DEGREE] = kept
            self._link_back(own, kept, layer)

    def _select(self, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Up to ``degree`` of each row's candidates: those nearer to the row than to one already taken first, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * degree]
        cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
        v = self.v[cand]
        between = v @ v.transpose(0, 2, 1)
        rows, width = cand.shape
        taken = np.zeros((rows, width), dtype=bool)
        for j in range(width):
            blocked = (taken[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(axis=1) if j else np.zeros(rows, dtype=bool)
            taken[:, j] = ~blocked & (cand[:, j] >= 0) & (sims[:, j] > -2)
        rank = np.where(taken, 0, 1) + np.where((cand < 0) | (sims <= -2), 2, 0)
        first = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        out = np.take_along_axis(cand, first, axis=1)
        out[np.take_along_axis(rank, first, axis=1) >= 2] = -1
        return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)

    def _link_back(self, own: np.ndarray, kept: np.ndarray, layer: int) -> None:
        target, source = kept.ravel(), np.repeat(own, kept.shape[1])
        on = target >= 0
        target, source = target[on], source[on]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(first, count)
        degree = self.adjacent[layer].shape[1]
        on = slot < 2 * degree
        extra = np.full((len(nodes), min(int(count.max()), 2 * degree)), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(nodes)), count)[on], slot[on]] = source[on]
        held = self.adjacent[layer][nodes]
        extra[(extra[:, :, None] == held[:, None, :]).any(axis=2)] = -1
        cand = np.concatenate([held, extra], axis=1)
        sims = np.einsum("ijk,ik->ij", self.v[cand], self.v[nodes])
        sims[cand < 0] = -3
        self.adjacent[layer][nodes] = self._select(cand, sims, degree)

    def beam(self, queries: np.ndarray, ids: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, from the nodes ``ids``; -1 and -3 where there are fewer."""
        ids = np.pad(ids[:, :width], ((0, 0), (0, max(0, width - ids.shape[1]))), constant_values=-1)
        sims = np.einsum("ijk,ik->ij", self.v[ids], queries)
        sims[ids < 0] = -3
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        open_ = ids >= 0
        active = np.arange(len(queries))
        while True:
            active = active[open_[active].any(axis=1)]
            if not len(active):
                return ids, sims
            best = open_[active].argmax(axis=1)
            near = self.adjacent[layer][ids[active, best]]
            open_[active, best] = False
            near = np.where((near[:, :, None] == ids[active][:, None, :]).any(axis=2), -1, near)
            found = np.einsum("ijk,ik->ij", self.v[near], queries[active])
            found[near < 0] = -3
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_open = np.concatenate([open_[active], near >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active], sims[active], open_[active] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_sims, all_open))

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        queries = queries.astype(np.float32)
        ids = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for layer in range(self.top, 0, -1):
            ids, _ = self.beam(queries, ids, layer, 4)
        return self.beam(queries, ids, 0, width)[0]


class Shard:
    """The vectors of a shard, their graph, the beam that audits have asked for so far, and which members are known to be linked to each other.

    ``label`` has a member of the same component for each member. Links of a query to members of one label say the same, so one of them is kept:
    a dense cluster gives a few links a query, not its square.
    """

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies, self.v, self.graph, self.width = ids, copies, vectors, Graph(vectors), BEAM
        self.true = self.hit = 0
        self.label = np.arange(len(ids))

    def linked(self, ids: np.ndarray, vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the number of rows it is linked to at cosine ``least`` or more, and a forest of ids that these links connect."""
        n, few = len(self.ids), self.true < FLOOR
        audited = np.zeros(len(vectors), dtype=bool)
        audited[np.linspace(0, len(vectors) - 1, min(AUDIT * (4 if few else 1), len(vectors))).astype(int)] = True
        truth = [q * n + m for q, m in self._products(vectors, np.flatnonzero(audited), least) for other in [ids[q] != self.ids[m]] for q, m in [(q[other], m[other])]]
        truth = np.sort(np.concatenate(truth)) if truth else np.zeros(0, dtype=np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            width = min(self.width * (2 if few else 1), n)
            counts, hit = np.zeros(len(ids)), 0
            for q, m in self._found(vectors, width, least):
                other = ids[q] != self.ids[m]
                q, m = q[other], m[other]
                counts += np.bincount(q, weights=self.copies[m], minlength=len(ids))
                seen = audited[q]
                hit += int(np.isin(truth, q[seen] * n + m[seen]).sum())
                edges.append(self._joined(q, m))
            if width >= n or self.hit + hit >= RECALL * (self.true + len(truth)):
                self.true, self.hit = self.true + len(truth), self.hit + hit
                a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
                return counts.astype(np.int64), *_forest(ids[a], self.ids[b])
            self.width *= 2

    def _joined(self, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links with one member for each query and label; the labels that a query joins become one."""
        m = self.label[m]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (m[1:] != m[:-1])
        q, m = q[new], m[new]
        node, root = _forest(q + len(self.ids), m)
        same = np.arange(len(self.ids))
        members = node < len(same)
        same[node[members]] = root[members]
        self.label = same[self.label]
        return q, m

    def _products(self, vectors: np.ndarray, which: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of some queries, by products of bounded size."""
        step = max(1, PRODUCT // max(1, len(self.ids)))
        for i in range(0, len(which), step):
            q, m = np.nonzero(vectors[which[i : i + step]] @ self.v.T >= least)
            yield which[i + q], m

    def _found(self, vectors: np.ndarray, width: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query and a member. A query whose whole beam is near enough has more than it: it is compared with all members, at a known cost."""
        full, step = [], max(16, BATCH * 32 // width)
        for i in range(0, len(vectors) if width < len(self.ids) else 0, step):
            own = np.arange(i, min(i + step, len(vectors)))
            ids = self.graph.search(vectors[own], width)
            near = (np.einsum("ijk,ik->ij", self.v[ids], vectors[own]) >= least) & (ids >= 0)
            whole = near.all(axis=1)
            full.append(own[whole])
            q, at = np.nonzero(near & ~whole[:, None])
            yield own[q], ids[q, at]
        yield from self._products(vectors, np.concatenate(full) if full else np.arange(len(vectors)), least)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a, b) one to the root for each node, roots being the smallest ids of local components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(deeper := root[root], root):
            root = deeper
        if np.array_equal(root[u], root[v]):
            break
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


FOUND = ["a", "b", "n", "audited", "seen"]


def _link(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come by (target, dim, query): first a shard's members, then all queries to it."""
    shard, key, members = None, None, []

    def audit() -> Iterator[pa.RecordBatch]:
        if shard is not None:
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array([shard.true]), pa.array([shard.hit])], names=FOUND)

    for batch in batches:
        marks = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("target", "dim", "query")], axis=1)
        bounds = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            if start == stop:
                continue
            target, dim, query = marks[start].tolist()
            part = batch.slice(start, stop - start)
            rows = (np.asarray(part.column("id")), np.asarray(part.column("copies")), _unit(part.column("vec"), dim))
            if (target, dim) != key:
                yield from audit()
                shard, key, members = None, (target, dim), []
            if not query:
                members.append(rows)
                continue
            if not members and shard is None:
                continue  # no vector of this length in the shard
            if shard is None:
                shard, members = Shard(*(np.concatenate(x) for x in zip(*members, strict=True))), []
            ids, _, vectors = rows
            for i in range(0, len(ids), BATCH):
                n, u, v = shard.linked(ids[i : i + BATCH], vectors[i : i + BATCH], least)
                own = ids[i : i + BATCH][n > 0]
                none, nothing = pa.nulls(len(own), pa.int64()), pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(own), none, pa.array(n[n > 0]), none, none], names=FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), nothing, nothing, nothing], names=FOUND)
    yield from audit()


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, min_shards: int = 8, shard_rows: int = 250_000) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row; links are pairs of cosine ``least`` or more.

    ``audited_links`` and ``found_links``: the true links that the audits of all shards saw and those of them that the searches found.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    good = F.col("id").isNotNull() & F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = cut(rows.filter(good).groupBy("vec").agg(F.min("id").alias("class"), F.count("*").alias("copies")))
    shards = max(min_shards, ceil(classes.count() / shard_rows))
    dealt = classes.select(F.col("class").alias("id"), "copies", "vec", F.size("vec").alias("dim"))
    numbers = apart(df.sparkSession, shards)
    target = F.element_at(F.lit(numbers), (F.pmod(F.xxhash64("id", "vec"), F.lit(shards)) + 1).cast("int")).cast("int")
    members = dealt.select(target.alias("target"), "dim", F.lit(False).alias("query"), "id", "copies", "vec")
    queries = dealt.select(F.explode(F.lit(numbers)).alias("target"), "dim", F.lit(True).alias("query"), "id", "copies", "vec")
    found = cut(members.unionByName(queries).repartition(shards, "target").sortWithinPartitions("target", "dim", "query").mapInArrow(lambda b: _link(b, least), ", ".join(f"{c} long" for c in FOUND)))
    audited, seen = found.agg(F.coalesce(F.sum("audited"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b IS NOT NULL")).select(F.col("node").alias("class"), "root")
    named = classes.join(links, "class", "left").join(roots, "class", "left").select("vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("component_id"))
    own = rows.filter(good).join(named, "vec").select("id", "n_links", "component_id")
    rest = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = own.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(audited).cast("long").alias("audited_links"), F.lit(seen).cast("long").alias("found_links"))
