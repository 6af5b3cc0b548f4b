"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of the labelled rows gives the examples, one of each group of near copies, lest a copied text fills the neighbours.
All words of all examples are indexed. A word weighs its TF-IDF times its chi-squared with the label among the examples (plus
``FLOOR``, so that no word is without weight): by plain TF-IDF the many rare words, which say nothing of the label, would decide.
Document frequencies come from all rows. Words are 64-bit hashes.

The index holds, for each word, its postings; those of a frequent word stand as a full row in each block of examples, beside its
maximum in the block. A search adds up the postings of the rare words, and for the frequent ones the maxima: a bound for each block.
The blocks of the highest bounds give a first k-th best cosine; every block whose bound reaches it is then scored in full. So the
neighbours are exact, and all that tie with the k-th are in. Their votes, weighted by cosine and shrunk towards the share of label 1,
are calibrated by a logistic curve that is fitted to a tenth of the sample, which the index does not hold. A text without words of
an example gets the share of label 1 among examples without words.

Edge cases: null and empty texts have no words; examples that tie are all taken, so ids decide nothing; repeated rows are scored alike;
rows of ``labels`` or of the table without an id are no examples but are scored; very long texts are read whole; without
examples the score is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm import simhash
from tablesmith.llm.batches import Numbering, id_and_text, list_array, small_batches, steps, texts
from tablesmith.llm.components import cut

WORD = re.compile(r"\w+")
BLOCK = 64
FLOOR = 0.1
#: A word that over one in so many examples holds has full rows in the blocks.
FREQUENT = 20
#: Texts that are searched together, and blocks of each that are scored first. Cosines nearer than TIE are equal; sums in single
#: precision, by which candidates are found before their cosines are added up in double, are within NEAR.
TOGETHER, FIRST, TIE, NEAR = 256, 8, 1e-6, 1e-5
#: Texts whose postings of rare words are added up at once, for less memory.
AT_ONCE = 8
#: Bytes of text that a step works on: the counts of its words take several times as much.
STEP = 1 << 20
#: Words whose places a task remembers.
KEPT_WORDS = 100_000
#: Counts of document frequencies travel in pieces of so many words.
PIECE = 1 << 14


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))


class Places(dict):
    """The places of words among sorted hashes (-1: not there); a task forgets its words beyond ``KEPT_WORDS`` of them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def of(self, names: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(names) if w not in self]
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list(dict.fromkeys(names))
        if new:
            own = hashes(new)
            at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
            self.update(zip(new, np.where(self.keys[at] == own, at, -1).tolist() if len(self.keys) else [-1] * len(new), strict=True))
        return np.fromiter(map(self.__getitem__, names), np.int64, len(names))


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def none(kind: type) -> np.ndarray:
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class Index:
    """Postings (example and count) by word. Weights and blocks are worked out where a search first needs them, so that little is broadcast."""

    ids: list = field(default_factory=list)
    labels: np.ndarray = none(float)
    keys: np.ndarray = none(np.uint64)
    idf: np.ndarray = none(float)
    marked: np.ndarray = none(bool)
    first: np.ndarray = none(np.int32)
    at: np.ndarray = none(np.int32)
    n: np.ndarray = none(np.int32)
    share: float = 0.0
    bare: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    @staticmethod
    def build(examples: list[tuple], idf: dict[str, float], share: float, bare: float) -> Index:
        """``examples``: (id, label, {term: count}) in the order of ids; ``idf``: the weight of each term."""
        known = [(i, t, n) for i, (_, _, counts) in enumerate(examples) for t, n in counts.items() if t in idf]
        names = hashes(list(idf))
        order = np.argsort(names)
        keys = names[order]
        labels, weights = np.array([e[1] for e in examples], dtype=float), np.array(list(idf.values()), dtype=float)[order]
        doc, times = np.array([i for i, _, _ in known], np.int32), np.array([n for _, _, n in known])
        term = np.searchsorted(keys, hashes([t for _, t, _ in known]))
        return Index.of([e[0] for e in examples], labels, keys, weights, np.ones(len(keys), bool), doc, term, times, share, bare)

    @staticmethod
    def of(ids: list, labels: np.ndarray, keys: np.ndarray, idf: np.ndarray, marked: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray, share: float, bare: float) -> Index:
        """From parallel arrays of example, place in ``keys`` and count."""
        order = np.argsort(term.astype(np.int64) * len(ids) + doc)
        first = np.append(0, np.cumsum(np.bincount(term, minlength=len(keys))))
        return Index(ids, labels, keys, idf, marked, narrow(first), narrow(doc[order]), narrow(n[order]), share, bare)

    @cached_property
    def blocks(self) -> tuple[np.ndarray, ...]:
        """The examples in the order of the blocks (those of a like frequent word together, which makes bounds tight), each frequent
        word's place among these (-1: rare), their full rows and maxima by block, and the rare words' postings with their weights."""
        size = np.diff(self.first.astype(np.int64))
        weight = np.log(self.n, dtype=np.float32)
        weight += 1
        weight *= np.repeat(self.idf.astype(np.float32), size)
        weight /= np.sqrt(np.bincount(self.at, weight * weight, len(self.ids))).astype(np.float32)[self.at]
        often = size > max(BLOCK, len(self.ids) // FREQUENT)
        on, term = np.repeat(often, size), np.repeat(np.arange(len(size), dtype=np.int32), size)
        most = np.lexsort((size[term[on]], self.n[on], self.at[on]))
        chief = np.full(len(self.ids), -1)
        chief[self.at[on][most]] = term[on][most]  # the last one of each example stays
        order = np.argsort(chief, kind="stable")
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        at = at[self.at]
        place = np.where(often, np.cumsum(often) - 1, -1)
        full = np.zeros((-(-len(self.ids) // BLOCK), int(often.sum()), BLOCK), np.float32)
        full[at[on] // BLOCK, place[term[on]], at[on] % BLOCK] = weight[on]
        first = np.append(0, np.cumsum(np.where(often, 0, size)))
        return order, place, full, full.max(axis=2), first, at[~on], weight[~on]

    def __getstate__(self) -> bytes:
        return zlib.compress(pickle.dumps({k: v for k, v in self.__dict__.items() if k not in ("blocks", "places")}, 5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))

    @cached_property
    def places(self) -> Places:
        return Places(self.keys)

    def queries(self, texts: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all known terms of all texts: the text's number, the term's place and its weight in the text's unit vector."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        term = self.places.of([w for t in texts for w in t])
        times = np.fromiter((n for t in texts for n in t.values()), float, len(term))
        known = term >= 0
        row, term = np.repeat(np.arange(len(texts)), size)[known], term[known]
        weight = (1 + np.log(times[known])) * self.idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight * weight, len(texts)))[row]

    def evidence(self, counts: dict[str, int]) -> list[str]:
        """The text's terms that speak for label 1 beyond chance."""
        names = list(counts)
        term = self.places.of(names)
        return sorted(names[i] for i in np.flatnonzero(term >= 0) if self.marked[term[i]])

    def nearest(self, texts: list[dict[str, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the ``k`` examples of highest positive cosine and all that tie with the last of them, best first, with the cosines."""
        if not self.ids:
            return [(np.zeros(0, int), np.zeros(0))] * len(texts)
        # Texts of a like most frequent word, as those of one language, mostly need the same blocks.
        order = sorted(range(len(texts)), key=lambda i: max(zip(texts[i].values(), texts[i], strict=True), default=(0, ""))[1])
        out: list = [None] * len(texts)
        parts = -(-len(order) // TOGETHER)
        for p in range(parts):
            own = order[p * len(order) // parts : (p + 1) * len(order) // parts]
            for j, near in zip(own, self._together([texts[j] for j in own], k), strict=True):
                out[j] = near
        return out

    def _together(self, texts: list[dict[str, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        order, place, full, most, first, at, weight = self.blocks
        row, term, q = self.queries(texts)
        start, width = np.searchsorted(row, np.arange(len(texts) + 1)), len(full) * BLOCK
        rare = np.empty((len(texts), width))
        for i in range(0, len(texts), AT_ONCE):
            own = slice(start[i], start[min(i + AT_ONCE, len(texts))])
            lo, hi = first[term[own]], first[term[own] + 1]
            entry, n = ranges(lo, hi), min(AT_ONCE, len(texts) - i)
            rare[i : i + n] = np.bincount(np.repeat((row[own] - i) * width, hi - lo) + at[entry], np.repeat(q[own], hi - lo) * weight[entry], n * width).reshape(n, width)
        score = rare.astype(np.float32).reshape(len(texts), len(full), BLOCK)
        often = place[term] >= 0
        dense = np.zeros((len(texts), full.shape[1]), np.float32)
        dense[row[often], place[term[often]]] = q[often]
        bound = score.max(axis=2) + dense @ most.T
        done = np.zeros(bound.shape, dtype=bool)

        def fill(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)):
                rows = wanted[:, block]
                if 4 * np.count_nonzero(rows) > 3 * len(rows) and not done[:, block].any():
                    score[:, block] += dense @ full[block]
                    done[:, block] = True
                else:
                    score[rows, block] += dense[rows] @ full[block]
                    done[rows, block] = True

        top = np.argpartition(-bound, min(FIRST, len(full)) - 1, axis=1)[:, :FIRST]
        wanted = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(wanted, top, True, axis=1)
        fill(wanted)
        tops = np.take_along_axis(score, top[:, :, None], axis=1).reshape(len(texts), -1)
        least = np.partition(tops, -k, axis=1)[:, -k] - NEAR if tops.shape[1] >= k else np.full(len(texts), -NEAR)
        fill(~done & (bound > 0) & (bound >= least[:, None]))
        score[~done] = 0
        out = []
        for i, (own, low) in enumerate(zip(score.reshape(len(texts), width), least, strict=True)):
            near = np.flatnonzero((own > 0) & (own >= low))
            if len(near) > k:
                near = near[own[near] >= np.partition(own[near], -k)[-k] - NEAR]
            at_ = slice(start[i], start[i + 1])
            frequent = often[at_]
            exact = rare[i, near] + q[at_][frequent] @ full[near[None, :] // BLOCK, place[term[at_][frequent]][:, None], near[None, :] % BLOCK].astype(float)
            if len(near) > k:
                on = exact >= np.partition(exact, -k)[-k] - TIE
                near, exact = near[on], exact[on]
            best = np.argsort(-exact, kind="stable")
            out.append((order[near[best]], exact[best]))
        return out

    def votes(self, texts: list[dict[str, int]], k: int, prior: float) -> list[tuple[float, np.ndarray]]:
        """Each text's share of votes for label 1, before calibration (nan: no neighbour), and its neighbours."""
        return [(float((c @ self.labels[near] + prior * self.share) / (c.sum() + prior)) if len(near) else np.nan, near) for near, c in self.nearest(texts, k)]

    def calibrated(self, vote: float) -> float:
        if np.isnan(vote):
            return self.bare
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -500, 500)))) if self.slope > 0 else vote

    def scores(self, texts: list[dict[str, int]], k: int, prior: float) -> list[tuple[float, np.ndarray]]:
        return [(self.calibrated(v), near) for v, near in self.votes(texts, k, prior)]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, with targets drawn in from 0 and 1 by the number of rows; (0, 0) without both labels."""
    n1 = int(y.sum())
    if not 0 < n1 < len(y):
        return 0.0, 0.0
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    both = np.stack([x, np.ones(len(x))], axis=1)
    beta = np.array([0.0, np.log(n1 / (len(y) - n1))])

    def loss(b: np.ndarray) -> float:
        z = both @ b
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(both @ beta, -500, 500)))
        step = np.linalg.solve(both.T @ (both * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), both.T @ (target - p))
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(df: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_examples: int = 20_000, k: int = 15, prior: float = 1.0) -> Index:
    """Build the index from about ``max_examples`` rows of ``labels`` where ``learn`` holds, drawn by a hash of the id.

    ``max_examples`` bounds the index by the words of so many texts, so it may be broadcast; frequencies cover all rows of ``df``.
    A tenth of the sample stays out of the index: the votes on it, for ``k`` and ``prior``, give the calibration.
    """
    known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    if not n:
        return Index()
    known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < 1_000_000 * max_examples / n).groupBy("id").agg(F.max("label").alias("label"))
    rows = id_and_text(df, id_col, text_col)
    sample = cut(rows.join(F.broadcast(known), "id").select("id", "text", "label"))  # at most about max_examples narrow rows
    alone = simhash.near_duplicates(sample, "id").filter("id = component_id").select("id").distinct()
    sample = cut(sample.join(F.broadcast(alone), "id").dropDuplicates(["id"]))
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(10)) == 0

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP):
            found = [Counter(words(t)) for t in texts(batch)]
            sizes = np.array([len(f) for f in found], dtype=np.int32)
            flat = hashes([w for f in found for w in f]).view(np.int64)
            times = np.array([n for f in found for n in f.values()], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), list_array(flat, sizes, pa.int64()), list_array(times, sizes, pa.int32())], names=["id", "label", "h", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    got = sample.filter(~apart).mapInArrow(vectors, f"id {kind}, label int, h array<long>, n array<int>").toArrow()
    if not got.num_rows:
        return Index()
    ids, label = got.column("id").to_pylist(), np.asarray(got.column("label")) > 0
    h, times = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(c.flatten()) for c in got.column(x).chunks)]) for x in ("h", "n"))
    size = np.concatenate([np.asarray(c.value_lengths()) for c in got.column("h").chunks])
    del got
    order = sorted(range(len(ids)), key=ids.__getitem__)
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    place = np.argsort(h.view(np.uint64)).astype(np.int32)
    h = h.view(np.uint64)[place]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    keys, term = h[new], np.empty(len(h), np.int32)
    term[place] = np.cumsum(new, dtype=np.int32) - 1
    del h, new, place
    t1, t = int(label.sum()), len(ids)
    n1 = np.bincount(term[np.repeat(label, size)], minlength=len(keys)).astype(float)
    both = np.bincount(term, minlength=len(keys))
    t0 = t - t1
    chi = t * (n1 * t0 - (both - n1) * t1) ** 2 / np.maximum(both * (t - both) * float(max(t1, 1)) * max(t0, 1), 1)
    marked = (chi >= 2.5 * log(max(len(keys), 2))) & (n1 * t > both * t1)
    held = df.sparkSession.sparkContext.broadcast(keys)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, seen = Places(held.value), np.zeros(len(held.value) + 1, dtype=np.int32)  # the last one counts rows
        for batch in steps(batches, STEP):
            rows = texts(batch)
            held_by = Counter()
            for text in rows:
                held_by.update(set(words(text)))
            found = places.of(list(held_by))
            seen[found[found >= 0]] += np.fromiter(held_by.values(), np.int32, len(found))[found >= 0]
            seen[-1] += len(rows)
        if seen[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-(-len(seen) // PIECE)), pa.int64()), pa.array([seen[i : i + PIECE].tobytes() for i in range(0, len(seen), PIECE)], pa.binary())], names=["piece", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                one = np.frombuffer(n, np.int32)
                seen[piece] = seen[piece] + one if piece in seen else one.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["piece", "n"])

    pieces = rows.select("text").mapInArrow(frequency, "piece long, n binary").repartition("piece").mapInArrow(total, "piece long, n binary").collect()
    df_of = np.concatenate([np.frombuffer(r["n"], np.int64) for r in sorted(pieces, key=lambda r: r["piece"])])
    held.destroy()
    idf = (np.log((df_of[-1] + 1) / (df_of[:-1] + 1)) + 1) * (chi + FLOOR)
    idf = idf.astype(np.float32)
    bare = label[size == 0]
    share = t1 / t
    index = Index.of([ids[i] for i in order], label[order].astype(float), keys, idf, marked, np.repeat(rank, size), term, times, share, (int(bare.sum()) + share) / (len(bare) + 1))
    held = df.sparkSession.sparkContext.broadcast(index)
    known = vote(sample.filter(apart), held, k, prior).toArrow()  # about a tenth of max_examples
    held.destroy()
    x, y = np.asarray(known.column("vote")), np.asarray(known.column("label")).astype(float)
    index.slope, index.shift = logistic(x[~np.isnan(x)], y[~np.isnan(x)])
    return index


def vote(sample: DataFrame, held: Broadcast, k: int, prior: float) -> DataFrame:
    """``vote`` (before calibration, by a broadcast index) and ``label`` of rows with ``text`` and ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP):
            got = held.value.votes([Counter(words(t)) for t in texts(batch)], k, prior)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.float64()), batch.column("label")], names=["vote", "label"])

    return sample.select("text", "label").mapInArrow(run, "vote double, label int")


def score(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", k: int = 15, prior: float = 1.0) -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``neighbours`` (ids of the nearest examples) and ``terms`` (those found that speak for label 1 beyond chance) of every row."""
    src = id_and_text(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in steps(batches, STEP):
            rows = texts(batch)
            number = Numbering()
            place = [number[t] for t in rows]  # equal texts of a step are searched once
            found = [Counter(words(t)) for t in number]
            got = []
            for counts, (value, near) in zip(found, index.scores(found, k, prior), strict=True):
                got.append((value, [str(index.ids[i]) for i in near], index.evidence(counts)))
            columns = zip(*[got[i] for i in place], strict=True) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), kind) for c, kind in zip(columns, (pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True))], names=[id_col, "score", "neighbours", "terms"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, score double, neighbours array<string>, terms array<string>")


def keep_clean(df: DataFrame, index: Index, text_col: str = "text", threshold: float = 0.5, k: int = 15, prior: float = 1.0) -> DataFrame:
    """The rows of ``df`` (all columns) whose text scores below ``threshold``."""
    small_batches(df)
    at = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, STEP, at):
            number = Numbering()
            place = [number[t or ""] for t in batch.column(at).to_pylist()]
            got = held.value.scores([Counter(words(t)) for t in number], k, prior)
            yield batch.filter(pa.array([got[i][0] < threshold for i in place], pa.bool_()))

    return df.mapInArrow(run, df.schema)
