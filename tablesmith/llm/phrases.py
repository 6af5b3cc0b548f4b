"""Phrase collocations mined with one FM-index per shard of text.

A shard is a bounded stretch of documents whose words are numbered; numbers of different languages differ, and a separator stands between pieces.
Its FM-index (Burrows-Wheeler transforms of the text and of its reverse, sorted as deep as phrases are long) keeps every phrase as a
pair of synchronised intervals. One step extends all intervals of a length by one word to the left and to the right at once; a phrase that
both its beginning (extended right) and its end (extended left) lead to is counted, with both of them: each count is an extension of two shorter
phrases. Words are summed up by Spark first, and rare ones end a piece, since no phrase is more frequent than a part of it. Then a shard sends its longest
phrases, and shorter ones as often as nothing follows them: their order is that of their beginnings, so they go to parts, which are ranges of it, as
sorted and compressed lists, and in a part the phrases that begin alike are a run whose sum is the count of that beginning. What a shard sends is
in proportion to its words, however many phrases are frequent; only runs at the ends of parts are added up afterwards. The ranges follow from a
bounded sample, on which no result depends, so nothing is ever whole in one place.

Words are named by their places in a stored table, the most frequent first, and phrases by lists of these, so counts are exact; scores are computed with decimals of 38 digits.

Edge cases: a null text has no words and a null lang is ``und``; an empty text or table has no phrases; a text that is longer than a shard is a shard of its
own; rows are counted one by one whether or not they are equal; no id is read, and neither are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.batches import blocks, small_batches
from tablesmith.llm.components import small, stored

#: Bytes of text in a shard: a larger one has fewer different phrases for each word, and takes more memory.
SHARD_BYTES = 4 << 20
#: Phrases that a task sends at a time.
SENT_ROWS = 1 << 15
#: Words of the table for each part of the phrases: about as many phrases, at most, are sorted at a time.
PART_WORDS = 2 << 20
#: Shards and places in each that the ranges of the parts follow from.
SAMPLED_SHARDS, SAMPLED_PLACES = 16, 1600
LONGEST = 5
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A-Z, a space for a tab, a line's end for the end of a piece.
BYTES = bytes(ord("\n") if b in PIECE_ENDS else ord(" ") if b == ord("\t") else b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))


class FmIndex:
    """Intervals of a text (0 at its end and wherever no phrase may reach over, words from 1 on) sorted by its first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, reach = text.astype(np.int32), 1
        order = np.argsort(rank)
        while reach < depth:
            step = min(reach, depth - reach)
            key = rank.astype(np.int64)
            key *= int(rank.max(initial=0)) + 1
            key += np.roll(rank, -step)
            order = np.argsort(key)
            key = key[order]
            rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
            rank[order[:1]] = 0
            reach += step
        self.bwt = text[order - 1]  # before the first symbol stands the last
        self.first = np.searchsorted(np.sort(text), np.arange(int(text.max(initial=0)) + 2))
        rows = self.bwt.astype(np.int64) * len(text)
        rows += np.arange(len(text))
        rows.sort()
        rows %= max(1, len(text))
        self.before = np.empty(len(text), dtype=np.int32)  # the row of the suffix that begins one symbol earlier
        self.before[rows] = np.arange(len(text), dtype=np.int32)

    def extend(self, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of intervals by the symbol before: the interval's number, the symbol, the new interval's start and size, and how many
        rows of the old interval have a smaller symbol, which is where the new interval begins within the old one in the index of the reverse."""
        ends = np.cumsum(n)
        of = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(of)) + np.repeat(low - (ends - n), n)
        key = of * len(self.first) + self.bwt[rows]
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        size = np.diff(np.append(starts, len(key)))
        earliest = np.minimum.reduceat(rows[order], starts) if len(starts) else starts
        of, symbol = key[starts] // len(self.first), key[starts] % len(self.first)
        smaller = starts - (ends - n)[of]
        word = symbol > 0
        return of[word], symbol[word], self.before[earliest[word]], size[word], smaller[word]


def enumerate_phrases(text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 to ``longest``: the phrases of a text (a row of word numbers each) and their counts."""
    for phrases, n, _ in _extended(text, longest):
        yield phrases, n


def _extended(text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``enumerate_phrases``, with the place that each phrase without its last word has among those of one word less."""
    if len(text) < 3:
        return
    ahead, back = FmIndex(text, longest), FmIndex(text[::-1], longest)
    present = np.unique(text)
    words = present[present > 0]
    low = ahead.first[words]
    low_back, n, phrases = low.copy(), ahead.first[words + 1] - low, words[:, None].astype(np.int32)
    for _ in range(1, longest):
        end, _, left, size, smaller = ahead.extend(low, n)  # a word put before a phrase
        left_back = low_back[end] + smaller
        start, word, _, _, smaller = back.extend(low_back, n)  # a word put after one
        right = low[start] + smaller
        _, by_left, by_right = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        phrases = np.concatenate([phrases[start[by_right]], word[by_right, None].astype(np.int32)], axis=1)
        low, low_back, n = left[by_left], left_back[by_left], size[by_left]
        if not len(n):
            return
        yield phrases, n, start[by_right]


def _packed(text: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(text.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each shard's number, its text as numbers, and its words with their counts."""
    part = TaskContext.get().partitionId()
    for k, docs in enumerate(blocks(batches, shard_bytes)):
        langs = pc.fill_null(docs.column("lang").combine_chunks(), "und").dictionary_encode()
        of = np.asarray(langs.indices)
        texts = pc.fill_null(docs.column("text").combine_chunks().cast(pa.large_binary()), b"").to_pylist()
        words, sizes = [], []
        for t in texts:
            own = t.translate(BYTES).replace(b"\n", b" \n ").split(b" ")
            words.append(b"\n")
            words += filter(None, own)
            sizes.append(len(words))
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        names, index = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        kind = np.repeat(of, np.diff(sizes, prepend=0)) * max(1, len(names)) + index
        ends = int(pc.index(names, pa.scalar(b"\n", pa.large_binary())).as_py()) if len(names) else 0
        word = index != ends
        distinct, number, n = np.unique(kind[word], return_inverse=True, return_counts=True)
        text = np.zeros(len(index), dtype=np.int32)
        text[word] = number + 1
        text = np.append(text[np.concatenate([text[1:] != 0, [False]]) | (text != 0)], 0).astype(np.int32)  # one separator between pieces
        columns = [pa.array(langs.dictionary.take(pa.array(distinct // len(names))) if len(names) else []), names.take(pa.array(distinct % max(1, len(names)))).cast(pa.string()), pa.array(n, pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), c) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([len(text)]), pa.array([_packed(text)], pa.binary()), *lists], names=["shard", "size", "text", "langs", "words", "counts"])


def _common_text(shard: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's text, with rare words as ends of pieces, and the names of its words. ``answers``: the shard's numbers of frequent words and their names."""
    local, name = (answers.column(c).to_numpy() for c in ("local", "id"))
    text = _unpacked(shard.column("text")[0].as_py(), shard.column("size")[0].as_py()) if shard.num_rows else np.zeros(0, dtype=np.int32)
    names = np.zeros(max(int(text.max(initial=0)), int(local.max(initial=0))) + 1, dtype=np.int32)
    names[local] = name
    text = np.where(names[text] > 0, text, 0)
    return text[(text != 0) | (np.roll(text, 1) != 0)], names


def _sampled(shard: pa.Table, answers: pa.Table, longest: int) -> pa.Table:
    """The phrases at some places of a shard."""
    text, names = _common_text(shard, answers)
    text = np.append(names[text], np.zeros(longest, dtype=np.int32))
    places = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
    places = places[np.linspace(0, len(places) - 1, min(len(places), SAMPLED_PLACES)).astype(np.int64)] if len(places) else places
    rows = text[places[:, None] + np.arange(longest)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    return pa.table({"row": pa.array([r.astype(">i4").tobytes() for r in rows], pa.binary())})


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The order of rows of numbers."""
    wide = rows.astype(np.int64)
    return np.lexsort([(wide[:, i] << 32) + (wide[:, i + 1] if i + 1 < rows.shape[1] else 0) for i in range(0, rows.shape[1], 2)][::-1])


def _sent(shard: pa.Table, answers: pa.Table, longest: int, bounds: list[bytes]) -> pa.Table:
    """A shard's phrases of ``longest`` words, and shorter ones as often as no word follows, to each part (those from one of ``bounds`` on): how many, and their words and counts."""
    text, names = _common_text(shard, answers)
    rows, counts = [np.zeros((0, longest), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    before = None
    for phrases, n, start in _extended(text, longest):
        if before is not None:
            counts[-1] -= np.bincount(start, weights=n, minlength=before).astype(np.int64)
        own = np.zeros((len(n), longest), dtype=np.int32)
        own[:, : phrases.shape[1]] = names[phrases]
        rows.append(own)
        counts.append(n.astype(np.int64))
        before = len(n)
    found = [(r[n > 0], n[n > 0]) for r, n in zip(rows, counts, strict=True)]
    rows, counts = np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])
    order = _sorted(rows)
    rows, counts = rows[order], counts[order].astype(np.int32)
    keys = np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * longest}").ravel()
    ends = np.concatenate([[0], np.searchsorted(keys, np.array(bounds, dtype=f"S{4 * longest}")), [len(rows)]]).astype(np.int64)
    parts = np.flatnonzero(ends[1:] > ends[:-1])
    packed = [_packed(np.concatenate([np.diff(rows[i:j, 0], prepend=0), rows[i:j, 1:].T.ravel(), counts[i:j]])) for i, j in zip(ends[parts], ends[parts + 1], strict=True)]
    return pa.table({"part": pa.array(parts, pa.int32()), "size": pa.array((ends[1:] - ends[:-1])[parts], pa.int64()), "sent": pa.array(packed, pa.binary())})


def _counted(messages: pa.Table, longest: int, min_count: int) -> pa.Table:
    """The frequent phrases of a part with their counts, and those at its ends, which the parts beside it may have too."""
    found = [_unpacked(m, n * (longest + 1)).reshape(longest + 1, n) for m, n in zip(messages.column("sent").to_pylist(), messages.column("size").to_pylist(), strict=True)]
    for f in found:
        np.cumsum(f[0], out=f[0])
    columns = np.concatenate(found, axis=1)
    del found
    order = _sorted(columns[:longest].T)
    columns, counts = columns[:longest, order], columns[longest, order].astype(np.int64)
    new = np.ones(len(counts), dtype=bool)
    new[1:] = columns[0, 1:] != columns[0, :-1]
    schema = pa.schema([(c, pa.int64()) for c in (*(f"g{i}" for i in range(longest)), "n")])
    parts = [schema.empty_table()]
    for k in range(1, longest):
        new[1:] |= columns[k, 1:] != columns[k, :-1]
        starts = np.flatnonzero(new)
        n = np.add.reduceat(counts, starts)
        kept = n >= min_count
        kept[[0, -1]] = True
        kept &= columns[k, starts] > 0
        named = [columns[i, starts[kept]].astype(np.int64) if i <= k else np.full(int(kept.sum()), -1, dtype=np.int64) for i in range(longest)]
        parts += [pa.table([c[i : i + SENT_ROWS] for c in (*named, n[kept])], schema=schema) for i in range(0, int(kept.sum()), SENT_ROWS)]
    return pa.concat_tables(parts)


def _longer(shard: pa.Table, answers: pa.Table, longest: int) -> pa.Table:
    """The phrases of three words and more of a shard all of whose pairs are frequent. ``answers``: these pairs, by the shard's numbers and by name."""
    schema = pa.schema([(c, pa.int64()) for c in (*(f"g{i}" for i in range(longest)), "n")])
    parts = [schema.empty_table()]
    if shard.num_rows and answers.num_rows:
        text = _unpacked(shard.column("text")[0].as_py(), shard.column("size")[0].as_py()).astype(np.int64)
        local_a, local_b, a, b = (answers.column(c).to_numpy() for c in ("local_a", "local_b", "a", "b"))
        top = int(text.max(initial=0)) + 1
        names = np.full(top, -1, dtype=np.int64)
        names[local_a], names[local_b] = a, b
        held = np.sort(local_a.astype(np.int64) * top + local_b)
        key = text[:-1] * top + text[1:]
        joined = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key  # this word and the next are a frequent pair
        last = np.concatenate([[False], joined])  # and this one and the word before
        inner = np.concatenate([joined, [False]])
        long = inner & last  # the middle of three words at least
        near = long | np.concatenate([long[1:], [False]]) | np.concatenate([[False], long[:-1]])
        cut = near & ~last  # a separator goes before the first of a run
        place = np.cumsum(near + cut.astype(np.int64)) - 1
        short = np.zeros(int(place[-1]) + 2 if len(place) else 1, dtype=np.int32)
        short[place[near]] = text[near]
        del text, held, key, joined, last, inner, long, near, cut, place
        for phrases, n in enumerate_phrases(short, longest):
            for start in range(0, len(n) if phrases.shape[1] > 2 else 0, SENT_ROWS):
                own, none = phrases[start : start + SENT_ROWS], np.full(len(n[start : start + SENT_ROWS]), -1, dtype=np.int64)
                named = [names[own[:, i]] if i < own.shape[1] else none for i in range(longest)]
                parts.append(pa.table([*named, n[start : start + SENT_ROWS].astype(np.int64)], schema=schema))
    return pa.concat_tables(parts)  # Spark gets its chunks one by one


def _of_shards(shards: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    return shards.select("shard", "size", "text").groupBy("shard").cogroup(answers.withColumnRenamed("shard", "to_shard").groupBy("to_shard")).applyInArrow(fn, schema)


def _part(key: str, start: Column | int, length: Column | int) -> Column:
    return F.slice(key, start, length)


def _numbered(common: DataFrame) -> DataFrame:
    """Frequent words with an ``id`` from 1 on, the most frequent first."""
    ordered = stored(common.orderBy(F.desc("f"), "lang", "word").select("lang", "word", "f", "total", F.monotonically_increasing_id().alias("m")))
    place = ordered.select("*", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("offset"))
    sizes = place.groupBy("part").count()  # one row for each partition
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return stored(place.join(F.broadcast(before), "part").select((F.col("before") + F.col("offset") + 1).alias("id"), "lang", "word", "f", "total"))


def count_phrases(df: DataFrame, min_count: int, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The frequent words (``id``, ``lang``, ``word``, ``f``, ``total``: all words of the language) and the frequent phrases of one to ``longest`` words (``key``: ids, ``f``)."""
    small_batches(df)
    src = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    shards = stored(src.mapInArrow(lambda b: _shards(b, shard_bytes), "shard long, size long, text binary, langs array<string>, words array<string>, counts array<int>"))
    words = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "w")).select("shard", (F.col("place") + 1).alias("local"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("n"))
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")))
    common = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count).join(small(totals, totals.count()), "lang")
    known = _numbered(common)
    own = words.join(small(known.select("id", "lang", "word"), known.count()), ["lang", "word"]).select("shard", "local", "id")
    found = [known.select(F.array("id").alias("key"), "f")]
    if longest > 1:
        names = [f"g{i}" for i in range(longest)]
        n_shards, n_words = shards.agg(F.count("*"), F.sum("size")).first()
        some = F.pmod(F.xxhash64("shard"), F.lit(max(1, n_shards // SAMPLED_SHARDS))) == 0
        sample = sorted(bytes(r["row"]) for r in _of_shards(shards.filter(some), own.filter(some), lambda s, a: _sampled(s, a, longest), "row binary").collect())  # a bounded sample
        n_parts = (n_words or 0) // PART_WORDS + 1
        bounds = sorted({sample[len(sample) * i // n_parts] for i in range(1, n_parts)}) if sample else []
        sent = _of_shards(shards, own, lambda s, a: _sent(s, a, longest, bounds), "part int, size long, sent binary")
        counted = sent.groupBy("part").applyInArrow(lambda m: _counted(m, longest, min_count), ", ".join(f"{c} long" for c in [*names, "n"]))
        found.append(counted.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count).select(F.filter(F.array(*names), lambda x: x >= 0).alias("key"), "f"))
    return known, stored(reduce(DataFrame.unionByName, found))


def mine(df: DataFrame, top: int = 2000, min_count: int = 100, longest: int = LONGEST, absorbed: int = 100, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's first ``top`` phrases, and the numbers of their frequent extensions
    by one word to either side (``left_extensions``, ``right_extensions``).

    A phrase goes if a longer one that holds it has at least ``absorbed`` hundredths of its count. An extension by one word is never rarer than the
    longer phrases beyond it, so extensions by one word decide.
    """
    words, phrases = count_phrases(df, min_count, longest, text_col, lang_col, shard_bytes)
    size = F.size("key")
    many = phrases.filter(size > 1)
    sides = F.explode(F.array(F.struct(_part("key", 1, size - 1).alias("part"), F.lit(1).alias("right")), F.struct(_part("key", 2, size - 1).alias("part"), F.lit(0).alias("right")))).alias("s")
    extended = many.filter(size > 2).select("f", sides).groupBy(F.col("s.part").alias("key")).agg(F.max("f").alias("most"), F.sum(1 - F.col("s.right")).alias("left_extensions"), F.sum("s.right").alias("right_extensions"))
    candidates = many.join(extended, "key", "left").filter(F.col("most").isNull() | (100 * F.col("most") < absorbed * F.col("f"))).select("key", F.col("f").alias("a"), F.coalesce("left_extensions", F.lit(0)).alias("left_extensions"), F.coalesce("right_extensions", F.lit(0)).alias("right_extensions"))
    cuts = candidates.select("key", "a", "left_extensions", "right_extensions", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", _part("key", 1, F.col("k")).alias("head"), _part("key", F.col("k") + 1, size - F.col("k")).alias("tail"), F.element_at("key", 1).alias("id"))
    cuts = cuts.join(phrases.select(F.col("key").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail").join(words.select("id", "lang", F.col("total").alias("n")), "id")
    exact = {c: f"cast({c} AS decimal(19,0))" for c in ("a", "l", "r", "n")}
    score = F.expr(f"(cast(a * 1000 AS decimal(19,0)) * {exact['n']}) div ({exact['l']} * {exact['r']})").alias("score")
    scored = cuts.select("key", "lang", "k", "a", "l", "r", "n", "left_extensions", "right_extensions", score)
    lowest = scored.groupBy("key").agg(F.min_by(F.struct("lang", "a", "l", "r", "n", "score", "left_extensions", "right_extensions"), F.struct("score", "k")).alias("x")).select("key", "x.*")
    spelled = candidates.select("key", F.posexplode("key").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    full = lowest.join(spelled, "key").withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = full.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("place") <= top)  # so that no task sorts a whole language
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_extensions", "right_extensions")
