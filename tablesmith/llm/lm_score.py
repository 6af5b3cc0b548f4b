"""Scoring texts by a weighted backoff automaton learned from the corpus.

A state is a history word; a seen bigram is an arc with the log-probability of its word, and every state has a failure arc to
the root, whose weight is the probability the history keeps for words not seen after it. The root has an arc for each word.
Probabilities are Dirichlet-smoothed: p(w | h) = (c(hw) + K p(w)) / (c(h) + K) with p(w) = (c(w) + 1) / (N + V + 1), so
log10 K / (c(h) + K) is the failure weight and every state's probabilities sum to one over seen words and one unseen word.

The model is as large as the corpus, so no task holds all of it. Documents are dealt into blocks of bounded size. A block sends
the parts of the key space its distinct words and bigrams (as 64-bit hashes, in order) with their counts among its learning
documents; a part adds the counts up and answers each block in that same order. The block then has the counts that all of its
documents need: it builds its portion of the automaton and traverses it. A key, however frequent, is sent once by each block, and a
block sends nothing to a part of which it has no key, so that there are never more messages than keys of blocks: the work is linear
in the corpus, however many blocks and parts there are. Blocks and parts are numbered so that each has a task of its own.
The totals of the root (tokens and kinds of words) come from a count of the learned words by themselves.

Edge cases: a null or empty text is the end token alone; a very long text is one block, read whole; equal rows are scored one by one; without learning rows all counts
are zero and every token has probability one (V and N are zero); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import apart, id_and_text, steps

#: Hashed names of the end token and of the state before the first word; words hold no space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(name)) for name in (b" end", b" start"))
SENT = "part int, place int, block int, sizes array<long>, keys binary, counts binary"
ANSWER = "block int, part int, place int, sizes array<long>, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Integers by byte plane, so that the shuffle's compression takes away the high zero bytes."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def bigram(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = (history ^ (history >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words of some texts, each word's place among these, and each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    filled = pc.greater(pc.binary_length(words), 0)
    words, row = words.filter(filled), np.asarray(row.filter(filled), dtype=np.int64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    names = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return names, np.asarray(coded.indices), row


class Tokens:
    """The hashed tokens of a block's texts: words and an end for each text, with the history before each token."""

    def __init__(self, texts: pa.Array):
        names, place, row = _words(texts)
        number = np.bincount(row, minlength=len(texts)) + 1
        self.ends = np.cumsum(number)
        self.starts = self.ends - number
        self.key = np.full(int(self.ends[-1]) if len(number) else 0, END, dtype=np.uint64)
        if len(row):
            self.key[np.arange(len(row)) + row] = names[place]
        self.history = np.concatenate([[START], self.key[:-1]]).astype(np.uint64)[: len(self.key)]
        self.history[self.starts] = START
        self.pair = bigram(self.history, self.key)


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs among the learning documents."""
    distinct = np.unique(keys)
    some, n = np.unique(keys[learned], return_counts=True)
    counts = np.zeros(len(distinct), dtype=np.uint32)
    counts[np.searchsorted(distinct, some)] = n
    return distinct, counts


def _send(block: int, texts: pa.Array, learn: np.ndarray, parts: list[int]) -> pa.Table:
    """One message for each part of the key space (numbered by ``parts``) that has a word or bigram of the block."""
    tokens = Tokens(texts)
    learned = np.repeat(learn, tokens.ends - tokens.starts)
    both = [_counted(keys, learned) for keys in (tokens.key, tokens.pair)]
    bounds = np.array([(i << 64) // len(parts) for i in range(1, len(parts))], dtype=np.uint64)
    place = [np.searchsorted(bounds, keys, "right") for keys, _ in both]
    used = np.union1d(*place)
    cuts = [(np.searchsorted(at, used), np.searchsorted(at, used, "right")) for at in place]
    rows: dict[str, list] = {"part": [parts[p] for p in used], "place": used.tolist(), "block": [block] * len(used), "sizes": [], "keys": [], "counts": []}
    for i in range(len(used)):
        keys = [k[lo[i] : hi[i]] for (k, _), (lo, hi) in zip(both, cuts, strict=True)]
        counts = [n[lo[i] : hi[i]] for (_, n), (lo, hi) in zip(both, cuts, strict=True)]
        rows["sizes"].append([len(k) for k in keys])
        rows["keys"].append(b"".join(pack(np.diff(k, prepend=np.uint64(0))) for k in keys))
        rows["counts"].append(pack(np.concatenate(counts)))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _add_up(sent: pa.Table) -> pa.Table:
    sizes, raw_keys, raw_counts = (sent.column(c).to_pylist() for c in ("sizes", "keys", "counts"))
    keys, counts = [], [unpack(c, np.uint32) for c in raw_counts]
    for (words, _), raw in zip(sizes, raw_keys, strict=True):
        keys.append((np.cumsum(unpack(raw[: words * 8], np.uint64), dtype=np.uint64), np.cumsum(unpack(raw[words * 8 :], np.uint64), dtype=np.uint64)))
    del raw_keys, raw_counts
    sums = []
    for side in (0, 1):
        own = [(c[: n[0]] if side == 0 else c[n[0] :]) for c, n in zip(counts, sizes, strict=True)]
        distinct, inverse = np.unique(np.concatenate([k[side] for k in keys]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(own), minlength=len(distinct))
        sums.append(np.split(total.astype(np.uint32)[inverse], np.cumsum([len(o) for o in own])[:-1]))
    answers = [pack(np.concatenate(pair)) for pair in zip(*sums, strict=True)]
    same = [sent.column(c) for c in ("block", "part", "place", "sizes")]
    return pa.table([*same, pa.array(answers, pa.binary())], names=["block", "part", "place", "sizes", "counts"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed tokens of some texts at a time and how often each occurs there."""
    for batch in steps(batches):
        names, place, _ = _words(batch.column("text"))
        words, n = np.append(names, END), np.append(np.bincount(place, minlength=len(names)), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


class Automaton:
    """A block's portion of the automaton: root arcs, failure weights and bigram arcs of all its states."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, learned: int, kinds: int, prior: float):
        self.words, self.word_counts, self.pairs, self.pair_counts, self.prior = words, word_counts, pairs, pair_counts, prior
        self.total = learned + kinds + 1
        self.root = np.log10((word_counts + 1) / self.total)
        self.failure = np.log10(prior / (word_counts + prior))

    def traverse(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: root log-probability, log-probability, known tokens. The state is the last token; each arc adds its weight."""
        at = np.searchsorted(self.words, tokens.key)
        state = np.empty_like(at)
        state[1:] = at[:-1]
        ends = int(self.word_counts[np.searchsorted(self.words, END)]) if len(at) else 0  # texts begin as often as they end
        first = tokens.starts
        state[first] = 0
        root = self.root[at]
        arc = self.pair_counts[np.searchsorted(self.pairs, tokens.pair)]
        history = self.word_counts[state].astype(float)
        history[first] = ends
        fail = self.failure[state]
        fail[first] = np.log10(self.prior / (ends + self.prior))
        step = fail + root
        seen = arc > 0
        step[seen] = np.log10((arc[seen] + self.prior * 10 ** root[seen]) / (history[seen] + self.prior))
        known = (self.word_counts[at] > 0).astype(np.int64)
        return tuple(np.add.reduceat(x, first) if len(first) else x[:0] for x in (root, step, known))


def _score(docs: pa.Table, answers: pa.Table, learned: int, kinds: int, prior: float, id_col: str) -> pa.Table:
    tokens = Tokens(docs.column("text").combine_chunks())
    answers = answers.sort_by("place")
    counts, sizes = [unpack(c, np.uint32) for c in answers.column("counts").to_pylist()], answers.column("sizes").to_pylist()
    words = np.concatenate([c[: n[0]] for c, n in zip(counts, sizes, strict=True)])
    pairs = np.concatenate([c[n[0] :] for c, n in zip(counts, sizes, strict=True)])
    automaton = Automaton(np.unique(tokens.key), words, np.unique(tokens.pair), pairs, learned, kinds, prior)
    base, score, known = automaton.traverse(tokens)
    n = docs.num_rows
    return pa.table([docs.column("id"), pa.array(tokens.ends - tokens.starts), pa.array(known), pa.array([learned] * n, pa.int64()), pa.array(base), pa.array(score)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = 30.0, block_bytes: int = 8 << 20, part_bytes: int = 12 << 20) -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    The model learns from the rows where ``learn`` holds. ``block_bytes`` and ``part_bytes`` bound the text behind one block
    and one part of the key space; larger ones need more memory in a task and send fewer, larger messages.
    """
    src = id_and_text(df, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("learn"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = (apart(df.sparkSession, max(1, ceil(size / n))) for n in (block_bytes, part_bytes))
    number = F.pmod(F.xxhash64("id", "text"), F.lit(len(blocks))) + 1
    docs = src.withColumn("block", F.element_at(F.lit(blocks), number.cast("int"))).repartition(len(blocks), "block")
    sent = docs.groupBy("block").applyInArrow(lambda key, t: _send(key[0].as_py(), t.column("text").combine_chunks(), np.asarray(t.column("learn")), parts), SENT)
    answers = sent.repartition(len(parts), "part").groupBy("part").applyInArrow(_add_up, ANSWER)
    words = src.filter("learn").select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    learned, kinds = map(int, words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    kind = src.schema["id"].dataType.simpleString()
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, learned, kinds, prior, id_col), f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
