"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; the distinct pieces that no earlier step has seen are put into matrices, one per
length bucket, one padded row each. In every round each row merges its leftmost pair of minimum rank. Pairs are looked up in an
open-addressing hash table, rows are compacted after each merge, and finished rows leave the matrix. The row of a very long piece is
folded into a square, so that a round looks at one line of it and at the lines' minima instead of the whole row; it too merges the
leftmost pair of minimum rank each round.

Edge cases: a null or empty text has no ids and decodes to an empty value; rows with equal ids or texts are encoded one by
one and all returned; an empty table gives an empty result with the same columns; other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablesmith.llm.batches import Numbering, id_and_text, list_array, steps, texts

NONE = np.int64(1) << 40
#: A task forgets its pieces beyond this number and learns them anew; only time depends on it.
KEPT_PIECES = 300_000
#: The row of a piece of more bytes is folded.
LONG = 2048
#: Cells of one padded matrix.
CELLS = 1 << 21


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that the pair merges into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(merged), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys, values = (left.astype(np.int64) << 32) | right, merged.astype(np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            left_over = np.ones(len(keys), dtype=bool)
            left_over[won] = False
            keys, values, at = keys[left_over], values[left_over], (at[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where there is no such pair or an id is negative (padding)."""
        out = np.full(left.shape, NONE, dtype=np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[open_].astype(np.int64) << 32) | right[open_]
        at = self._slot(keys)
        while len(open_):
            held = self.keys[at]
            hit = held == keys
            out[open_[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    """Encoder and decoder for one file of ranks (a base64 token and its rank on each line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = np.array([None] * (max(ranks.values()) + 1), dtype=object)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a padded matrix after all merges."""
        out: list = [None] * len(ids)
        row = np.arange(len(ids))
        lengths = lengths.copy()
        found = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            at = found.argmin(axis=1) if found.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = found[np.arange(len(row)), at] if found.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    out[row[i]] = ids[i, : lengths[i]].copy()
                on = ~over
                row, at, best, lengths = row[on], at[on], best[on], lengths[on]
                if not len(row):
                    break
                width = lengths.max()
                ids, found = ids[on, :width], found[on, : width - 1]
            n, width = ids.shape
            r = np.arange(n)
            ids[r, at] = best
            column = np.arange(width - 1)
            source = column + (column > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            lengths -= 1
            found = np.take_along_axis(found, np.minimum(source, width - 2), axis=1)[:, : width - 2]
            if width > 2:
                for shift in (-1, 0):
                    p = at + shift
                    ok = np.flatnonzero((p >= 0) & (p < width - 2))
                    found[ok, p[ok]] = self.pairs.find(ids[ok, p[ok]], ids[ok, p[ok] + 1])
        return out

    def merge_folded(self, ids: np.ndarray) -> np.ndarray:
        """As ``merge`` for one very long row: its pairs' ranks stand in a square, each line with its minimum."""
        n = len(ids)
        side = int(np.ceil(np.sqrt(n)))
        found = np.full(side * side, NONE, dtype=np.int64)
        found[: n - 1] = self.pairs.find(ids[:-1], ids[1:])
        found = found.reshape(side, side)
        least = found.min(axis=1)
        own, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def put(at: int, rank: int) -> None:
            line = at // side
            found[line, at % side] = rank
            least[line] = rank if rank < least[line] else found[line].min()

        while (best := int(least[line := int(least.argmin())])) != NONE:
            at = line * side + int(found[line].argmin())
            gone = after[at]
            own[at], after[at] = best, after[gone]
            own[gone] = -1
            put(gone, NONE)
            if after[at] < n:
                before[after[at]] = at
                put(at, ranks.get(tokens[best] + tokens[own[after[at]]], NONE))
            else:
                put(at, NONE)
            if before[at] >= 0:
                put(before[at], ranks.get(tokens[own[before[at]]] + tokens[best], NONE))
        return np.array([i for i in own if i >= 0], dtype=np.int64)

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. A piece that is itself a token is that token."""
        out: list = [None] * len(pieces)
        open_ = []
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is None and len(p) > LONG:
                out[i] = self.merge_folded(self.of_byte[np.frombuffer(p, dtype=np.uint8)])
            elif rank is None:
                open_.append(i)
            else:
                out[i] = np.array([rank])
        open_.sort(key=lambda i: len(pieces[i]))
        start = 0
        while start < len(open_):
            shortest, stop = len(pieces[open_[start]]), start
            while stop < len(open_) and (n := len(pieces[open_[stop]])) <= shortest * 5 // 4 + 1 and (stop == start or (stop - start + 1) * n <= CELLS):
                stop += 1
            rows = open_[start:stop]
            lengths = np.array([len(pieces[i]) for i in rows])
            ids = np.full((len(rows), lengths.max()), -1, dtype=np.int64)
            flat = np.frombuffer(b"".join(pieces[i] for i in rows), dtype=np.uint8)
            ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.of_byte[flat]
            for i, merged in zip(rows, self.merge(ids, lengths), strict=True):
                out[i] = merged
            start = stop
        return out

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[np.asarray(ids, dtype=np.int64)].tolist())


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``ids`` (array of int) and ``decoded`` (binary: the ids' tokens, joined).

    ``ranks_path`` must be readable on every executor under that name.
    """
    src = id_and_text(df, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        seen: Numbering = Numbering()
        start, count, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in steps(batches):
            number = seen.__getitem__
            uses = [np.fromiter(map(number, found), dtype=np.int64, count=len(found)) for found in map(bpe.pattern.findall, texts(batch))]
            if len(seen) > len(count):
                made = bpe.pieces([p.encode("utf-8", "surrogatepass") for p in list(seen)[len(count) :]])
                more = np.array([len(m) for m in made], dtype=np.int64)
                start = np.concatenate([start, len(flat) + np.cumsum(more) - more])
                count, flat = np.concatenate([count, more]), np.concatenate([flat, *made]).astype(np.int32)
            ids, lengths, decoded = [], [], []
            for use in uses:
                n = count[use]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                own = flat[np.repeat(start[use] - (ends - n), n) + np.arange(total)]
                ids.append(own)
                lengths.append(total)
                decoded.append(bpe.decode(own))
            if len(seen) > KEPT_PIECES:
                seen, start, count, flat = Numbering(), start[:0], count[:0], flat[:0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(np.concatenate(ids) if ids else flat[:0], np.array(lengths, dtype=np.int64), pa.int32()), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` for stored ids; null ids decode to an empty value."""
    src = df.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, decoded binary")
