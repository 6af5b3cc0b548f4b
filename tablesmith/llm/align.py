"""Alignment of the tokens of two tokenizers over the same text.

Tasks encode blocks of documents by both tokenizers and align them with Arrow: token lists are flattened with their parent indices, byte
lengths are summed up within documents, and a hash join on (document, end) finds the ends that both have, which cut the tokens into
groups. Between two neighbouring ends of either side lies one pair of overlapping tokens, a link. A block counts its documents by
distinct pair (``Table.group_by``) and sends these partial counts; Spark adds them up and answers each block with the corpus-wide count of its pairs
and whether it is the highest of the pair's first id. The rest is arithmetic within the block.

What the blocks found is a table in the shared folder, read twice. A pair, however frequent, is sent once by each block, and the join that answers
the blocks has one row per pair on the other side, so that a hot pair can be split. The highest counts are one row per id of the first vocabulary,
which bounds their broadcast; the counts themselves are broadcast only up to a checked number of rows.

Edge cases: null and empty texts, and texts that either tokenizer's tokens don't spell out, have no tokens (zeros and an empty string); equal rows
and rows without id are aligned one by one and all count; a very long text is a block of its own; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import blocks, id_and_text, list_array, steps
from tablesmith.llm.components import small, stored
from tablesmith.llm.subwords import paired_units

#: Bytes of text in a block: a larger one sends fewer rows and takes more memory.
BLOCK_BYTES = 6 << 20
#: Bytes of text that are aligned at a time within a block: their tokens take many times as much.
ALIGNED_BYTES = 1 << 20
#: Tokens that are spelled out in digits at a time.
SPELLED = 1 << 19
FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def _ends(lists: pa.ListArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of token lists, flat, each one's document and its end within the document in bytes."""
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    total = np.asarray(pc.cumulative_sum(pa.array(lengths).take(flat)))
    starts = np.asarray(lists.offsets)[:-1]
    before = np.concatenate([[0], total])[starts]
    parents = np.asarray(parents, dtype=np.int64)
    return np.asarray(flat), parents, total - before[parents]


def _cuts(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common ends: their documents and the tokens of either side that end there, in order."""
    left, right = (pa.table({"document": pa.array(parents), "end": pa.array(ends), name: pa.array(np.arange(len(ends), dtype=np.int64))}) for (_, parents, ends), name in ((a, "a"), (b, "b")))
    both = left.join(right, ["document", "end"], join_type="inner", use_threads=False)
    at_a, at_b, document = (both.column(c).to_numpy() for c in ("a", "b", "document"))
    order = np.argsort(at_a)
    return document[order], at_a[order], at_b[order]


def _links(a: tuple, b: tuple, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and both ids of each link, in order."""
    base = np.cumsum(sizes) - sizes
    marks = []
    for _, parents, ends in (a, b):
        mark = np.zeros(int(sizes.sum()) + 1, dtype=bool)
        mark[base[parents] + ends] = True
        marks.append(mark)
    at = np.flatnonzero(marks[0] | marks[1])
    token_a, token_b = ((np.cumsum(m, dtype=np.int64) - m)[at] for m in marks)
    return a[1][token_a], a[0][token_a], b[0][token_b]


def _spelled_groups(a: tuple, b: tuple, cut_a: np.ndarray, cut_b: np.ndarray, n: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all documents, one after another, and each document's number of bytes."""
    ids_a, ids_b, total = a[0], b[0], len(a[0]) + len(b[0])
    last_a, last_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    last_a[cut_a], last_b[cut_b] = True, True
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], cut_b + 1])[np.cumsum(last_a) - last_a]
    place_b = np.arange(len(ids_b)) + cut_a[np.cumsum(last_b) - last_b] + 1
    ids, ends, document = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.uint8), np.empty(total, dtype=np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    ends[place_a], ends[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    document[place_a], document[place_b] = a[1], b[1]
    width, out, sizes = len(str(ids.max(initial=0))), [], np.zeros(n, dtype=np.int64)
    for start in range(0, total, SPELLED):
        own = ids[start : start + SPELLED]
        text, shown = np.empty((len(own), width + 1), dtype=np.uint8), np.ones((len(own), width + 1), dtype=bool)
        for d in range(width):
            text[:, width - 1 - d] = 48 + own // 10**d % 10
            shown[:, width - 1 - d] = own >= 10**d if d else True
        text[:, width] = ends[start : start + SPELLED]
        out.append(text[shown].tobytes())
        sizes += np.bincount(document[start : start + SPELLED], weights=shown.sum(axis=1), minlength=n).astype(np.int64)
    return b"".join(out), sizes


def _step(docs: pa.RecordBatch, units, with_groups: bool) -> tuple:
    """What some documents come to: their facts, digests, groups and numbers of distinct pairs, and these pairs with their times, document by document."""
    n = docs.num_rows
    text = pc.fill_null(docs.column("text").cast(pa.large_string()), "")
    use, pieces = units.of(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    sizes = np.asarray(pc.binary_length(text), dtype=np.int64)
    held = units.spelled(use, pieces) & (sizes > 0)
    sides, number = [], []
    for k, encoder in enumerate(units.encoders):
        ids, count = units.ids(k, use, pieces)
        own = np.where(held, count, 0)
        sides.append(_ends(list_array(ids[np.repeat(held, count)], own, pa.int32()), encoder.lengths))
        number.append(own)
    a, b = sides
    document, cut_a, cut_b = _cuts(a, b)
    text_of_groups, ends = _spelled_groups(a, b, cut_a, cut_b, n)
    at, raw = np.cumsum(ends), memoryview(text_of_groups)
    groups = [raw[stop - size : stop - 1] if size else None for stop, size in zip(at.tolist(), ends.tolist(), strict=True)]
    digest = [sha256(g).hexdigest() if g is not None else "" for g in groups]
    linked, id_a, id_b = _links(a, b, np.where(held, sizes + 1, 0))
    own, times = np.unique((linked << 32) | (id_a.astype(np.int64) * len(units.encoders[1].tokens) + id_b), return_counts=True)
    facts = np.stack([number[0], number[1], np.bincount(document, minlength=n), np.bincount(linked, minlength=n)]).astype(np.int64)
    spelled = [str(g, "ascii") if g is not None else "" for g in groups] if with_groups else []
    return facts, digest, spelled, np.bincount(own >> 32, minlength=n), own & 0xFFFFFFFF, times.astype(np.int32)


def _align(docs: pa.Table, block: int, files: tuple[str, str], with_groups: bool) -> pa.RecordBatch:
    units, n = paired_units(*files), docs.num_rows
    parts = [_step(part, units, with_groups) for part in steps(iter(docs.to_batches()), ALIGNED_BYTES)]
    facts, many, code, times = (np.concatenate([p[i] for p in parts], axis=-1) for i in (0, 3, 4, 5))
    digest, spelled = (list(chain.from_iterable(p[i] for p in parts)) for i in (1, 2))
    kinds = len(units.encoders[1].tokens)
    partial = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([([], "count_all")])
    codes, documents = partial.column("code").to_numpy(), partial.column("count_all").to_numpy()
    order = np.argsort(codes)
    codes, documents = codes[order], documents[order]
    first = [np.concatenate([[len(codes)], np.zeros(n - 1)]).astype(np.int64)] * 3  # the block's pairs stand in its first row
    columns = [docs.column("id").combine_chunks(), pa.array(np.full(n, block, dtype=np.int64)), *map(pa.array, facts), pa.array(digest)]
    columns += [list_array(x.astype(np.int32), many, pa.int32()) for x in (np.searchsorted(codes, code), times)]
    columns += [list_array(x.astype(np.int32), k, pa.int32()) for x, k in zip((codes // kinds, codes % kinds, documents), first, strict=True)]
    columns += [pa.array(spelled)] if with_groups else []
    names = ["id", "block", *FACTS, "groups_sha256", "pair", "times", "pair_a", "pair_b", "pair_documents", *["groups"] * with_groups]
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode_and_align(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The blocks' results as a table: ``id``, the facts of each document, and the pairs it and its block hold. Both files must be readable on every executor."""
    src = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, docs in enumerate(blocks(batches, BLOCK_BYTES)):
            yield _align(docs, (part << 32) + k, (byte_level, pieces), with_groups)

    kind = src.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in ("pair", "times", "pair_a", "pair_b", "pair_documents"))
    return stored(src.mapInArrow(run, f"id {kind}, block long, {', '.join(f'{c} long' for c in FACTS)}, groups_sha256 string, {lists}" + ", groups string" * with_groups))


def _sent(found: DataFrame) -> DataFrame:
    """The pairs of each block, with the number of its documents that hold them linked."""
    pairs = found.filter(F.size("pair_a") > 0).select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_documents")).alias("place", "p"))
    return pairs.select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_documents").cast("long").alias("n"))


def pair_counts(found: DataFrame) -> DataFrame:
    """``a``, ``b``, ``documents`` (how many documents hold the ids linked) and ``best`` (no other ``b`` has more with this ``a``)."""
    counts = stored(_sent(found).groupBy("a", "b").agg(F.sum("n").alias("documents")))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # one row per id of the vocabulary
    return counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _sums(docs: pa.Table, answers: pa.Table, names: list[str]) -> pa.Table:
    place = answers.column("place").to_numpy()
    count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    count[place], best[place] = answers.column("documents").to_numpy(), answers.column("best").cast(pa.int8()).to_numpy()
    pair, times = (docs.column(c).combine_chunks() for c in ("pair", "times"))
    offsets = np.asarray(pair.offsets)
    use, often = np.asarray(pair.flatten()), np.asarray(times.flatten(), dtype=np.int64)
    sums = [np.concatenate([[0], np.cumsum(x[use] * often)]) for x in (best, count)]
    n_best, count_sum = (pa.array(s[offsets[1:] - offsets[0]] - s[offsets[:-1] - offsets[0]]) for s in sums)
    return pa.table([docs.column("id"), *(docs.column(c) for c in FACTS), n_best, count_sum, docs.column("groups_sha256"), *([docs.column("groups")] if "groups" in docs.column_names else [])], names=names)


def align(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row; the groups' text too if asked for."""
    found = encode_and_align(df, byte_level, pieces, id_col, text_col, with_groups)
    counts = stored(pair_counts(found))
    answers = _sent(found).join(small(counts, counts.count()), ["a", "b"]).select(F.col("block").alias("to_block"), "place", "documents", "best")
    more = ["groups"] if with_groups else []
    names = [id_col, *FACTS, "n_best", "count_sum", "groups_sha256", *more]
    kind = found.schema["id"].dataType.simpleString()
    docs = found.select("block", "id", *FACTS, "groups_sha256", "pair", "times", *more)
    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in [*FACTS, 'n_best', 'count_sum'])}, groups_sha256 string" + ", groups string" * with_groups
    return docs.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(lambda d, a: _sums(d, a, names), schema)
