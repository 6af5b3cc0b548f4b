"""Encoding by tokenizer libraries in tasks: a unit of text is given to a library once and looked up afterwards.

A unit begins at a space that follows no white space. The tokenizers used here never join such a space to what stands before it (checked
when their files are opened), so the ids of a text are those of its units, one after another. Texts are cut into units and units numbered by
Arrow functions; only units that a worker has not met before reach the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablesmith.llm.batches import Numbering

#: A worker forgets its units beyond this number and learns them anew; only time depends on it.
KEPT_UNITS = 400_000
#: Units that the library gets as one text.
JOINED = 500
#: Set before each unit while texts are cut.
MARK = "\x01"
#: A space after white space, or the mark: such texts are cut by the slower general rule.
ODD = r"[\s\x0b\x1c-\x1f\x{85}\pZ] |\x01"
#: The same where white space is a unit of its own: any two white spaces.
ODDLY_FINE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}|\x01"
#: Punctuation at the end of a word that ends in a Latin letter or digit.
WORD_END = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?]+)(\x01|$)"
CUT = re.compile(r"(?<=\S) ")
SPACE_MARK = "▁"


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: the byte's own where it is visible, else those from 256 on in order."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` at ``start`` of length ``count``, one after another."""
    ends = np.cumsum(count)
    place = np.repeat((start - (ends - count)).astype(np.int32), count)  # of a task's own units: fewer than 2^31
    place += np.arange(len(place), dtype=np.int32)
    return flat[place]


class ByteLevel:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, special_tokens: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        with open(path, encoding="utf-8") as lines:
            parts = json.load(lines)
        before = parts["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or parts["normalizer"] or parts["post_processor"]:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
            raise ValueError(f"{path} has added tokens that reach over spaces")
        from tokenizers import Tokenizer  # here and below, so that the driver, which encodes nothing, does without

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special_tokens
        of, added = byte_characters(), {t["content"] for t in parts["added_tokens"]}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode() if token in added else bytes(of[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units, flat, and each unit's first place and number of ids. Units of a space and a word go to the library many at a time."""
        plain = np.array([len(u) > 1 and u[0] == " " and not u[1].isspace() and not u[-1].isspace() for u in units], dtype=bool)
        count = np.zeros(len(units), dtype=np.int64)
        words = list(compress(units, plain))
        texts = ["".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        flat = [np.array(e.ids, dtype=np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(words, pa.large_string())), dtype=np.int64))
        count[plain] = np.diff(np.searchsorted(np.cumsum(self.lengths[flat]), ends, "right"), prepend=0)
        rest = [e.ids for e in self.library.encode_batch_fast(list(compress(units, ~plain)), add_special_tokens=False)]
        count[~plain] = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
        start = np.empty_like(count)
        start[plain] = np.cumsum(count[plain]) - count[plain]
        start[~plain] = len(flat) + np.cumsum(count[~plain]) - count[~plain]
        return np.concatenate([flat, *(np.array(r, dtype=np.int32) for r in rest)]), start, count


class Pieces:
    """A sentencepiece BPE file that puts a space before each text. Units must begin with a space (or be empty).

    A text that holds the library's mark for a space is not spelled out by its tokens, by units or whole; their ids may differ then.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", n) for n in names):
            raise ValueError(f"{path} has pieces that reach over spaces")
        self.tokens = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(SPACE_MARK, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.space = self.library.piece_to_id(SPACE_MARK)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.library.encode([u[1:] for u in units], num_threads=1)
        out = [[self.space] if u == " " else ids for u, ids in zip(units, out, strict=True)]
        count = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter(chain.from_iterable(out), dtype=np.int32, count=int(count.sum())), np.cumsum(count) - count, count


class Units:
    """The numbered units that a worker knows and their ids by each of some encoders.

    Byte-level encoders alone also part white space, and punctuation at a word's end, from the word before: they never join these.
    """

    def __init__(self, *encoders: ByteLevel | Pieces):
        self.encoders, self.fine = encoders, all(isinstance(e, ByteLevel) for e in encoders)
        self._forget()

    def _forget(self) -> None:
        self.seen: Numbering = Numbering()
        none = np.zeros(0, dtype=np.int64)
        self.known = [[none.astype(np.int32), none, none] for _ in self.encoders]  # flat ids, each unit's first place and its number of ids
        self.same = np.zeros(0, dtype=bool)

    def _numbers(self, units: list[str] | np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.seen.__getitem__, units), dtype=np.int32, count=len(units))

    def _learn(self) -> None:
        """Encode the units numbered last; ``same`` tells whether every encoder's tokens spell a unit out."""
        done = len(self.same)
        if len(self.seen) == done:
            return
        new = list(islice(self.seen, done, None))
        same = np.ones(len(new), dtype=bool)
        for encoder, known in zip(self.encoders, self.known, strict=True):
            ids, at, count = encoder.encode(new)
            flat, start, n = known
            known[:] = np.concatenate([flat, ids]), np.concatenate([start, len(flat) + at]), np.concatenate([n, count])
            if not self.fine:
                tokens, ids = encoder.tokens, ids.tolist()
                same &= [b"".join(map(tokens.__getitem__, ids[a : a + c])) == u.encode() for a, c, u in zip(at.tolist(), count.tolist(), new, strict=True)]
        self.same = np.concatenate([self.same, same])

    def _cut(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The units of each text, and which texts need the general rule instead (their units here don't count)."""
        odd = pc.match_substring_regex(texts, ODDLY_FINE if self.fine else ODD)
        texts = pc.replace_substring(pc.if_else(odd, "", texts), " ", MARK + " ")
        if self.fine:
            texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", f"{MARK}\n{MARK}"), WORD_END, rf"\1{MARK}\2\3")
        return pc.split_pattern(texts, MARK), np.asarray(odd)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units' numbers of some texts, flat, and each text's number of units (one at least). Null counts as empty."""
        if len(self.seen) > KEPT_UNITS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists, odd = self._cut(texts)
        n, coded = np.asarray(pc.list_value_length(lists), dtype=np.int64), lists.flatten().dictionary_encode()
        use = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False))[np.asarray(coded.indices)]
        if odd.any():
            cut = [[head, *(" " + w for w in tail)] for head, *tail in map(CUT.split, texts.filter(pa.array(odd)).to_pylist())]
            many, plain = n.copy(), np.repeat(~odd, n)
            many[odd] = [len(c) for c in cut]
            slow = np.repeat(odd, many)
            both = np.empty(int(many.sum()), dtype=np.int32)
            both[~slow], both[slow] = use[plain], self._numbers(list(chain.from_iterable(cut)))
            use, n = both, many
        self._learn()
        return use, n

    def ids(self, k: int, use: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids by encoder ``k``, flat, and each text's number of ids."""
        flat, start, count = self.known[k]
        own = count[use]
        return ragged(flat, start[use], own), np.add.reduceat(own, np.cumsum(n) - n) if len(n) else n

    def spelled(self, use: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which texts every encoder's tokens spell out."""
        return np.logical_and.reduceat(self.same[use], np.cumsum(n) - n) if len(n) else np.zeros(0, dtype=bool)


@lru_cache(maxsize=2)
def byte_level_units(path: str, special_tokens: bool) -> Units:
    return Units(ByteLevel(path, special_tokens))


@lru_cache(maxsize=2)
def paired_units(byte_level: str, pieces: str) -> Units:
    return Units(ByteLevel(byte_level, False), Pieces(pieces))
