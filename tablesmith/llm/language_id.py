"""Language identification by words first, then by ever shorter character n-grams.

Training counts words for each language on a bounded sample of the labelled rows. A known word adds its log frequency in each
language; an unseen word falls back to the longest character n-grams of it (word ends marked) that are known, and adds their
mean log frequency. The language with the highest sum wins; the score is the normalised likelihood of the winner.

Words are runs of letters and what counts as alphanumeric with them; a run without any letter (digits, fractions, circled or Roman
numerals) is no word.

Edge cases: a text that is null, empty or without any letter gets ``und`` and score 0; so does every text if there are no
training rows or the table is empty; ties go to the language that sorts first; repeated rows are judged one by one; rows without an
id are judged like others and may be learned from; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.batches import id_and_text, steps, texts

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Scored words that a task remembers.
KEPT_WORDS = 400_000


def words(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Model:
    """The languages in order; words and n-grams (as Arrow strings) with their counts in each language."""

    langs: list[str]
    words: pa.Array
    word_counts: np.ndarray
    grams: pa.Array
    gram_counts: np.ndarray


def _counts(found: pa.Table, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    keys = found.column("w").combine_chunks().dictionary_encode()
    counts = np.zeros((len(keys.dictionary), len(langs)), dtype=np.int64)
    at = np.searchsorted(np.array(langs), np.array(found.column("lang").to_pylist())) if found.num_rows else np.zeros(0, int)
    np.add.at(counts, (np.asarray(keys.indices), at), np.asarray(found.column("n")))
    return keys.dictionary, counts


def train(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000) -> Model:
    """Learn from about ``docs_per_lang`` rows of each language, drawn by a hash of the id (and text) from those where ``learn`` holds.

    All words and n-grams of that sample are kept: its size, and so the model's, depends on the number of languages but not on that
    of the rows.
    """
    rows = df.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    share = rows.groupBy("lang").agg((F.lit(docs_per_lang) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.join(F.broadcast(share), "lang").filter(drawn)  # one row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in steps(batches):
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "w", "n"])

    found = sample.select("text", "lang").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    cut = [F.expr(f"IF(length(w) + 2 >= {k}, transform(sequence(1, length(w) + {3 - k}), i -> substring(concat('_', w, '_'), i, {k})), array())") for k in ORDERS]
    grams = found.select("lang", "n", F.explode(F.flatten(F.array(*cut))).alias("w")).groupBy("lang", "w").agg(F.sum("n").alias("n"))
    both = found.select(F.lit(True).alias("whole"), "lang", "w", "n").unionByName(grams.select(F.lit(False).alias("whole"), "lang", "w", "n")).toArrow()  # what the sample holds
    langs = sorted(set(both.column("lang").unique().to_pylist()))
    whole = np.asarray(both.column("whole").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    return Model(langs, *_counts(both.filter(pa.array(whole)), langs), *_counts(both.filter(pa.array(~whole)), langs))


class Scorer(dict):
    """Rows of ``table`` by word, made at a word's first use."""

    def __init__(self, model: Model):
        self.n = len(model.langs)
        self.known = self.logs(model.words.to_pylist(), model.word_counts)
        names, sizes = model.grams.to_pylist(), np.array([len(g) for g in model.grams.to_pylist()], dtype=int)
        self.grams = {k: self.logs([names[i] for i in np.flatnonzero(sizes == k)], model.gram_counts[sizes == k]) for k in ORDERS}
        self.table = np.zeros((KEPT_WORDS, self.n))

    def logs(self, names: list[str], counts: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        """Smoothed log frequencies in each language: a row for each name."""
        return {name: i for i, name in enumerate(names)}, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * max(1, len(counts))))

    def weigh(self, word: str) -> np.ndarray:
        place, rows = self.known
        if (at := place.get(word)) is not None:
            return rows[at]
        marked = f"_{word}_"
        for k in ORDERS:
            place, rows = self.grams[k]
            found = [at for i in range(len(marked) - k + 1) if (at := place.get(marked[i : i + k])) is not None]
            if found:
                return rows[found].sum(axis=0) / len(found)
        return np.zeros(self.n)

    def __missing__(self, word: str) -> int:
        i = len(self)
        self.table[i] = self.weigh(word)
        self[word] = i
        return i

    def score(self, text: str) -> tuple[int, float]:
        """The language's place (-1: none) and its normalised likelihood."""
        found = words(text)
        if not found or not self.n:
            return -1, 0.0
        total = np.zeros(self.n)
        for start in range(0, len(found), KEPT_WORDS // 2):
            part = found[start : start + KEPT_WORDS // 2]
            if len(self) + len(part) > KEPT_WORDS:
                self.clear()
            total += self.table[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
        best = int(total.argmax())
        return best, float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for every row of ``df``."""
    src = id_and_text(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in steps(batches):
            got = [scorer.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([held.value.langs[i] if i >= 0 else "und" for i, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, lang_pred string, score double")
