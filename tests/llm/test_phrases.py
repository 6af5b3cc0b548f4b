import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tablesmith.llm import phrase_sql, phrases, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=100, longest=5, absorbed=100):
    """Rows of (text, lang), phrase by phrase."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: f for key, f in counts.items() if f >= least and len(key[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and 100 * f >= absorbed * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), f in found.items()):
            continue
        score, k = min((1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], total[lang], score))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return ranked


def values(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_index_enumerates_every_phrase():
    rng = np.random.default_rng(2)
    for kinds, size in ((2, 40), (4, 300), (50, 2000), (1, 30)):
        text = rng.integers(0, kinds + 1, size).astype(np.int32)
        text[0] = text[-1] = 0
        want = {k: Counter() for k in range(2, 6)}
        for i in range(size):
            for k in want:
                own = tuple(text[i : i + k].tolist())
                if len(own) == k and 0 not in own:
                    want[k][own] += 1
        got = {k: {} for k in want}
        for found, n in phrases.enumerate_phrases(text, 5):
            got[found.shape[1]] = dict(zip(map(tuple, found.tolist()), n.tolist(), strict=True))
        assert got == {k: dict(c) for k, c in want.items()}


@pytest.mark.parametrize("shard", [300, 8 << 20])
def test_against_brute_force(spark, shard):
    rng = random.Random(4)
    words = ["a", "B", "the", "of", "É", "ss", "x1", "日本", "\x00", "q"]
    rows = [("".join(rng.choices(words, k=1)[0] + rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n\x0b", "  "], [20, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", "en", None, "und"])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("...", "de"), ("one two three four five six " * 30, "xx"), ("one two three four five six " * 30, "xx"), ("a " * 500, "yy")]
    df = spark.createDataFrame([(t, x, "z", 3) for t, x in rows], "text string, lang string, word string, shard int").repartition(5)
    for least, absorbed in ((3, 100), (20, 60)):
        assert values(phrases.mine(df, top=60, min_count=least, absorbed=absorbed, shard_bytes=shard)) == sorted(brute(rows, 60, least, absorbed=absorbed))
    assert values(phrases.mine(df, min_count=2, longest=2)) == sorted(brute(rows, 2000, 2, 2))
    assert phrases.mine(df.limit(0)).count() == 0
    assert phrases.mine(df.limit(3), min_count=10_000).count() == 0


def test_query(spark, sf):
    docs = [(r.text, r.lang) for r in queries.table(spark, sf, "documents").collect()]
    df = queries.op13_phrase_mining(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(phrase_sql.SQL)
    names = [c[0] for c in want.description]
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert values(df) == sorted(brute(docs))


def test_products_beyond_64_bits(spark):
    rows = [(1, [1], 4 * 10**15), (2, [2], 5 * 10**15), (3, [1, 2], 3 * 10**15)]
    known = spark.createDataFrame([(1, "en", "u", rows[0][2], 9 * 10**15), (2, "en", "v", rows[1][2], 9 * 10**15)], "id long, lang string, word string, f long, total long")
    counted = spark.createDataFrame([r[1:] for r in rows], "key array<bigint>, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "count_phrases", lambda *a: (known, counted))
        [r] = phrases.mine(spark.createDataFrame([], "text string, lang string")).collect()
    assert (r.phrase, r.score) == ("u v", 1000 * rows[2][2] * 9 * 10**15 // (rows[0][2] * rows[1][2]))
