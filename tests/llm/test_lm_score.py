import zlib
from collections import Counter
from math import isclose, log10

from tablesmith.llm import lm_score, queries

SPACE = " \t\n\x0b\x0c\r"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [*(w for w in low.split(" ") if w), None]


def plain(docs, learn, prior):
    uni, bi = Counter(), Counter()
    for d, t in docs:
        if learn(d):
            words = tokens(t)
            uni.update(words)
            bi.update(zip(["<s>", *words], words, strict=False))
    n, v = sum(uni.values()), len(uni)
    begins = uni[None]
    out = {}
    for d, t in docs:
        words, base, score = tokens(t), 0.0, 0.0
        for h, w in zip(["<s>", *words], words, strict=False):
            p = (uni[w] + 1) / (n + v + 1)
            c = begins if h == "<s>" else uni[h]
            base += log10(p)
            score += log10((bi[h, w] + prior * p) / (c + prior))
        out[d] = (len(words), sum(uni[w] > 0 for w in words), n, base, score)
    return out


def same(rows, want):
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows}
    assert set(got) == set(want)
    for d, (a, b, c, base, score) in want.items():
        assert got[d][:3] == (a, b, c)
        assert isclose(got[d][3], base, rel_tol=1e-9, abs_tol=1e-12) and isclose(got[d][4], score, rel_tol=1e-9, abs_tol=1e-12)


def test_query_against_plain_counts(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    rows = queries.op2_lm_score(spark, sf).collect()
    same(rows, plain(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2, 30.0))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


def test_many_small_blocks_and_parts_give_the_same(spark):
    docs = [(i, t) for i, t in enumerate([None, "", " \n", "A a b", "a B c\x0bd", "x " * 3000, "a B c\x0bd", "é É e", "b a b a b a"] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as block", "'x' as id", "2 as learn")
    learn = df.doc_id % 4 != 1
    want = plain(docs, lambda d: d % 4 != 1, 2.5)
    for size in (20, 300, 1 << 20):
        same(lm_score.score(df, learn, prior=2.5, block_bytes=size, part_bytes=2 * size).collect(), want)
    assert lm_score.score(df.limit(0), learn).count() == 0


def test_the_model_beats_word_counts_on_held_out_text(spark):
    rows = [(i, "one two three four five six seven " * 5) for i in range(20)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), queries.fold(7) != 2).collect()
    assert all(r.score > r.base_score for r in got)
