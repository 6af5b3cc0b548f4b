import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tablesmith.llm import align, queries, subwords
from tests.llm.test_token_files import ODD, odd_texts

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Rows of (id, text) by whole texts, token by token."""
    lib, sp = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lib.encode_special_tokens = True
    of = subwords.byte_characters()
    facts, holders = [], Counter()
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        ids_a = lib.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = sp.encode(t or "")
        byt_a = [bytes(of[c] for c in lib.id_to_token(x)) for x in ids_a]
        byt_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in ids_b)]
        if not t or b"".join(byt_a) != whole or b"".join(byt_b) != whole:
            facts.append((i, None, [], []))
            continue
        spans, ends = [], []
        for tokens in (byt_a, byt_b):
            at, own = 0, []
            for x in tokens:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
            ends.append({hi for _, hi in own})
        links = [(ids_a[x], ids_b[y]) for x, (lo, hi) in enumerate(spans[0]) for y, (l2, h2) in enumerate(spans[1]) if lo < h2 and l2 < hi]
        groups, before = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i, (lo, hi) in zip(ids, own, strict=True) if before <= lo and hi <= cut) for ids, own in zip((ids_a, ids_b), spans, strict=True)))
            before = cut
        holders.update(set(links))
        facts.append((i, (len(ids_a), len(ids_b)), groups, links))
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    return [
        (i, *(n or (0, 0)), len(groups), len(links), sum(holders[k] == best[k[0]] for k in links), sum(holders[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n else "")
        for i, n, groups, links in facts
    ]


def values(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_query(spark, sf):
    rows = [(r.doc_id, (r.text or "")) for r in queries.table(spark, sf, "documents").collect()]
    short = sorted(rows, key=lambda r: len(r[1]))[:150]  # the brute-force version compares all pairs of tokens
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert sorted(values(align.align(df, BYTE_LEVEL, PIECES))) == sorted(brute(short))
    whole = queries.op11_tokenizer_alignment(spark, sf)
    assert whole.count() == len(rows) and sorted(r.doc_id for r in whole.filter("n_links >= n_groups AND n_links = n_a + n_b - n_groups").collect()) == sorted(i for i, _ in rows)


def test_odd_texts(spark, monkeypatch):
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*odd_texts(150, 9), *ODD, "the end", "the end", "<s> </s> <0x41> <unk>", "ﬁ ǆ"])]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 500]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    for size in (align.BLOCK_BYTES, 40):
        monkeypatch.setattr(align, "BLOCK_BYTES", size)
        assert sorted(map(repr, values(align.align(df, BYTE_LEVEL, PIECES)))) == sorted(map(repr, brute(rows)))
    text = {r.doc_id: r for r in align.align(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string"), BYTE_LEVEL, PIECES, with_groups=True).collect()}
    assert text[1].groups_sha256 == hashlib.sha256(text[1].groups.encode()).hexdigest() and text[1].groups.count(";") == 1 and text[2].groups == text[3].groups == ""
    assert align.align(df.limit(0), BYTE_LEVEL, PIECES).count() == 0


def test_long_text(spark):
    t = "Tokenizers differ; naïve ones too. " * 20_000
    [r] = align.align(spark.createDataFrame([("x", t)], "key string, body string"), BYTE_LEVEL, PIECES, id_col="key", text_col="body").collect()
    lib = Tokenizer.from_file(BYTE_LEVEL)
    assert r.n_a == len(lib.encode(" " + t).ids) and r.n_best <= r.n_links == r.n_a + r.n_b - r.n_groups == r.count_sum
