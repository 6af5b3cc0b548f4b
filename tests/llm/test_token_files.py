import random
import struct
import zlib

import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesmith.llm import queries, subwords, token_files

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\n b", "a\n \nb", "\n", " \n x", "   x", "x 　 y", "it's 'tis  don't", "日本語 テキスト", "é̂ñ😀 123", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|> b <|endoftext|>", "<s> </s> <unk>", "▁ ▁a ▁▁ b", "\x00 \x1f x\x85 y", "x\t\t y", "a\x01 b. c", "one, two.\nThree!? it's. 3. é: ×. <|endoftext|>. x<|endoftext|>, don't, x.y. ...", "a" * 3000, "ab " * 2000]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    return [*ODD, *("".join(rng.choices([" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "日", "'s", "1", ".", ",", "!?", "\x01", "▁", " ", "\x1c"], k=rng.randint(1, 30))) for _ in range(n))]


def library(special=True):
    t = Tokenizer.from_file(BYTE_LEVEL)
    t.encode_special_tokens = not special
    return t


@pytest.mark.parametrize("special", [True, False])
def test_units_give_the_ids_of_whole_texts(special):
    import pyarrow as pa

    texts, plain = odd_texts(), library(special)
    units = subwords.Units(subwords.ByteLevel(BYTE_LEVEL, special))
    for _ in range(2):
        ids, n = units.ids(0, *units.of(pa.array(texts, pa.string())))
        at = 0
        for t, k in zip(texts, n, strict=True):
            assert ids[at : at + k].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
            at += k
    assert units.of(pa.array([], pa.string()))[0].size == 0


def test_pieces_by_units(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in odd_texts(seed=6)]
    units = subwords.Units(subwords.ByteLevel(BYTE_LEVEL, False), subwords.Pieces(PIECES))
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(subwords, "KEPT_UNITS", 5)  # forgets what it knows before the second round
    for _ in range(2):
        use, n = units.of(pa.array([" " + t for t in texts]))
        ids, count = units.ids(1, use, n)
        at, same = 0, units.spelled(use, n)
        for t, k, s in zip(texts, count, same, strict=True):
            if "▁" in t:  # the mark is read as a space, so that no text that holds it is spelled out
                assert not s
            elif t:
                want = own.encode(t)
                assert ids[at : at + k].tolist() == want, repr(t)
                assert s == (b"".join(units.encoders[1].tokens[i] for i in want) == (" " + t).encode())
            at += k


def brute(rows, special=True):
    out, at, lib = [], 0, library(special)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op12_token_files(spark, sf).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, tmp_path, encoding):
    rows = list(enumerate([t for t in odd_texts(1500) if t is None or "\x00" not in t], 7))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in reversed(rows)], "doc_id long, text string, part string, before int")
    options = token_files.layout(encoding, row_group_bytes=1 << 10, page_rows=20)
    files = token_files.write(df, str(tmp_path / "t"), BYTE_LEVEL, options=options)
    want = brute(rows)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in files.digests().collect()) == want
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in files.documents().collect()) == [w[:3] for w in want]
    stream = [i for _, _, ids in sorted((r.start, r.doc_id, r.ids) for r in files.tokens().collect()) for i in ids]
    for start, length in ((0, 1), (100, 333), (len(stream) - 5, 50), (len(stream), 3), (0, len(stream)), (1234, 0)):
        assert [i for _, ids in sorted((r.start, r.ids) for r in files.window(start, length).collect()) for i in ids] == stream[start : start + length]
    [one] = files.tokens(F.col("doc_id") == 30).collect()
    assert one.ids == stream[one.start : one.start + one.n_tokens]
    plan = files.documents(F.col("doc_id") == 30)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,30)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    groups = 0
    for f in (tmp_path / "t" / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            column = next(c for c in (meta.row_group(g).column(k) for k in range(meta.num_columns)) if c.path_in_schema.startswith("ids"))
            assert column.has_offset_index and column.has_column_index
            assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings
    assert groups > 4


def test_small_blocks_and_a_long_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 50)
    rows = [*enumerate(odd_texts(40, 2)), (1000, "A long text, told twice over; " * 40_000)]
    files = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), BYTE_LEVEL)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in files.digests().collect()) == brute(rows)


def test_odd_tables(spark, tmp_path):
    same = [(None, "a"), (None, None), (3, "x y"), (3, "x y"), (3, "z"), (1, ""), (1, None)]
    files = token_files.write(spark.createDataFrame(same, "doc_id int, text string"), str(tmp_path / "a"), BYTE_LEVEL)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in files.documents().collect())
    assert [(i, n) for _, i, n in got if i is None or i == 3] == [(None, 2), (None, 1), (3, 3), (3, 3), (3, 2)] or sorted(n for _, i, n in got if i == 3) == [2, 3, 3]
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(len(got))]
    assert [i for _, i, _ in got] == [None, None, 1, 1, 3, 3, 3]
    files = token_files.write(spark.createDataFrame([], "doc_id string, text string"), str(tmp_path / "b"), BYTE_LEVEL)
    assert files.digests().count() == 0 and files.window(0, 5).count() == 0
    named = token_files.write(spark.createDataFrame([("b", "x"), ("a", "<|endoftext|>")], "`my id` string, body string"), str(tmp_path / "c"), BYTE_LEVEL, id_col="my id", text_col="body", special_tokens=False)
    assert [(r["my id"], r.start, r.n_tokens > 2) for r in named.documents().orderBy("start").collect()] == [("a", 0, True), ("b", named.documents().filter("start = 0").first().n_tokens, False)]
    with pytest.raises(ValueError, match="encoding"):
        token_files.layout("plain")
