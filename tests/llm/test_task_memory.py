"""What a task holds or sends at a time is bounded, and results do not depend on it."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from tablesmith.llm import align, phrases


def test_longer_phrases_are_sent_in_chunks(monkeypatch):
    monkeypatch.setattr(phrases, "SENT_ROWS", 10, raising=False)
    text = np.append(np.tile(np.arange(1, 31), 2), 0).astype(np.int32)
    pairs = sorted({(int(a), int(b)) for a, b in zip(text[:-2], text[1:-1], strict=True)})
    answers = pa.table({"local_a": pa.array([a for a, _ in pairs], pa.int32()), "local_b": pa.array([b for _, b in pairs], pa.int32()), "a": [100 + a for a, _ in pairs], "b": [100 + b for _, b in pairs]})
    shard = pa.table({"shard": [0], "size": [len(text)], "text": [phrases._packed(text)]})
    got = phrases._longer(shard, answers, 5)
    assert max(len(b) for b in got.to_batches()) <= 10
    want = {}
    words = [100 + int(w) for w in text[:-1]]
    for k in (3, 4, 5):
        for i in range(len(words) - k + 1):
            key = (*words[i : i + k], *[-1] * (5 - k))
            want[key] = want.get(key, 0) + 1
    assert {tuple(r[f"g{i}"] for i in range(5)): r["n"] for r in got.to_pylist()} == want


def test_steps_of_a_block_do_not_show(monkeypatch):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = pa.table({"id": list(range(40)), "text": pa.array([None if i == 3 else "" if i == 4 else f"Some words {i % 7}, über {'x' * i}  and\nmore" for i in range(40)], pa.string())})
    found = []
    for most in (1 << 20, 100):
        monkeypatch.setattr(align, "ALIGNED_BYTES", most)
        found.append(align._align(docs, 5, files, True).to_pylist())
    assert found[0] == found[1] and sum(r["n_links"] for r in found[0]) > 0


def test_what_shards_send_does_not_grow_with_the_frequent_pairs(spark, monkeypatch):
    """Nearly all pairs are frequent; the phrases of 20 parts and more are those of one."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 100, 600)), "en") for _ in range(100)], "text string, lang string")
    found = []
    for most in (1 << 20, 3000):
        monkeypatch.setattr(phrases, "PART_WORDS", most, raising=False)
        before = written()
        words, counted = phrases.count_phrases(df, 3, shard_bytes=4096)
        assert written() - before < 60_000
        word = {r.id: r.word for r in words.collect()}
        found.append(sorted((tuple(word[x] for x in r.key), r.f) for r in counted.collect()))
    assert found[0] == found[1] and sum(len(k) == 2 for k, _ in found[0]) > 9000
