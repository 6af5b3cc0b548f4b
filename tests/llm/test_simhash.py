import random

import numpy as np
import pytest
import xxhash

from tablesmith.llm import queries, simhash
from tablesmith.llm.components import components


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in ["", " \n", "One", "one two", "A b C d", "é É x y z\x0bw", "w " * 20000, "a b c a b c a b c"]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t), t


@pytest.mark.parametrize("most", [1 << 14, 5])
def test_links_join_what_all_pairs_join(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "CELL", most)
    rng = random.Random(3)
    fps = []
    for _ in range(150):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            fps.append(fp)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                fp ^= 1 << b
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    at = {f: i for i, f in enumerate(signed)}
    got = [(at[r.a], at[r.b]) for r in found]
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in got)
    assert plain_components(range(len(fps)), got) == plain_components(range(len(fps)), near)


def test_one_cell_of_many_near_copies_gives_few_links():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(0), *[np.uint64(1) << np.uint64(a) | np.uint64(1) << np.uint64(b) for a in range(30) for b in range(30)]], axis=None).astype(np.uint64))
    rng.shuffle(fps)
    a, b = simhash.join_cells(np.zeros(len(fps), np.int32), np.zeros(len(fps), np.int64), fps, 3)
    assert len(a) < 8 * len(fps)
    root = plain_components(fps.tolist(), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert len(set(root.values())) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 905), (905, 901), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 900, 901: 900, 905: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    fp = {d: plain_fingerprint(t) for d, t in docs.items()}
    near = [(a, b) for a in docs for b in docs if a > b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = {d: (f"{fp[d]:016x}", c) for d, c in plain_components(docs, near).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_near_dedup(spark, sf).collect()} == want


def test_edges_of_the_input(spark):
    rows = spark.createDataFrame([(5, None, "a"), (3, "", None), (9, "x y z", "b"), (9, "x y z", "b"), (None, "x y z", "c")], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 9), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
