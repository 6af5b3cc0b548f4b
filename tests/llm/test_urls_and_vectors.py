from collections import Counter
from itertools import combinations
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import functions as F

from tablesmith.llm import hnsw, queries, url_filter


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path):
    fits = [(h + p, said) for said, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "http://ORG/", "https://a.b.org", "x://example.org/es/1", "http://Example.ORG/en/12?a=b#c", "http://example.org/en/2", "ftp://x.com/fr/?u=http://y.org/", "http://com/de/9", "http://xcom/de/9", "http://a.org?x=/es/", "http://a.com#://b.org/", "http://a.org\n/x", "a://b://c.org/q"]


def test_hosts_paths_and_rules(spark, sf):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, None, F.lit(False), queries.URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        assert (got[i].host, got[i].path) == (host, path), u
        name, said = rule(host, path)
        assert (got[i]["rule"], got[i].verdict) == (name, said or "allow"), u
    urls = {r.page_id: r.url for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.op5_url_filter(spark, sf).collect():
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.host == urlsplit(urls[r.page_id]).netloc
        assert r["rule"] == rule(r.host, r.path)[0]
    assert url_filter.judge(df.limit(0), None, F.lit(False), queries.URL_RULES).count() == 0


def test_mined_rules_fire_by_all_their_tokens(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.net/{'buy' if i % 2 == 0 else 'read'}/{i}?ref=1") for i in range(600)] + [(1000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and i % 2 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, F.col("toxic") == 1, [], confidence=0.9).collect()}
    assert got == {i: "block" if i % 6 == 0 and i < 1000 else "allow" for i, _ in rows}
    rules = url_filter.mine(pages.join(labels, pages.page_id == labels.doc_id), F.col("toxic") == 1, confidence=0.9).collect()
    assert all(r.confidence >= 0.9 and r.lift >= 1.5 for r in rules)
    sets = [set(r.antecedent) for r in rules]
    assert not any(a < b for a in sets for b in sets)


def test_redundant_supersets_crowd_out_no_rule(spark):
    # One wholly bad URL shape of 15 tokens has some 32,000 rules of confidence 1; another host is bad in three pages of four.
    deep = "http://a.b.c.bad.net/" + "/".join(f"p{k}" for k in range(10))
    urls = [(i, deep, 1) for i in range(100)] + [(i, f"http://half.org/{i}", int(i % 4 > 0)) for i in range(100, 200)] + [(i, f"http://good.com/{i}", 0) for i in range(200, 600)]
    df = spark.createDataFrame(urls, "page_id long, url string, toxic int")
    rules = url_filter.mine(df, F.col("toxic") == 1).collect()
    assert sorted(t for r in rules for t in r.antecedent if r.confidence == 1) == sorted([*(f"path=p{k}" for k in range(10)), *(f"host={h}" for h in ("a.b.c.bad.net", "b.c.bad.net", "c.bad.net", "bad.net", "net"))])
    assert {t for r in rules for t in r.antecedent if r.confidence < 1} == {"host=half.org", "host=org"}
    assert [r["rule"] for r in rules] == list(range(17))


def test_many_tokens_in_one_shape(spark):
    import time

    wide = "http://a.b.bad.net/" + "/".join(f"p{k}" for k in range(20)) + "?" + "&".join(f"q{k}=1" for k in range(10))
    urls = [(wide, 1)] * 60 + [(wide + "&odd=1", 0)] * 20 + [(f"http://good.com/{i}/p3", 0) for i in range(300)]
    df = spark.createDataFrame(urls, "url string, toxic int")
    start = time.time()
    rules = url_filter.mine(df, F.col("toxic") == 1).collect()
    assert time.time() - start < 60  # without classes there are 2^34 sets
    assert {tuple(r.antecedent) for r in rules} == {(t,) for t in plain_tokens(wide) - {"path=p3"}} and {r.confidence for r in rules} == {0.75}


def plain_rules(rows, least, confidence, lift):
    """Every set of tokens that is frequent, bad enough and not within reach of a smaller one as bad; rows: (url, bad)."""
    found = [(frozenset(plain_tokens(u)), bad) for u, bad in rows]
    n, n_bad, base = Counter(), Counter(), sum(bad for _, bad in found) / len(found)
    for tokens, bad in found:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n[c] += 1
                n_bad[c] += bad
    sure = {c: n_bad[c] / n[c] for c in n if n_bad[c] >= least}
    good = {c: s for c, s in sure.items() if s >= confidence and s / base >= lift}
    return {c for c, s in good.items() if not any(sure.get(d, 0) >= s for k in range(1, len(c)) for d in combinations(c, k))}


def plain_tokens(url):
    host, path = parts(url)
    labels = host.split(".")
    query = url.split("#")[0].partition("?")[2]
    return {*(f"host={'.'.join(labels[i:])}" for i in range(len(labels))), *(f"path={s}" for s in path.split("/") if s), *(f"query={k.split('=')[0]}" for k in query.split("&") if k)}


def test_mined_rules_against_brute_force(spark, sf):
    """On the given tables, where labels and URLs are unrelated, with thresholds low enough for chance to give rules."""
    pages, labels = queries.table(spark, sf, "pages"), queries.table(spark, sf, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rows = [(r.url, int(r.bad)) for r in pages.join(labels, pages.page_id == labels.doc_id).select("url", bad.alias("bad")).collect() if r.url and "://" in r.url]
    loose = {"least": 3, "support": 0.0, "confidence": 0.3, "lift": 1.0}
    want = plain_rules(rows, 3, 0.3, 1.0)
    known = spark.createDataFrame(rows, "url string, bad int")
    assert {tuple(r.antecedent) for r in url_filter.mine(known, F.col("bad") == 1, **loose).collect()} == want and want
    for r in url_filter.judge(pages, labels, bad, [], **loose).collect():
        fires = bool(r.url) and "://" in r.url and any(set(c) <= plain_tokens(r.url) for c in want)
        assert r.verdict == ("block" if fires else "allow"), r.url


def test_ties_of_given_rules_and_odd_rows(spark):
    rules = [("allow", "a.org", "/x"), ("block", "org", "/x/y"), ("block", "a.org", "/x"), ("allow", "org", "/x/z")]
    pages = spark.createDataFrame([(1, "http://a.org/x/y", 5), (None, "http://a.org/x", 5), (2, None, 5), (2, None, 5), (3, "http://a.org/" + "x/" * 50_000, 6)], "page_id long, url string, rule int")
    got = [(r.page_id, r["rule"], r.verdict) for r in url_filter.judge(pages, None, F.lit(False), rules).collect()]
    assert sorted(got, key=str) == sorted([(1, "a.org/x", "block"), (None, "a.org/x", "block"), (2, None, "allow"), (2, None, "allow"), (3, "a.org/x", "block")], key=str)


def brute(ids, vectors, least=0.9):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(ids))}
    for i in good:
        for j in good:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i]), np.array(vectors[j])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i].add(j)
    root = {}
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[ids[i]] = (len(links[i]), min(ids[j] for j in seen))
    return root


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range([1, 1, 2, 40][c % 4]):
            rows.append((centre + rng.normal(size=16) * 0.12).tolist())
    rows += [rows[3]] * 5 + [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], (np.array(rows[0]) * 3).tolist()]
    order = rng.permutation(len(rows)).tolist()
    vectors = [rows[i] for i in order]
    df = spark.createDataFrame([(i, v, "e") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, min_shards=3).collect()}
    assert got == brute(list(range(len(vectors))), vectors)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_graph():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    v[1500:2200] = v[0] + rng.normal(size=(700, 24)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shard = hnsw.Shard(np.arange(3000), np.ones(3000, np.int64), v)
    counts, a, b = shard.linked(np.arange(3000), v, 0.9)
    truth = v @ v.T >= 0.9
    others = truth.sum(axis=1) - 1
    assert (counts <= others).all() and counts.sum() >= 0.99 * others.sum() and 100 < shard.hit <= shard.true
    assert set(zip(a.tolist(), b.tolist(), strict=True)) and all(others[x] and others[y] for x, y in zip(a, b, strict=True))
    pairs = list(shard._found(v, hnsw.BEAM, 0.9))
    assert all(truth[q, m].all() for q, m in pairs) and sum(len(q) for q, _ in pairs) >= 0.98 * truth.sum()


def test_embedding_query(spark, sf):
    rows = queries.table(spark, sf, "embeddings").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_near_dedup(spark, sf).collect()}
    want = brute([r.vec_id for r in rows], [list(r.embedding) for r in rows])
    assert got == want


def test_dense_clusters_stay_bounded():
    import time

    rng = np.random.default_rng(1)
    n, centre = 3000, rng.normal(size=32)
    v = np.concatenate([centre / np.linalg.norm(centre) + rng.normal(size=(n, 32)) * 0.03, rng.normal(size=(1500, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, copies = rng.permutation(len(v)).astype(np.int64), rng.integers(1, 4, len(v))
    start = time.process_time()
    shard, counts, edges = hnsw.Shard(ids, copies, v), np.zeros(len(v), dtype=np.int64), []
    for i in range(0, len(v), hnsw.BATCH):
        counts[i : i + hnsw.BATCH], a, b = shard.linked(ids[i : i + hnsw.BATCH], v[i : i + hnsw.BATCH], 0.9)
        edges.append((a, b))
    assert time.process_time() - start < 60
    true = v @ v.T >= 0.9
    np.fill_diagonal(true, False)
    assert abs(counts - true @ copies).sum() <= 0.01 * (true @ copies).sum() and (counts <= true @ copies).all()
    assert sum(len(a) for a, _ in edges) < 3 * len(v)
    node, root = hnsw._forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
    assert set(node) | set(root) == set(ids[true.any(axis=1)]) and np.unique(root[np.isin(node, ids[:n])]).size == 1
