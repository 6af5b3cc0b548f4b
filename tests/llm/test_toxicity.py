import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablesmith.llm import queries, toxicity


def test_toxicity_neighbours_are_exact():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    idf = {w: rng.uniform(1, 5) for w in words}
    examples = [(i, rng.randint(0, 1), dict(Counter(rng.choices(words, k=rng.randint(1, 6))))) for i in range(900)]
    index = toxicity.Index.build(examples, idf, 0.3, 0.1)

    def unit(c):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    for _ in range(60):
        query = dict(Counter(rng.choices(words, k=rng.randint(1, 5))))
        q = unit(query)
        plain = sorted((-sum(q.get(t, 0) * w for t, w in unit(c).items()), i) for i, _, c in examples)
        last = plain[14][0] if len(plain) > 14 else 0
        [(near, cosine)] = index.nearest([query], 15)
        assert {i for s, i in plain if s < 0 and s <= last - 1e-6} <= set(near.tolist()) <= {i for s, i in plain if s < 0 and s <= last + 1e-6}
        exact = {i: -s for s, i in plain}
        assert np.allclose([exact[i] for i in near.tolist()], cosine, atol=1e-6) and len(near) >= min(15, sum(s < 0 for s, _ in plain))
    assert [(v, list(near)) for v, near in index.scores([{}], 15, 0.5)] == [(0.1, [])]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join([*rng.choices([f"w{k}" for k in range(300)], k=25), "nasty" if i % 6 == 0 else "kind"])) for i in range(600)] + [(1000, None), (1001, ""), (1002, "NASTY " * 40_000)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels, queries.fold(5) != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in range(600)) and got[1002] > 0.5 > got[1000] == got[1001]
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, index).collect()) == [i for i in sorted(got) if got[i] < 0.5]
    nobody = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, nobody).filter("score <> 0").count() == 0
    assert toxicity.score(docs.limit(0), index).count() == 0


def test_toxicity_reaches_documents_of_rare_words(spark):
    # Each word occurs in two toxic examples only, or in toxic and clean ones alike: none is significant by itself.
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    toxic = [(i, " ".join([*rng.choices(common, k=12), f"bad{i // 2}", f"vile{i // 2}", f"mean{i // 2}"])) for i in range(60)]
    clean = [(i, " ".join([*rng.choices(common, k=12), f"nice{i // 2}", f"good{i // 2}"])) for i in range(60, 360)]
    index = toxicity.train(spark.createDataFrame(toxic + clean, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 60)) for i in range(360)], "doc_id long, toxic int"), F.lit(True))
    assert 300 < len(index.ids) < 360  # a tenth is kept for the calibration
    asked = [(1000 + i, f"bad{i} vile{i} mean{i}") for i in range(30)] + [(2000 + i, f"nice{30 + i} good{30 + i}") for i in range(30)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), index).collect()}
    held = {str(i) for i in index.ids}
    assert all({str(2 * i), str(2 * i + 1)} & held == set(got[1000 + i].neighbours) for i in range(30))
    toxic_scores = [got[1000 + i].score for i in range(30) if got[1000 + i].neighbours]
    assert min(toxic_scores) > 0.5
    assert max(got[2000 + i].score for i in range(30) if got[2000 + i].neighbours) < min(toxic_scores)


def test_toxicity_takes_all_ties(spark):
    counts = [{"x": 1, f"y{i // 30}": 1} for i in range(60)]
    index = toxicity.Index.build([(i, i % 2, c) for i, c in enumerate(counts)], {"x": 1.0, "y0": 2.0, "y1": 2.0}, 0.5, 0.5)
    [(near, _)] = index.nearest([{"y0": 1}], 15)
    assert sorted(near.tolist()) == list(range(30))
    [(value, _)] = index.votes([{"y0": 1}], 15, 1.0)
    assert abs(value - 0.5) < 1e-12


def test_toxicity_rows_without_id(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "kind word") for i in range(40)] + [(None, "bad word"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (777, 1)], "doc_id long, toxic int")
    index = toxicity.train(docs, labels, F.lit(True))
    assert None not in index.ids and toxicity.score(docs, index).count() == 42


def plain_scores(spark, sf, index, k=15, prior=1.0):
    """The query's scores from texts and labels, but for which rows are examples."""
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    docs = {r.doc_id: Counter(re.findall(r"\w+", (r.text or "").lower())) for r in queries.table(spark, sf, "documents").collect()}
    examples = {i: docs[i] for i in index.ids}
    assert set(examples) <= set(labels)
    t, t1 = len(examples), sum(labels[i] for i in examples)
    seen, n1, n = Counter(w for c in docs.values() for w in c), Counter(w for i, c in examples.items() if labels[i] for w in c), Counter(w for c in examples.values() for w in c)

    def idf(w):
        chi = t * (n1[w] * (t - t1) - (n[w] - n1[w]) * t1) ** 2 / max(n[w] * (t - n[w]) * t1 * (t - t1), 1)
        return (math.log((len(docs) + 1) / (seen[w] + 1)) + 1) * (chi + 0.1)

    weight = {w: float(np.float32(idf(w))) for w in n}

    def unit(c):
        v = {w: (1 + math.log(x)) * weight[w] for w, x in c.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = [(labels[i], i, unit(c)) for i, c in examples.items()]
    out = {}
    for doc, c in docs.items():
        q = unit(c)
        cosine = [(sum(x * e[w] for w, x in q.items() if w in e), label, i) for label, i, e in known]
        last = sorted((x for x, _, _ in cosine), reverse=True)[k - 1] if len(cosine) >= k else 0
        near = [(x, label, i) for x, label, i in cosine if x > 0 and x >= last - 1e-6]  # ties within the weights' single precision
        total = sum(x for x, _, _ in near)
        vote = (sum(x * label for x, label, _ in near) + prior * t1 / t) / (total + prior)
        out[doc] = (1 / (1 + math.exp(-index.slope * vote - index.shift)) if index.slope > 0 else vote, {str(i) for _, _, i in near}) if near else (index.bare, set())
    return out


def test_toxicity_query_against_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents")
    index = queries.toxicity_index(spark, docs, sf)
    want = plain_scores(spark, sf, index)
    got = queries.op6_toxicity(spark, sf).collect()
    assert len(got) == docs.count()
    for r in got:
        assert abs(r.score - want[r.doc_id][0]) < 1e-6 and set(r.neighbours) == want[r.doc_id][1], r.doc_id
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
