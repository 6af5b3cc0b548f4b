import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tablesmith.llm import byte_bpe, components, decontaminate, language_id, license_scan, license_sql, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_tiktoken(spark, tik):
    rng = random.Random(1)
    cases = [None, "", " ", "a" * 5000, "日本語テキスト" * 40, "é̂ñ😀 123 45.6's 't <|endoftext|>", "\n\n \t x", "x y " * 3000, "".join(rng.choices("abé ", k=4000)), "".join(rng.choices("abcdefghij", k=9000)), "x", "x"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(cases)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.encode_decode(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(cases):
        assert got[i].ids == tik.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
    assert byte_bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    again = byte_bpe.decode(spark.createDataFrame([(1, got[5].ids), (2, None)], "doc_id long, ids array<int>"), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()} == {1: cases[5].encode(), 2: b""}


def test_bpe_folded_rows(tik):
    bpe, rng = byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN), random.Random(3)
    for k in range(60):
        piece = "".join(rng.choices(rng.choice(["ab", "aab ", "etaoin", "日本a", "0123456789"]), k=rng.randint(2, 400))).encode()
        if piece not in bpe.ranks:
            ids = bpe.of_byte[list(piece)]
            [plain] = bpe.merge(ids[None, :].copy(), np.array([len(ids)]))
            assert bpe.merge_folded(ids).tolist() == plain.tolist()
    assert bpe.merge_folded(bpe.of_byte[list(b"ab" * 100_000)]).size == 100_000


def test_bpe_query(spark, sf, tik):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    for r in queries.op10_byte_bpe(spark, sf).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_language_id(spark, sf):
    lang = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").collect()}
    held = [r for r in queries.op8_language_id(spark, sf).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    rows = spark.createDataFrame([(i, t, lg) for i, (t, lg) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None), ("the the", "en"), ("die die und", "de")] * 3)], "doc_id long, text string, lang string")
    model = language_id.train(rows, F.lit(True), docs_per_lang=10_000)
    cases = [None, "", "12 34 !", "THE unseencat", "hundert", "the " * 500_000, "½ ² ① Ⅷ", "½ ² ① die"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in range(8)] == ["und", "und", "und", "en", "de", "en", "und", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[0][1] == 0
    nothing = language_id.train(rows.limit(0), F.lit(True))
    assert language_id.identify(rows, nothing).filter("lang_pred <> 'und'").count() == 0


def plain_languages(docs):
    """The model and its scores by plain counting: all training rows are in the sample of so small a table."""
    word = re.compile(r"[^\W\d_]+")
    of = lambda t: [w for w in word.findall((t or "").lower()) if any(c.isalpha() for c in w)]
    known, grams = defaultdict(Counter), {k: defaultdict(Counter) for k in range(1, 6)}
    for d in docs:
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1:
            for w in of(d.text):
                known[w][d.lang] += 1
                for k in grams:
                    for i in range(len(w) + 3 - k):
                        grams[k][f"_{w}_"[i : i + k]][d.lang] += 1
    langs = sorted({lang for c in known.values() for lang in c})
    total = {id(t): {lang: sum(c[lang] for c in t.values()) for lang in langs} for t in (known, *grams.values())}

    def log(table, name):
        return [math.log((table[name][lang] + 0.1) / (total[id(table)][lang] + 0.1 * len(table))) for lang in langs]

    def weigh(w):
        if w in known:
            return log(known, w)
        for k in range(5, 0, -1):
            found = [log(grams[k], g) for g in (f"_{w}_"[i : i + k] for i in range(len(w) + 3 - k)) if g in grams[k]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = {}
    for d in docs:
        found = of(d.text)
        sums = [sum(x) for x in zip(*map(weigh, found), strict=True)]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i)) if found else None
        out[d.doc_id] = ("und", 0.0) if best is None else (langs[best], 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums))
    return out


def test_language_query_against_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents").collect()
    want = plain_languages(docs)
    for r in queries.op8_language_id(spark, sf).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6, r.doc_id


def test_language_rows_of_any_shape(spark):
    rows = spark.createDataFrame([(1, "der hund", "de", 5), (1, "der hund", "de", 5), (None, "the dog", "en", 6), (None, None, None, None), (3, "the hund", None, 1)], "doc_id long, text string, lang string, score int")
    model = language_id.train(rows, F.lit(True))
    got = language_id.identify(rows, model)
    assert got.count() == 5 and {(r.doc_id, r.lang_pred) for r in got.filter("doc_id = 1 OR score = 0").collect()} == {(1, "de"), (None, "und")}
    tie = language_id.train(spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string"), F.lit(True))
    assert language_id.identify(rows.limit(1), tie).first().lang_pred == "a"
    assert language_id.identify(rows.limit(0), model).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_TEXT = """ * Copyright (c) 2019, Some Body
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""
BSD_NAME = """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
APACHE_TEXT = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_TEXT = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
"""
LGPL_TEXT = GPL_TEXT.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
MPL_TEXT = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
LICENSED = [
    (None, "", "none"),
    ("", "", "none"),
    ("Code.\nReleased under the MIT License.", "MIT", "permissive"),
    ("Licensed under CC BY 4.0. All rights reserved.", "CC-BY-4.0", "permissive"),
    ("x\n" * 5000 + "Released under the BSD license!", "BSD-2-Clause", "permissive"),
    ("All rights reserved.", "Proprietary", "restricted"),
    (MIT_TEXT, "MIT", "permissive"),
    (MIT_TEXT.replace("\n", "\r\n"), "MIT", "permissive"),
    (BSD_TEXT, "BSD-2-Clause", "permissive"),
    (BSD_TEXT + BSD_NAME, "BSD-3-Clause", "permissive"),
    (APACHE_TEXT, "Apache-2.0", "permissive"),
    (GPL_TEXT, "GPL-3.0-or-later", "copyleft"),
    (LGPL_TEXT + "\n" + GPL_TEXT, "LGPL-2.1-or-later,GPL-3.0-or-later", "copyleft"),
    (MPL_TEXT, "MPL-2.0", "copyleft"),
    ("This project is licensed under the MIT License.", "MIT", "permissive"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "copyleft"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main;", "GPL-2.0", "copyleft"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0", "noncommercial"),
    ("The MIT licence is short. We talk about licenses, permission and rights under the sun.", "", "none"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989", "GPL-2.0", "copyleft"),
]


def test_license_scan_against_sql(spark, sf, tmp_path):
    rows = spark.createDataFrame([(i, t, "z") for i, (t, _, _) in enumerate(LICENSED)], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.verdict) for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(LICENSED))] == [(n, v) for _, n, v in LICENSED]
    rows.write.parquet(str(tmp_path / "rows"))
    for path, found in ((f"{tmp_path}/rows/*.parquet", license_scan.scan(rows)), (f"{sf}/documents.parquet", queries.op3_license_scan(spark, sf))):
        want = duckdb.connect().execute(license_sql.sql(table=f"'{path}'")).fetchall()
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert license_scan.scan(rows.limit(0)).count() == 0 and license_scan.scan(rows.unionByName(rows).withColumn("doc_id", F.lit(None).cast("long"))).count() == 2 * len(LICENSED)


def plain_leaks(docs, items):
    def shingles(words, width):
        return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = set()
    for item, text in items:
        own = words(text)
        if not own:
            continue
        width = min(5, len(own))
        want = shingles(own, width)
        for doc, t in docs:
            w = words(t)
            for i in range(max(0, len(w) - width + 1)):
                window = shingles(w[i : i + len(own)], width)
                both = sum((window & want).values())
                if both and both / sum((window | want).values()) >= 0.8:
                    out.add((doc, item))
                    break
    return out


def test_leaks_against_brute_force(spark, sf):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(12)] + [(50, None), (51, ""), (52, "only three words"), (53, "a b a b a b a b a b a b"), (0, "again 1 2 3 4 5 6 7")]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        copy = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
        docs.append((d, " ".join(text[:30] + copy + text[30:]).upper() if d % 2 else "! ".join(text[:20] + copy)))
    docs += [(100, None), (101, ""), (102, "a b " * 4000), (103, "say only THREE, words."), (103, "say only THREE, words."), (104, "w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, it).collect()}
    assert got == plain_leaks(docs, items)
    flagged = {d for d, _ in got}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, it).collect()) == sorted(d for d, _ in docs if d not in flagged)
    assert decontaminate.find_leaks(df, it.limit(0)).count() == 0 == decontaminate.find_leaks(df.limit(0), it).count()
    mine = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    theirs = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf).collect()} == plain_leaks(mine, theirs)


def test_pipeline(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    at, kept = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in at.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= kept, name
        assert set(ids) == kept or k < 3, name
        kept = set(ids)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in at.collect()}
    one = {r.component_id for r in queries.op4_simhash_near_dedup(spark, sf).collect()}
    assert 0.5 * len(one) < len(kept) <= len(one)


def test_pipeline_keeps_one_row_of_repeated_ids(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", None, None, None), (None, "x y z", "en", "s", 5), (3, None, "en", "s", 0)], queries.table(spark, sf, "documents").schema)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == ["1", "3", "None"]


def test_leaks_beyond_the_radius_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices([f"v{k}" for k in range(500)], k=rng.randint(8, 14)))) for i in range(40)]
    docs = []
    for d in range(80):
        copy = items[d % 40][1].split()
        at = rng.randrange(len(copy))
        docs.append((d, " ".join([f"x{d}", *copy[:at], *([] if d % 3 else ["odd"]), *copy[at + (d % 2) :], f"y{d}"])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    assert len(want) > 10
    for radius in (0, 12):  # whatever the blocks find, the exact check does the rest
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, it, radius=radius).collect()} == want
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, it).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leaks_in_a_very_long_text_and_of_many_items(spark):
    few = spark.createDataFrame([(1, "a b " * 12), (2, "one two three four five six seven eight")], "item_id long, text string")
    long = spark.createDataFrame([(1, "a b " * 500_000), (2, "w " * 300_000 + "one two three four five six seven eight" + " w" * 1000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(long, few).collect()} == {(1, 1), (2, 2)}
    many = spark.range(20_000).selectExpr("id as item_id", "array_join(transform(sequence(1, 31), i -> concat('k', cast(pmod(xxhash64(id, i), 100000) as string))), ' ') as text")
    docs = many.filter("item_id % 1000 = 7").selectExpr("item_id + 5 as doc_id", "concat('before ', text, ' after') as text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, many).collect()} == {(1000 * i + 12, 1000 * i + 7) for i in range(20)}


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Empty input, clashing and missing columns, null and very long texts go through every stage."""
    kind = queries.table(spark, sf, "documents").schema
    odd = [(1, "word " * 60_000, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "password = 'k8sJ2mQ9xZ4tB7'", "de", "s", 28), (4, "password = 'k8sJ2mQ9xZ4tB7'", "de", "s", 28)]
    for docs in (spark.createDataFrame([], kind), spark.createDataFrame(odd, kind).withColumns({"score": F.lit(1), "component_id": F.lit("x"), "id": F.lit(None).cast("string"), "rows": F.lit(2)}).drop("n_chars")):
        at = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            assert k == 4 or out.columns == docs.columns, name
            at = out if k == 4 else components.cut(out)
            if name == "secret_scan":
                assert at.filter("text LIKE '%k8sJ2mQ9xZ4tB7%'").count() == 0
        assert at.count() == (4 if docs.count() else 0)  # of rows 2 and 3, copies of each other, one stays
