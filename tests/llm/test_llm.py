"""The training-data operators against brute force, on the small test tables
and on fixtures with NULLs, empty and long texts, ties, repeated rows, empty
tables and clashing extra columns."""

import hashlib
import html
import os
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402
from visitlens.llm import html_text, jaccard_join, license_scan, packing, quality, sharding, vector_dedup, vector_topk  # noqa: E402
from visitlens.llm.components import connected_components  # noqa: E402
from visitlens.llm.line_dedup import dedup_lines, keep_bitmaps  # noqa: E402
from visitlens.llm.mixing import mix_documents, mixed_corpus  # noqa: E402
from visitlens.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(table, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


class Sets(dict):
    """Union-find, the smallest member names a set."""

    def of(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.of(a), self.of(b)
        self[max(a, b)] = min(a, b)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_classes(texts):
    """{id: (set size, component)} by all pairs that share a shingle."""
    sets, found, classes = {i: shingles(t) for i, t in texts}, {}, Sets()
    for i, s in sets.items():
        for x in s:
            found.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in found[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                classes.join(i, j)
    return {i: (len(s), classes.of(i)) for i, s in sets.items()}


ODD = [
    (1, None, "en", "b", None), (2, "", "en", None, 0), (3, " \n\t\n", None, "a", 3), (4, "short", "en", "a", 5),
    (5, "A line of some length\nanother line of it\nshort", "en", "a", 1), (6, "a LINE of some length  \nshort\n\n", "en", "b", 1),
    (7, "a line of some length\na line of some length", "en", "b", 1), (7, "a line of some length\na line of some length", "en", "b", 1),
    (8, "word " * 30_000, "en", "c", 1), (9, "x" * 60_000, "en", "c", 1), (None, "A line of some length\nlast of all lines", "en", "a", 1),
    (None, None, None, None, None), (10, "Released under the MIT License.", "en", "é", 1), (11, "ÉCOLE de l'été\nécole de l'été", "fr", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with extra columns named like the operators' own."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("score", "shard", "slot", "h1", "keep", "n_lines", "piece", "length", "place", "size", "target", "features", "label", "range"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_matches_sql(spark, key):
    got, want = rows_of(QUERIES[key](spark, SF).toPandas()), rows_of(duck(SF).execute(ORACLE_SQL[key]).df())
    assert got == want


# quality classifier

def test_quality_held_out(spark):
    got = QUERIES["op1_quality"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(rows("documents", "doc_id")) and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    assert (got.predicted == (got.score >= 0.3)).all()
    labels = [(i, q) for i, q in rows("labels", "doc_id, quality") if zlib.crc32(str(i).encode()) % 5 == 0 and i in got.index]
    assert np.mean([got.predicted[i] == q for i, q in labels]) >= 0.85


def test_trees_learn_and_flatten():
    x = np.random.default_rng(1).random((2000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality.fit_trees(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:  # a walk node by node gives the same score
        raw = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + (row[f[n]] > t[n])
            raw += leaf[n - len(f)]
        assert m.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-raw)))
    assert (quality.fit_trees(x[:0], y[:0]).score(x[:3]) == 0.5).all()
    assert (quality.fit_trees(x, np.ones(2000)).score(x) > 0.99).all()


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify(odd, quality.train(odd, labels))
    assert got.columns == odd.columns and got.count() == len(ODD) and got.where("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert quality.classify(none, quality.train(none, labels.limit(0))).count() == 0


# line de-duplication

def lines_kept(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is None, i)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    owner = {}
    for i, ls in split:
        for k in map(key, ls):
            owner[k] = min(owner.get(k, i), i, key=order)
    return [(i, len(ls), (kept := [x for x in ls if len(key(x)) < 10 or owner[key(x)] == i]), len(ls) - len(kept)) for i, ls in split]


@pytest.mark.parametrize("hot", [1, 1000])
def test_line_dedup_edges(spark, odd, hot):
    from visitlens.llm.line_dedup import apply_bitmaps
    got = apply_bitmaps(odd, keep_bitmaps(odd, hot_keys=hot)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    want = [(i, n, d, "\n".join(k)) for i, n, k, d in lines_kept([(r[0], r[1]) for r in ODD])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_line_dedup_long(spark, none):
    text = "\n".join(f"line number {i:05d}" for i in range(1000))
    docs = spark.createDataFrame([(2, text), (1, "\n".join(text.split("\n")[::3])), (3, text + "\nown last line")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    want = {i: ("\n".join(k), n, d) for i, n, k, d in lines_kept([(r.doc_id, r.text) for r in docs.collect()])}
    assert {i: (r.kept_text, r.n_lines, r.n_dropped) for i, r in got.items()} == want
    assert all(w.bits != -1 for r in keep_bitmaps(docs).collect() for w in r.keep)
    assert dedup_lines(none).count() == 0


# embeddings

def dense(table_rows):
    return np.array([r[0] for r in table_rows]), np.array([r[1] for r in table_rows], float), np.array([r[2] for r in table_rows])


def clusters():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 32))
    x = centers[rng.integers(0, 12, 600)] + rng.standard_normal((600, 32)) * rng.choice([0.05, 0.2, 0.27, 0.6], (600, 1))
    return list(range(600)), x, [int(i) for i in rng.integers(0, 2, 600)]


def test_vector_dedup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    ids, x, label = clusters()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    classes = Sets()
    for i, j in zip(*np.nonzero(link)):
        classes.join(int(i), int(j))
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in zip(ids, x, label)], "vec_id long, embedding array<double>, label int")
    got = vector_dedup.near_duplicates(df).toPandas().set_index("vec_id")
    assert link.sum() > 500
    assert got.n_links.sum() >= 0.999 * link.sum() and all(got.n_links[i] <= link[i].sum() for i in ids)
    assert np.mean([got.component_id[i] == classes.of(i) for i in ids]) >= 0.99
    assert (got.kept == (got.index == got.component_id)).all()


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (3, [0.0, 0.0], 1, "x"), (4, [nan, 1.0], 1, "x"),
            (5, [None, 1.0], 1, "x"), (6, None, 1, "x"), (7, [1.0, 0.01], 2, "x"), (8, [1.0, 0.01], None, "x"), (None, [1.0, 0.0], 1, "x"),
            (9, [inf, 1.0], 1, "x"), (10, [3e200, 1e199], 2, "x"), (50, [2.0, -1.0], 1, "x"), (100, [1e18, 2.5], 1, "x"), (150, [], 1, "x"), (0, [1.0], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, g1 string").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    got = {(r.vec_id): tuple(r)[1:] for r in vector_dedup.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == got[100] == (3, 1, False) and got[7] == (1, 7, True) and got[10] == (1, 7, False)
    assert got[None] == (0, None, False) and all(got[i] == (0, i, True) for i in (0, 3, 4, 5, 6, 8, 9, 150))
    top = vector_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in top} == {50, 100}  # 150 is empty, 0 has no partner of its length
    best = [(r.rank, r.vec_id) for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == 50]
    assert best[:2] == [(1, 10), (2, 100)] and len(best) == 5
    assert vector_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [2, 16])
def test_top_k_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_topk, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(vector_topk, "BLOCK_QUERIES", 5)
    ids, x, _ = dense(rows("embeddings", "vec_id, embedding, label"))
    x = np.concatenate((x, x[:40]))
    ids = np.concatenate((ids, ids[:40] + 1_000_001))  # ties
    whole = np.floor(256 * x).astype(int)
    scores = whole @ whole.T
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        order = [j for j in np.lexsort((ids, -scores[i])) if ids[j] != ids[i]][:5]
        want += [(int(ids[i]), n + 1, int(ids[j]), int(scores[i, j])) for n, j in enumerate(order)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = vector_topk.top_k(df, F.col("vec_id") % 50 == 0, cells=cells)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_sends_no_copies_through_the_driver(spark, monkeypatch):
    """Query blocks, one copy for each vector block, were broadcast where the queries
    themselves are few; stripes and larger blocks give the same."""
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (900, 8))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scores = x @ x.T
    want = {(i, int(scores[i, j]), int(j)) for i in range(0, 900, 4) for j in [j for j in np.lexsort((np.arange(900), -scores[i])) if j != i][:5]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for few, stripe in ((64, 256), (2, 2)):
            for name, value in (("BLOCK_VECTORS", 20), ("BLOCK_QUERIES", 10), ("FEW_BLOCKS", few), ("STRIPE", stripe), ("PAIRS", 100)):
                monkeypatch.setattr(vector_topk, name, value, raising=False)
            got = vector_topk.top_k(df, F.col("vec_id") % 4 == 0)
            assert {(r.query_id, r.score, r.vec_id) for r in got.collect()} == want
            assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packed_numbers():
    for top in (0.0, -0.0, 2.0**15 - 1, -(2.0**15), 2.0**31 - 1, -(2.0**31), 1e300, float("inf")):
        x = np.array([[1.0, -3.0], [top, 0.0]])
        back = vector_topk.unpacked(vector_topk.packed(x), 2, 2)
        assert back.tobytes() == x.tobytes()


# packing

def test_vocabularies_agree():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [f"a{chr(c)}{chr(c)}1 {chr(c)}b  {chr(c)}'s" for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += [t for t, in rows("documents", "text")] + ["<|endoftext|> x", ""]
    blanks = [" " * 150_000 + "a", "x" + "\n " * 60_000, "b" + " " * 99_999 + "c"]  # about the length where the other file takes over
    texts += blanks
    assert all(list(packing.token_ids(x)) == e.ids + [2] for x, e in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False)))
    for x in blanks:
        assert list(packing.token_ids(x))[:-1] == packing._encoder(packing.vocabulary_path()).encode_ordinary(x)
    assert len(packing.token_ids(" " * 2_000_000)) == 2_000_001


def test_special_strings(spark):
    """Special strings have their own ids, as a plain call of the tokenizer gives."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> x", "<|endoftext|>", "a  <|endoftext|>\n\n<|endoftext|><|endoftext|> <|endoftext| é's <|ENDOFTEXT|>",
             "b" + " " * 150_000 + "<|endoftext|>  c", "no such string  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.tokenised_pieces(docs, max_tokens=10**6, with_ids=True).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)} and got[0] == [64, 220, 50256, 2124, 2]


def check_packed(packed, texts, most=1024):
    assert sorted((p.doc_id is None, p.doc_id, p.piece) for p in packed if p.piece == 0) == sorted((i is None, i, 0) for i, _ in texts)
    for i, t in {(i, t) for i, t in texts}:
        ids = packing.token_ids(t)
        bounds = {(p.piece, p.start, p.length, p.ids_crc32) for p in packed if p.doc_id == i}
        first = len(ids) % most or most
        cuts = [0, *range(first, len(ids) + 1, most)]
        assert {(n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))} <= bounds
    by = {}
    for p in packed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= most
    return by


def test_packing(spark):
    packed = [r for r in QUERIES["op4_packing"](spark, SF).toPandas().itertuples()]
    by = check_packed(packed, rows("documents", "doc_id, text"))
    assert len(by) <= 1.01 * sum(p.length for p in packed) / 1024 + 1


def test_packing_constraints(spark, odd, none):
    packed = packing.pack_documents(odd, max_docs=2, max_attention=1024 * 1024).collect()
    by = check_packed(packed, [(r[0], r[1]) for r in ODD])
    assert max(map(len, by.values())) == 2
    rng = np.random.default_rng(5)
    n = rng.integers(1, 1024, 3000)
    for cap in ((1024, 4, 1024**2), (1024, 1000, 700_000)):
        n_ok = n[n**2 <= cap[2]]
        bins, offsets = packing.best_fit(n_ok, cap)
        for b in np.unique(bins):
            own = n_ok[bins == b]
            assert own.sum() <= cap[0] and len(own) <= cap[1] and (own**2).sum() <= cap[2]
            assert sorted(offsets[bins == b])[0] == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([900]), (1024, 4, 100))
    assert packing.pack_documents(none).count() == 0
    ids = packing.tokenised_pieces(odd, with_ids=True).where("doc_id = 4").first()
    assert zlib.crc32(np.array(ids.ids, "<u4").tobytes()) == ids.ids_crc32 and ids.ids[-1] == 2


def test_packing_short_texts(spark):
    """Empty texts, a token each, fill sequences to their 1024 tokens."""
    packed = packing.pack_documents(spark.range(3000).selectExpr("id AS doc_id", "'' AS text")).collect()
    assert sorted(Counter(r.sequence_id for r in packed).values()) == [952, 1024, 1024]


# sharding

def test_sharding(spark, odd, none):
    got = QUERIES["op5_sharding"](spark, SF).collect()
    texts = dict(rows("documents", "doc_id, text"))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert len(got) == len(texts) and all(r.grown_shard in (r.shard, 24) for r in got)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    out = sharding.assign_shards(odd, sharding.tree_for(24)).collect()
    assert len(out) == len(ODD) and {r.grown_shard for r in out} == {None} and len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.assign_shards(none, sharding.tree_for(24)).count() == 0


def test_sharding_moves_only_where_weights_change(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("key"))

    def shards(tree):
        return dict(map(tuple, sharding.with_shard(ids, F.col("key"), tree, "s").collect()))

    base = sharding.tree_for(24)
    before = shards(base)
    assert max(Counter(before.values()).values()) < 1.25 * 20_000 / 24
    for n in (25, 26):
        after = shards(sharding.tree_for(n))
        assert {after[k] for k in before if before[k] != after[k]} == set(range(24, n))
    heavier = [[list(rack) for rack in region] for region in base]
    heavier[1][0][2] = (heavier[1][0][2][0], 4.0)  # shard 10
    after = shards(heavier)
    moved = {(before[k], after[k]) for k in before if before[k] != after[k]}
    assert {b // 8 for _, b in moved} == {1}  # into its region only
    assert all(b == 10 for a, b in moved if a // 4 == 2)  # inside its rack only to the shard
    assert all(b // 4 == 2 for a, b in moved if a // 8 == 1)  # inside its region only to the rack
    gone = [[list(rack) for rack in region] for region in base]
    gone[0] = [[(n, 0.0) for n, _ in rack] for rack in gone[0]]
    assert set(shards(gone).values()) == set(range(8, 24))


# licence scan

def test_license_base(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, SF).collect()}
    for i, text in rows("documents", "doc_id, text"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        at = [(k, label) for p, label in license_scan.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    out = license_scan.scan_licenses(odd).collect()
    assert len(out) == len(ODD) and {r.labels for r in out if r.doc_id == 10} == {"mit"} and {r.score for r in out if r.doc_id == 1} == {0.0}
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text, found", [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("licensed under the apache license version 3 0", []),
    ("Distributed under the terms of the MIT license", ["mit"]), ("distributed under some terms of the mit license", []),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("licensed under a Creative Commons Attribution 4.0 International License", ["cc-by-4.0"]),
    ("work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]), ("SPDX-License-Identifier: MIT", ["mit", "spdx"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["gpl-2.0-or-later"]), ("SPDX-License-Identifier: Foo-1.0", ["spdx"]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", ["apache-2.0", "bsd-3-clause", "mit"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["gpl-2.0"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", ["gpl-3.0"]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["lgpl-or-later"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["agpl-or-later"]),
    ("This program is free software: you can sell it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", []),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", ["gpl-3.0"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to change verbatim copies of this license document.", []),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.", ["apache-2.0"]),
    ("Mozilla Public License Version 2.0\n==================\n1. Definitions", ["mpl-2.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mpl-2.0"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/1.1/.", []),
    ("To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to this work.", ["cc0-1.0"]),
    ("To the extent possible under law, Jo Doe has kept all copyright and related or neighboring rights to this work.", []),
    ("licensed under CC BY-NC-ND 4.0", ["cc-by-nc-nd-4.0"]), ("licensed under CC BY-NC-ND 7.0", []),
    ("BSD 3-Clause License\nCopyright", ["bsd"]), ("BSD 9-Clause License", []),
])
def test_license_templates(text, found):
    _, spans = license_scan.scan_words(license_scan.words_of(text), license_scan.compile_templates(), [])
    assert [s[0] for s in spans] == found


def test_license_short_texts_whole():
    """zlib and Unlicense, over their whole wording; a changed condition is refused."""
    zlib_ = next(m for label, m in license_scan.TEMPLATES if label == "zlib")
    unlicense = next(m for label, m in license_scan.TEMPLATES if label == "unlicense")
    plain = lambda m: re.sub(r"\[[^\]]*\] ?|\{\d+\}", "", re.sub(r"\(([^|)]*)\|[^)]*\)", r"\1", m))
    for label, markup, word, other in (("zlib", zlib_, "must not claim", "may claim"), ("unlicense", unlicense, "free to copy", "paid to copy")):
        found = lambda t: [s for s, _, _ in license_scan.scan_words(license_scan.words_of(t), license_scan.compile_templates(), [])[1]]
        assert found(plain(markup)) == [label] and found(plain(markup).replace(word, other)) == []


MIT = """Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
X11_END = """ Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote
the sale, use or other dealings in this Software without prior written authorization from the X Consortium."""
BSD = """Copyright 2001, Some Body. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Copyright (c) 2004 Some Body
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """You may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
BINARY = BSD[BSD.index("2. Red"):BSD.index("3. Nei")]


@pytest.mark.parametrize("text, found", [
    (MIT, ["mit"]), (MIT.replace('"', "\u201c", 1).replace('"', "\u201d", 1).replace("(the \u201cSoftware\u201d)", "(the \u201csoftware\u201d)"), ["mit"]),
    (BSD, ["bsd"]), (BSD[:BSD.index("3. Nei")] + BSD[BSD.index("THIS SOFT"):], ["bsd"]), (ISC, ["isc"]), (APACHE, ["apache-2.0"]),
    (MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE X CONSORTIUM") + X11_END, ["x11"]), (MIT + X11_END, ["x11"]),
    (MIT.replace("WITHOUT WARRANTY", "WITH A WARRANTY"), []), (MIT[:MIT.index("THE SOFTWARE IS")], []),
    (MIT.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil. THE SOFTWARE IS"), []),  # JSON
    (MIT[:MIT.index(", subject")] + ". " + MIT[MIT.index("THE SOFTWARE IS"):], []),  # MIT-0
    (BSD.replace("ARE DISCLAIMED", "ARE GIVEN"), []), (BSD.replace(BINARY, ""), []),
    (BSD.replace("THIS SOFTWARE IS", "4. Products derived from this software may not be called Apache. THIS SOFTWARE IS"), []),
    (ISC.replace(", provided that the\nabove copyright notice and this permission notice appear in all copies", ""), []),  # 0BSD
    (APACHE.replace("WITHOUT WARRANTIES", "WITH WARRANTIES"), []),
], ids=range(17))
def test_license_whole_wording(text, found):
    """A licence is found by its whole wording, which covers the text, and not where conditions or disclaimers differ."""
    words = license_scan.words_of(text)
    _, spans = license_scan.scan_words(words, license_scan.compile_templates(), [])
    assert [s[0] for s in spans] == found and (not found or [s[1:] for s in spans] == [(0, len(words))])


def test_automata_against_regex():
    pattern = {"a [b c] d": r"a(?: b c)? d", "a (b|c d) {2} e": r"a (?:b|c d)(?: \S+){0,2} e", "a [b|c] [d] {1} a": r"a(?: b| c)?(?: d)?(?: \S+)? a"}
    rng = np.random.default_rng(2)
    for markup, regex in pattern.items():
        machine = license_scan.Automaton("x", markup)
        for _ in range(500):
            words = [str(w) for w in rng.choice(list("abcde"), 7)]
            ends = [n for n in range(1, 8) if re.fullmatch(regex, " ".join(words[:n]))]
            assert machine.match([w.encode() for w in words], 0) == (ends[-1] if ends else -1)
    with pytest.raises(ValueError):
        license_scan.Automaton("x", "[a] {3}")


# n-gram Jaccard join

def test_jaccard_brute_force(spark):
    want = jaccard_classes(rows("documents", "doc_id, text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard_join"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("key_bits", [40, 5])
def test_jaccard_hub(spark, monkeypatch, key_bits):
    """A large group of edited copies at all distances, with small limits so
    that common signatures, regions, pivots and chunks are all at work; with
    few key bits many sets are alike in them."""
    for name, value in (("KEY_BITS", key_bits), ("PIVOTS", 2), ("SMALL", 4), ("COMMON", 6), ("CHUNK", 16), ("BUCKET_SIGNATURES", 900), ("BATCH_SIGNATURES", 3000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 30))
    texts = []
    for size in (3, 12, 60, 200):
        base = [str(w) for w in rng.choice(words, size)]
        for _ in range(70):
            copy = list(base)
            for k in rng.choice(size, rng.integers(0, max(2, size // 25) + 1)):
                copy[k] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += [f"{passage} {' '.join(rng.choice(words, 20))}" for _ in range(60)] + ["A b", "a  B", "", "\n"]
    order = rng.permutation(len(texts)).tolist()
    data = [(i, texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard_classes(data)


def test_partenum_shares_a_signature():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 4, 7, 20, 90, 400):
        for _ in range(60):
            a = rng.integers(0, 2**63, n).astype("uint64")
            lost = rng.integers(0, n // 4 + 1)
            b = np.concatenate((a[lost:], rng.integers(0, 2**63, rng.integers(0, n // 6 + 1)).astype("uint64")))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            x = {band: (slack, set(s.tolist())) for band, slack, s in jaccard_join.signatures(a)}
            y = {band: (slack, set(s.tolist())) for band, slack, s in jaccard_join.signatures(b)}
            assert any(len(x[k][1] & y[k][1]) > max(x[k][0], y[k][0]) for k in x.keys() & y.keys())


def test_jaccard_edges(spark, odd, none):
    got = [tuple(r) for r in jaccard_join.jaccard_components(odd).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(ODD) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[None][1] is None and by[8] == (1, 8)
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2 and kept.count() == len(ODD)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    classes = Sets()
    for a, b in links:
        classes.join(a, b)
    df = spark.createDataFrame(links + [(None, 3), (5, 5)], "a long, b long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {x: classes.of(x) for p in links if p[0] != p[1] for x in p}
    assert connected_components(df.limit(0)).count() == 0


# mixing

def test_mixing_near_targets(spark, odd, none):
    got = QUERIES["op9_mixing"](spark, SF).toPandas()
    docs = pd.DataFrame(rows("documents", "doc_id, source"), columns=["doc_id", "source"])
    g = got.merge(docs).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), most=("size", "max"))
    assert (got.taken <= 2 * got["size"]).all() and (g.taken <= 2 * g["size"]).all()
    assert g.target.sum() == pytest.approx(1.5 * g["size"].sum()) and (g.target <= 2 * g["size"] + 1e-6).all()
    assert ((g.taken - g.target).abs() <= g.most).mean() >= 0.9
    again = QUERIES["op9_mixing"](spark, SF).toPandas()
    assert rows_of(again) == rows_of(got)
    out = mix_documents(odd).collect()
    assert len(out) == len(ODD) and all(r.taken == 0 for r in out if r.size == 0)
    assert mix_documents(none).count() == 0 and mix_documents(odd.where("size(split(text, ' ')) > 99999")).count() == 0
    mixed = mixed_corpus(odd)
    assert mixed.columns == odd.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit("[^ \\t-\\r]+")))).first()[0] == sum(r.taken for r in out)


# HTML extraction

def test_html_article(spark):
    got = {r.page_id: r for r in QUERIES["op10_html_text"](spark, SF).collect()}
    for i, url, page in rows("pages", "page_id, url, html"):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        text = "\n\n".join(b for b in parts if b)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_html_rules():
    parts = lambda p: html_text.text_blocks(html_text.parse(p), set())
    assert parts(page("<div class='wrap has-sidebar'><nav>n</nav><header>h</header><main><h1>A &amp; B</h1><p>one\n <b>two<br>three</b></p>"
                      "<aside>x</aside><div class='comments'><p>hi</p></div><form>f</form><script>var a='</p>'</script><p>four &#233;</p>"
                      "<p class='ad'>buy</p></main><footer>f</footer></div>")) == ["A & B", "one two three", "four é"]
    assert parts(page("<!-- c --><div id=cookie-notice>c</div><p>only <i>this</i></p><ul><li>a<li>b</ul>")) == ["only this", "a", "b"]
    assert parts("") == [] and parts("plain < text") == ["plain < text"] and parts("<p>a<p>b") == ["a", "b"]
    assert parts(page("<article><p>x</p><article class=comment><p>reader</p></article></article>")) == ["x"]
    assert parts(page("<article><p>&lt;b&gt; a&nbsp;b</p></article>")) == ["<b> a b"]


@pytest.mark.parametrize("markup, text", [
    ("<div>" * 20_000 + "deep" + "</div>" * 20_000, ["deep"]),
    ("<b>" * 20_000 + "deep", ["deep"]),
    ("<div>" * 20_000 + "</section>" * 20_000 + "x", ["x"]),
    ("<a" * 50_000, ["<a" * 50_000]),
    ("<p " + 'a="' * 50_001 + ">x", ["x"]),
    ("<p title=it's>don't</p>z", ["don't", "z"]),
    ("a<!-- <p>b</p>", ["a"]),
    ("<p>q</p>r <b s", ["q", "r <b s"]),
], ids=range(8))
def test_html_broken_markup(markup, text):
    """Any depth and any unclosed mark-up is read, in time linear in its length."""
    root = html_text.parse(markup)
    html_text.hash_subtrees(root)
    assert len(list(html_text.candidates(root))) < len(markup)
    assert html_text.text_blocks(root, set()) == text


@pytest.mark.parametrize("markup, text", [
    ("<html><head><title>T</title><body><article><p>x</p></article>", ["x"]),
    ("<html><head><meta charset=utf-8><script>s</script><link rel=a><p>x</p>", ["x"]),
    ("<head>\n<title>T</title>\n plain <b>x</b>", ["plain x"]),
    ("<head><template><div>t</div></template><style>s</style></head><body>x", ["x"]),
], ids=range(4))
def test_html_head_left_open(markup, text):
    assert html_text.text_blocks(html_text.parse(markup), set()) == text


def test_html_names_of_parts():
    """Class names count as a whole, ids not on headings, prose, sections and inline elements."""
    parts = lambda p: html_text.text_blocks(html_text.parse(p), set())
    kept = ['<h2 id="social-impact">a</h2>', '<section id="related-work"><p>b</p></section>', '<p class="ad-hoc">c</p>', '<h3 id=share>d</h3>',
            '<p><a title="the hidden cost">e</a> <span class="share-price">42</span></p>', '<div id="skip-lists"><p>f</p></div>']
    gone = ['<div class="x ad">1</div>', '<div id="social-share">2</div>', '<p hidden>3</p>', '<p title="a" HIDDEN class=b>4</p>',
            '<div hidden="until-found">5</div>', '<div class="ad_slot">6</div>', '<p id=a hidden>7</p>']
    body = "<p>the text of the article</p>"
    assert parts(page(f"<article>{body}{''.join(kept + gone)}</article>")) == ["the text of the article", "a", "b", "c", "d", "e 42", "f"]
    assert parts(page(f"<main><article class='category-comment' id=reply-to-all>{body}</article><article id=comment-3>z</article></main>")) == ["the text of the article"]
    for wrapper in ('class="has-sidebar"', 'class="sidebar"', "id=widget", "role=dialog"):
        assert parts(page(f"<div class=ad>x</div><div {wrapper}>{body}<div class=promo>y</div></div>")) == ["the text of the article"]


def test_html_wrappers_of_parts():
    """Qualified names count on wrappers, inside an article and out of it."""
    parts = lambda p: html_text.text_blocks(html_text.parse(p), set())
    body = "<h1>Title of it</h1><p>" + "the text of the article " * 6 + "</p>"
    want = parts(page(f"<article>{body}</article>"))
    inside = ['<section id="comments"><p>x</p></section>', '<div class="comment-body">x</div>', '<div class="post-comments">x</div>', '<ul class="related-posts"><li>x</ul>',
              '<div class="google-ad">x</div>', '<div class="advert-300x250">x</div>', '<div class="social-links">x</div>']
    for part in inside:
        assert parts(page(f"<article>{body}{part}</article>")) == want, part
    for name in """site-header main-nav site-footer page-footer left-sidebar sidebar-left post-comments comment-thread user-comments related-articles
                   ads-top site-notice global-navigation footer-links top-bar""".split():
        assert parts(page(f'<div class="{name}">x</div>{body}<div id="{name}"><p>y</p></div>')) == want, name
    long_talk = "<div class=comments>" + "<p>readers write and write</p>" * 40 + "</div>"
    assert parts(page(body + long_talk)) == want
    kept = ['<div class="post-content"><p>k</p></div>', '<div class="article-header"><p>k</p></div>', '<p class="user-comments">k</p>', '<section id="related-posts"><p>k</p></section>']
    for part in kept:
        assert parts(page(f"<article>{body}{part}</article>")) == [*want, "k"], part


def test_html_quotations_stay_outside_articles(spark):
    """Prose that recurs on a host without its neighbour is no template."""
    quote, note = "<p>To be, or not to be, that is the question.</p>", "<p>Sent once a week.</p><div>About this site</div>"
    pages = [("https://a.example/", f"<h1>page {i}</h1><p>own {i}</p>{quote if i % 80 == 3 else ''}<p>more {i}</p>{note}") for i in range(400)]
    pages += [("https://b.example/", f"<p>own {i}</p>{quote}") for i in range(9)]
    got = html_texts(spark, pages)
    line = ["To be, or not to be, that is the question."]
    assert got[:400] == [[f"page {i}", f"own {i}", *(line if i % 80 == 3 else []), f"more {i}"] for i in range(400)]
    assert got[400:] == [[f"own {i}", *line] for i in range(9)]


def test_html_templates(spark):
    """Subtrees that recur on a host go, prose of articles and lone pages stay."""
    strip = "<div><span>Our site</span> <a href='/x'>join us</a></div>"
    data = [(i, f"https://a.example/{i}", page(f"{strip}<div><p>text {i}</p></div>"), "x") for i in range(8)]
    data += [(100 + i, f"https://b.example/{i}", page(f"<article><p>quoted by all</p><p>own {i}</p><section><b>share this</b></section></article>"), "x") for i in range(8)]
    data += [(200 + i, "https://c.example/", page(f"{strip}<p>same page</p>"), "x") for i in range(8)]
    data += [(300, None, None, "x"), (None, "no url", "", "x"), (301, "https://a.example/0", page(f"{strip}<div><p>text 0</p></div>"), "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, hashes string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert [got[i] for i in range(8)] == [f"text {i}" for i in range(8)]
    assert [got[100 + i] for i in range(8)] == [f"quoted by all\n\nown {i}" for i in range(8)]
    assert got[200] == "Our site join us\n\nsame page" and got[300] == "" and got[None] == "" and got[301] == "text 0"
    assert html_text.extract_text(df.limit(0)).count() == 0


def html_texts(spark, pages):
    """Texts of (url, body) pages, in order."""
    df = spark.createDataFrame([(i, u, page(b)) for i, (u, b) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text.split("\n\n") if r.text else [] for r in sorted(html_text.extract_text(df).collect(), key=lambda r: r.page_id)]


def test_html_parts_of_articles_stay(spark):
    """Items and cells go with their list or table only, and copies of one page make no template."""
    list_ = "<ul><li>1 tsp salt</li><li>item {0}</li></ul><table><tr><th>Price</th><td><p>Yes</p></td><td>{0}</td></tr></table>"
    rows_ = "<section><div>1 tsp salt</div><div>{0}</div></section>"
    share = "<div><ul><li>share</li></ul></div>"
    recipe = [("https://a.example/", f"<article><div><p>some longer text that is the body of recipe {i}, and then some more</p>{list_.format(i)}{rows_.format(i)}{share}</div></article>") for i in range(12)]
    plain = [("https://b.example/", f"<p>own text {i}</p>{list_.format(i)}") for i in range(12)]
    body = "<p>the one text</p><ul><li>first</li></ul><table><tr><td>cell</td></tr></table><div>note</div>"
    copies = [("https://c.example/", f"<!-- {i} --><article>{body}<div class=ad>buy {i}</div><p><a href=/{i}>read {i}</a></p></article>") for i in range(12)]
    whole = [("https://d.example/", f"<div class=ad>{i}</div><div>{body}</div><a href=/{i}>next {i}</a>") for i in range(12)]
    got = html_texts(spark, recipe + plain + copies + whole)
    for i in range(12):
        cells = ["1 tsp salt", f"item {i}", "Price", "Yes", f"{i}"]
        assert got[i] == [f"some longer text that is the body of recipe {i}, and then some more", *cells, "1 tsp salt", f"{i}"]
        assert got[12 + i] == [f"own text {i}", *cells]
        assert got[24 + i] == ["the one text", "first", "cell", "note", f"read {i}"]
        assert got[36 + i] == ["the one text", "first", "cell", "note", f"next {i}"]


def test_html_template_on_hosts_of_any_size(spark, monkeypatch):
    """A block on five pages goes, whatever else the host holds; joined by broadcast or by a shuffle."""
    menu = "<div><ul><li>Fish</li><li>Fowl</li></ul></div>"
    pages = [("https://a.example/", f"{menu if i < 5 else ''}<p>own text {i}</p>") for i in range(80)]
    pages += [("https://b.example/", f"{menu if i < 4 else ''}<p>own text {i}</p>") for i in range(20)]
    want = [[f"own text {i}"] for i in range(80)] + [(["Fish", "Fowl"] if i < 4 else []) + [f"own text {i}"] for i in range(20)]
    assert html_texts(spark, pages) == want
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", 0)
    assert html_texts(spark, pages) == want


# pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "mixing", "best_fit_packing"]
    data = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, data[-1], SF).write.parquet(str(tmp_path / name))
        data.append(spark.read.parquet(str(tmp_path / name)))
    given, good, lined, single, mixed, packed = [d.toPandas() for d in data]
    assert all(list(d.columns) == list(given.columns) for d in (good, lined, single, mixed))
    label = dict(rows("labels", "doc_id, quality"))
    assert sum(label[i] == 1 for i in good.doc_id if i in label) >= 0.97 * sum(label[i] == 1 for i in given.doc_id if i in label)
    want = {i: "\n".join(k) for i, _, k, _ in lines_kept(list(zip(good.doc_id, good.text)))}
    assert dict(zip(lined.doc_id, lined.text)) == want and (lined.n_chars == lined.text.str.len()).all()
    classes = jaccard_classes(list(zip(lined.doc_id, lined.text)))
    assert sorted(single.doc_id) == sorted(i for i, (_, c) in classes.items() if i == c)
    assert set(mixed.doc_id) <= set(single.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    size = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in d.text)
    assert size(mixed) == pytest.approx(1.5 * size(single), rel=0.05)
    check_packed(list(packed.itertuples()), list(zip(mixed.doc_id, mixed.text)))


def test_pipeline_odd_rows(spark, odd, none, tmp_path):
    for start, name in ((odd.select("doc_id", "text", "lang", "source", "n_chars", "score", "keep", "place"), "odd"), (none, "none")):
        df = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            df = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert df.columns == start.columns
    assert df.count() == 0


def test_kept_digest(spark):
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert got == {i: hashlib.sha256("\n".join(k).encode()).hexdigest() for i, _, k, _ in lines_kept(rows("documents", "doc_id, text"))}


def test_mixed_rows_that_differ_elsewhere(spark):
    """Equal id, text and source, other columns not: every row has its own turn, in
    any order of the input."""
    rows_ = [(1, "a b c", "s", 10), (1, "a b c", "s", 20), (1, "a b c", "s", 20), (2, "d e", "s", 30), (3, "f", None, 40)]
    got = [sorted(map(tuple, mixed_corpus(spark.createDataFrame(r, "doc_id long, text string, source string, other int")).collect()), key=str)
           for r in (rows_, rows_[::-1])]
    assert got[0] == got[1] and {r[3] for r in got[0]} >= {10, 20}
    taken = mix_documents(spark.createDataFrame(rows_, "doc_id long, text string, source string, other int")).collect()
    assert len(got[0]) == sum(r.passes for r in taken)


def test_conflicting_labels_teach_nothing(spark):
    """The same sample, hence the same model, whatever the order of the labels."""
    docs = spark.createDataFrame([(i, "good plain words " * (i % 7 + 1) if i % 2 else "##|| " * (i % 5 + 1)) for i in range(120)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(120)] + [(i, 1 - i % 2) for i in range(0, 120, 3)]
    models = [quality.train(docs, spark.createDataFrame(ls, "doc_id long, quality int").repartition(n)) for ls, n in ((labels, 1), (labels[::-1], 5))]
    x = np.random.default_rng(2).random((50, len(quality.STATISTICS))) * 5
    assert (models[0].score(x) == models[1].score(x)).all()
