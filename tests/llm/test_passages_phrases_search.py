"""Toxicity, phrase mining and lexical search against brute force and on odd rows.
Their SQL is compared in test_llm.py."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from visitlens.llm import collocations as phrases
from visitlens.llm import lexical_search as lexical
from visitlens.llm import toxicity as tox
from visitlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, score string, passages string, n string, block string, term string, rank string"
EXTRA = ("extra",) * 6
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t.", None), (4, "One two three, one two three! ONE TWO THREE", "en"),
    (5, "one two three\none two\tthree one two three", "en"), (5, "one two three\none two\tthree one two three", "en"),
    (6, "été École été École", "fr"), (None, "one two three; \x1f odd \x00 one two", "en"), (7, "a" * 50_000, "de"),
    (8, "du du du du du. " * 3000, None), (9, "two three one\x0btwo three one", "en"), (None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + EXTRA for r in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# toxicity

def best_segments(x, first=0):
    """Maximal-scoring segments by definition: the best one, then those left and right of it."""
    spans = [(x[i:j].sum(), -i, -j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
    if not spans or max(spans)[0] <= 0:
        return []
    s, i, j = max(spans)
    return best_segments(x[:-i], first) + [(first - i, first - j, s)] + best_segments(x[-j:], first - j)


def test_segments_against_definition():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 12, 25):
        for _ in range(40):
            x = rng.normal(-0.2, 1, n)
            got, want = tox.segments(x), best_segments(x)
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_prior_comes_from_the_longest_prefix():
    m = tox.Model(0.1, {"foul": (30.0, 0.0), "fou": (30.0, 30.0), "fine$": (0.0, 50.0)})
    assert m.odds("FOULish") > m.odds("found") > m.odds("other") > m.odds("fine")
    assert m.odds("other") == pytest.approx(-tox.DRIFT)


def test_gumbel_solves_its_equation():
    bins = Counter({-64: 900, 128: 10, 64: 20})
    lam, k = tox.fit_gumbel(bins, [(2.0, 100), (3.0, 500)])
    assert sum(n * math.exp(lam * b / tox.BINS) for b, n in bins.items()) / bins.total() == pytest.approx(1, abs=1e-6)
    assert k > 0 and tox.fit_gumbel(Counter(), []) == (1.0, 1.0)


def test_more_segments_are_more_evidence():
    m = tox.Model(0.1, {}, lam=1.0, k=0.1)
    assert m.evidence([], 0) == 0 < m.evidence([8.0], 100) < m.evidence([8.0, 8.0], 100) < m.evidence([8.0] * 3, 100)
    assert m.evidence([8.0], 100) > m.evidence([8.0], 10_000)


def test_toxicity_held_out(spark):
    got = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    con = duckdb.connect()
    assert len(got) == con.execute("SELECT count(*) FROM '/root/testdata/sf0.1/documents.parquet'").fetchone()[0]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    labels = [(i, y) for i, y in con.execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall() if got.held_out.get(i)]
    toxic, clean = ([got.predicted[i] for i, y in labels if y == c] for c in (1, 0))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.03


def test_passages_are_spans_of_the_text(spark):
    docs = spark.createDataFrame([(i, ("plain words of no note " * 8) + ("vile scum here " * 2 if i % 2 else "") + "and so on " * 8) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts = docs.selectExpr("doc_id", "concat(text, doc_id) AS text")  # no two alike
    rows = tox.toxicity(texts, tox.train(texts, labels)).collect()
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) for r in rows)
    assert all("scum" in r.text[p.start:p.end] and "note" not in r.text[p.start:p.end] for r in rows for p in r.passages)
    assert all(r.passages for r in rows if r.doc_id % 2)


def test_toxicity_odd_rows(spark, odd, none):
    labels = [(4, 1), (5, 0), (5, 1), (6, 0), (None, 1), (8, None), (3, 0), (2, 0)]
    frames = [spark.createDataFrame(rows, "doc_id long, toxic int") for rows in (labels, labels[::-1])]
    models = [tox.train(odd, f) for f in frames]
    assert models[0] == models[1] and "one$" not in models[0].terms  # document 5 has both labels and is not learnt from
    rows = tox.toxicity(odd, models[0]).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not tox.words_of(r.text)}) == 1
    for model in (tox.train(none, frames[0]), tox.train(odd, frames[0].limit(0)), tox.train(odd, frames[0].where("toxic = 0"))):
        assert len({round(r.score, 9) for r in tox.toxicity(odd, model).collect()}) == 1
    assert tox.toxicity(none, models[0]).count() == 0


# phrase mining

def mined(docs, min_count, max_words=5, top=2000):
    """The contract, literally."""
    f, n = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and c[p[i:j]] == a}
        rows = []
        for p, a in found.items():
            if p not in inside:
                s, cut = min((1000 * a * n[lang] // (c[p[:i]] * c[p[i:]]), i) for i in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), -a, x, r, n[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_count, max_words, top, chars", [(2, 5, 2000, 16_000_000), (2, 3, 4, 40), (3, 2, 2000, 60), (1, 5, 2000, 1000)])
def test_phrases_against_brute_force(odd, min_count, max_words, top, chars):
    got = phrases.collocations(odd, min_count=min_count, max_words=max_words, top=top, block_chars=chars).collect()
    assert sorted(map(tuple, got)) == mined(ODD, min_count, max_words, top)


def test_phrases_of_the_table(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    got = phrases.collocations(spark.read.parquet(f"{SF}/documents.parquet"), min_count=12, block_chars=200_000).collect()
    assert sorted(map(tuple, got)) == mined(docs, 12)


def test_colliding_fingerprints_are_told_apart():
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2, -1], "int32")
    at = np.array([0, 1, 3, 4, 6, 7])
    fp, cnt, place = phrases.entries(np.zeros(6, "uint64"), at, ids, 2)
    assert sorted((tuple(ids[p:p + 2]), c) for p, c in zip(place, cnt)) == [((0, 1), 3), ((1, 2), 2), ((1, 3), 1)]
    assert set(fp) == {0} and len(phrases.entries(np.zeros(0, "uint64"), at[:0], ids, 2)[0]) == 0


def test_fingerprint_is_that_of_the_words_alone():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 50).astype("uint64")
    ids = rng.integers(0, 50, 400)
    ids[300:305] = ids[10:15]
    fp = phrases.Fingerprints(h[ids], phrases._BASE).at(np.arange(396), 5)
    by_hand = [sum(int(h[w]) * pow(phrases._BASE, j, 2**64) for j, w in enumerate(ids[i:i + 5])) % 2**64 for i in range(396)]
    assert fp.tolist() == by_hand and fp[10] == fp[300]


@pytest.mark.parametrize("bits", [3, 9])
def test_collisions_change_no_result(odd, bits):
    got = phrases.collocations(odd, min_count=2, block_chars=40, bits=bits).collect()
    assert sorted(map(tuple, got)) == mined(ODD, 2)


def test_gathered_words_are_freed_at_once():
    """A block's dictionary held itself and stayed in the worker long after its block."""
    import gc
    gathered = phrases._Gathered()
    gathered.add("one two, two three")
    gc.collect()
    gc.disable()
    try:
        assert gathered.row(7, "en")[:3] == (7, "en", 4)
        del gathered
        assert gc.collect() == 0
    finally:
        gc.enable()


@pytest.mark.parametrize("bits", [9, 64])
def test_blocks_and_pointers_go_to_python_in_bounded_parts(spark, odd, monkeypatch, bits):
    """All blocks of a partition went to Python at once, and all pointers of the first
    blocks, which most phrases point to."""
    rows, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", phrases.cut
    before, seen, largest = spark.conf.get(rows), [], []

    def watched(df):
        seen.append((int(spark.conf.get(rows)), int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))))
        return cut(df)

    def follow(blocks, found, real=phrases._follow):
        out = real(blocks, found)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        largest.append("part" in plan.split("FlatMapCoGroupsInPandas")[1].split("]")[0])
        return out
    monkeypatch.setattr(phrases, "cut", watched)
    monkeypatch.setattr(phrases, "_follow", follow)
    monkeypatch.setattr(phrases, "FOLLOWED", 2, raising=False)
    got = phrases.collocations(odd, min_count=2, block_chars=1000, bits=bits).collect()
    assert sorted(map(tuple, got)) == mined(ODD, 2)
    assert [s for s in seen[:4]] == [(1, 2)] * 4 and all(largest)
    assert spark.conf.get(rows) == before


def test_no_phrases(none, odd):
    assert phrases.collocations(none).count() == 0 and phrases.collocations(odd.where("text IS NULL")).count() == 0


# lexical search

def ranked(docs, items, k=10):
    """The contract, literally; documents are (id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        rows = []
        for doc_id, c in counts:
            m = 10 + 90 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(i, r, None if x else d, -s) for r, (s, x, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "one TWO"), (2, "été"), (2, "three école"), (None, "du odd one"), (3, None), (4, ""), (5, "absent"), (6, "one one two three été du a")]


@pytest.mark.parametrize("block_docs, bundle_items, k", [(4096, 128, 10), (2, 1, 3), (3, 2, 1)])
def test_search_against_brute_force(spark, odd, block_docs, bundle_items, k):
    items = spark.createDataFrame([(i, t, "extra", "extra") for i, t in ITEMS], "item_id long, text string, doc_id string, score string")
    got = lexical.search(odd, items, k, block_docs=block_docs, bundle_items=bundle_items).collect()
    assert sorted(map(tuple, got), key=str) == ranked([r[:2] for r in ODD], ITEMS, k)


def test_search_drops_no_candidate_in_small_blocks(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = lexical.search(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), block_docs=37, bundle_items=9).collect()
    assert sorted(map(tuple, got), key=str) == ranked(docs, items)


def test_search_without_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == lexical.search(odd, items.limit(0)).count() == lexical.search(odd, items.where("item_id = 5")).count() == 0
