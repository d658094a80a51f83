"""Similarity join, clustering and canonicalisation: properties and brute force."""

import random


from visitlens.functions.similarity import lcs_length
from visitlens.operators.canonicalize import canonicalize_cell, load_canonical_map
from visitlens.operators.similarity_join import candidate_pairs, cluster, segment_pairs, similar_keys
from visitlens.plans.normalizer import phase1_proposals, phase2_apply
from visitlens.testing.adapter import plan_raw
from visitlens.operators.cells import atomic_values

T = 88


def ts_py(v):
    import re
    return " ".join(sorted(re.sub(r"[^\w]|_", " ", v.lower()).split()))


def brute_pairs(keys):
    out = set()
    ks = sorted(set(keys))
    for i, a in enumerate(ks):
        for b in ks[i + 1:]:
            if not a or not b:
                continue
            if 200 * lcs_length(a, b) >= T * (len(a) + len(b)):
                out.add((min(a, b), max(a, b)))
    return out


def blocked_pairs(spark, keys):
    df = spark.createDataFrame([(k, len(k)) for k in set(keys)], "ts string, n int")
    return {(min(r.ts_a, r.ts_b), max(r.ts_a, r.ts_b)) for r in similar_keys(df, T).collect()}


def test_blocked_equals_brute_force_random(spark):
    rnd = random.Random(7)
    base = ["operador maquina", "auxiliar bodega", "soldador", "pintor", "a", "b", "xy", "abc"]
    keys = set(base)
    for _ in range(250):
        w = rnd.choice(base)
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            op = rnd.random()
            if op < 0.4 and w:
                del w[rnd.randrange(len(w))]
            elif op < 0.8:
                w.insert(rnd.randrange(len(w) + 1), rnd.choice("abcdeo "))
            elif w:
                w[rnd.randrange(len(w))] = rnd.choice("xyz")
        keys.add(ts_py("".join(w)))
    keys.discard("")
    assert blocked_pairs(spark, keys) == brute_pairs(keys)


def test_blocked_equals_brute_force_fixture(spark):
    raw = plan_raw(spark, "/root/testdata/sf0.01", dirty_tasks=True)
    vals = [r.value for r in atomic_values(raw, "tareas", "||", ",").collect()]
    keys = {ts_py(v) for v in vals}
    assert len(vals) <= 300
    assert blocked_pairs(spark, keys) == brute_pairs(keys)


def test_cluster_properties(spark):
    vocab = ["soldador", "soldadores", "operador maquina", "maquina operador", "auxiliar bodega",
             "auxiliar de bodega", "pintor", "()", "a"]
    df = spark.createDataFrame([(v,) for v in vocab], "value string")
    c = cluster(df, "value", T)
    canon = {r.canonical for r in c["canonicals"].collect()}
    props = c["proposals"].collect()
    assert len(vocab) - len(canon) == len(props)  # variants = values - clusters
    for p in props:
        assert p.canonical in canon and p.variant not in canon and p.similarity >= T
    got = {p.variant: p.canonical for p in props}
    assert got["soldador"] == "soldadores"
    assert got["maquina operador"] == "operador maquina"
    assert "auxiliar bodega" in got and got["auxiliar bodega"] == "auxiliar de bodega"
    assert "()" in canon and "pintor" in canon  # empty token-sort key matches only itself


def test_canonicalize_cells(spark):
    """Repeated and NULL ids, NULL and blank cells; the result does not depend
    on the size of the map."""
    cells = [(1, "a, ,B"), (2, None), (3, "  "), (4, "X  Y || b,,c"), (5, "||"), (1, "a,b"), (1, "c,b"), (None, "b,d"), (None, "b,d")]
    want = ["A,,BETA", None, "  ", "XY||BETA,,C", "||", "A,BETA", "C,BETA", "BETA,D", "BETA,D"]
    df = spark.createDataFrame(cells, "id int, cell string")
    few = spark.createDataFrame([("b", "beta"), ("x y", "xy")], "variant string, canonical string")
    many = few.unionByName(spark.range(25_000).selectExpr("'other ' || id AS variant", "'o' || id AS canonical"))
    for m in (few, many):
        got = canonicalize_cell(df, "cell", m, out="new").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(*c, w) for c, w in zip(cells, want)]))
    assert canonicalize_cell(df.limit(0), "cell", few).count() == 0


def test_load_canonical_map_last_wins(spark):
    df = spark.createDataFrame([(" a ", " A1 ", 1), (None, "z", 2), ("b", None, 3), ("a", "A2", 4)],
                               "variante string, canonical_propuesto string, o int")
    got = {r.variant: r.canonical for r in load_canonical_map(df, order_col="o").collect()}
    assert got == {"a": "A2"}


def test_phase2_reference_separators_pin(spark):
    raw = spark.createDataFrame([("1", "Soldadores | Pintor || Pintor", "soldar, Pintár")],
                                "id string, ocupaciones string, tareas string")
    props = phase1_proposals(raw)
    out = phase2_apply(raw, props).collect()[0]
    # Q9: phase 2 splits occupations by "||" only, so "A | B" is one item
    assert out.ocupaciones == "SOLDADORES  PINTOR||PINTOR"
    assert out.tareas == "SOLDAR,PINTAR"


def test_blocked_equals_brute_force_long_labels(spark):
    rnd = random.Random(11)
    words = ["operador", "maquina", "auxiliar", "bodega", "soldador", "pintor", "carga", "manual",
             "de", "la", "grua", "horquilla"]
    keys = set()
    for _ in range(220):
        w = list(" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 7))))
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                del w[i]
            else:
                w.insert(i, rnd.choice("aeiou rs"))
        keys.add(ts_py("".join(w)))
    keys.discard("")
    assert max(len(k) for k in keys) > 40
    assert blocked_pairs(spark, keys) == brute_pairs(keys)


def test_few_pairs_leave_the_join(spark):
    """Keys meet over whole segments in place; what leaves the join stays near
    what matches, however many labels there are."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefghijklmnoprstuv") for _ in range(rnd.randint(4, 9))) for _ in range(600)})
    labels = [" ".join(sorted(rnd.sample(words, rnd.randint(2, 4)))) for _ in range(8000)]
    for n in (1000, 8000):
        keys = sorted(set(labels[:n]))
        df = spark.createDataFrame([(k, len(k)) for k in keys], "ts string, n int").repartition(4)
        assert segment_pairs(df, T).count() <= 0.005 * len(keys) ** 2 / 2
        assert candidate_pairs(df, T).count() <= 0.02 * len(keys)


def test_blocked_equals_brute_force_other_thresholds(spark):
    rnd = random.Random(3)
    keys = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 9))).strip() for _ in range(120)} - {""})
    df = spark.createDataFrame([(k, len(k)) for k in keys], "ts string, n int")
    for t in (30, 60, 75, 95):
        want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if 200 * lcs_length(a, b) >= t * (len(a) + len(b))}
        assert {(min(r.ts_a, r.ts_b), max(r.ts_a, r.ts_b)) for r in similar_keys(df, t).collect()} == want


def test_index_grows_to_the_full_result(spark, tmpdir_path):
    import os
    from visitlens.operators.similarity_join import propose
    from visitlens.plans.vocabulary_index import add_labels, proposals, read_index
    rnd = random.Random(9)
    words = ["operador", "maquina", "auxiliar", "bodega", "soldador", "pintor", "carga", "grua"]
    labels = sorted({" ".join(rnd.choice(words) + rnd.choice(["", "", "s", "a"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)} | {"()", "a"})[:170]
    rnd.shuffle(labels)
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "value string")
    path = os.path.join(tmpdir_path, "index")
    assert add_labels(frame(labels[:90]), path) == 90
    assert add_labels(frame(labels[60:130]), path) == 40 and add_labels(frame(labels[:130]), path) == 0
    old = {r.ts for r in read_index(spark, path)["labels"].collect()}
    assert add_labels(frame(labels[130:]), path) == len(labels) - 130
    want = list(map(tuple, propose(frame(labels)).collect()))
    assert want and list(map(tuple, proposals(spark, path).collect())) == want
    last = spark.read.parquet(os.path.join(path, "batch=000002", "pairs")).collect()
    assert last and all(r.ts_a not in old or r.ts_b not in old for r in last)  # never old with old
    assert proposals(spark, os.path.join(tmpdir_path, "none")).count() == 0
