"""Property tests (hypothesis) of Spark expressions.

Each hypothesis example is a whole list of strings checked in one Spark job.
The alphabet mixes ASCII, Latin-1 letters, combining marks, every Python
whitespace character class member and punctuation that the rules delete.
"""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from visitlens.functions import normalize_text, split_tokens
from visitlens.operators.pareto import pareto_from_ranking

ALPHABET = (list("abcXYZ019 /().-_|,;¡¿!") + list("áéíóúñÑçÇüÜàèÁÉ") + ["́", "̈", "̧"]
            + [" ", "\t", "\n", " ", " ", "　", "\x1c"])
texts = st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=60)


def py_split(cell: str, seps: list[str]) -> list[str]:
    parts = [p.strip() for p in cell.split(seps[0])]
    for sep in seps[1:]:
        parts = [q.strip() for p in parts for q in p.split(sep)]
    return parts


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_normalize_text_properties(spark, values):
    """Output alphabet, no blank at the edges, no accents or case left to
    matter, and nothing more to do after a second pass."""
    df = spark.createDataFrame([(v, v.upper() if v.isascii() else v) for v in values], "s string, u string")
    twice = normalize_text(normalize_text("s"))
    for once, upper, two, three in df.select(normalize_text("s"), normalize_text("u"), twice, normalize_text(twice)).collect():
        assert re.fullmatch(r"[a-z0-9 /().-]*", once) and once == once.strip(" ")
        assert once == upper and two == three


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_split_tokens_matches_model(spark, values):
    seps = ["||", ","]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(split_tokens("s", seps)).collect()]
    assert got == [py_split(v, seps) for v in values]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text(alphabet="abcdef", min_size=1, max_size=4), st.integers(1, 50),
                       min_size=1, max_size=40))
def test_pareto_matches_model(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "name string, cnt bigint")
    got = [(r.rank, r.name, r.pct, r.pct_cum, r.vital) for r in pareto_from_ranking(df).orderBy("rank").collect()]
    kept = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:30]
    total = sum(c for _, c in kept)
    exp, cum10 = [], 0.0
    for i, (n, c) in enumerate(kept, start=1):
        p10 = round(c / total * 100 * 10)  # Python round: half to even
        cum10 += p10
        exp.append((i, n, p10 / 10, cum10 / 10, cum10 <= 800))
    assert got == exp
