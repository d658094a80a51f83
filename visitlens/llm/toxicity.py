"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

* **Token log-odds.**  In how many toxic and clean labelled texts a word occurs
  gives its log-odds.  The Dirichlet prior of a word is what its longest known
  prefix says, that one's what the next shorter one says, and so on down to the
  share of toxic texts: an unseen compound of a toxic stem scores, an unseen
  word of no such stem is neutral.
* **Segments.**  ``drift`` is taken off every word, so that neutral words cost.
  The linear scan of Ruzzo and Tompa then finds all maximal-scoring segments.
* **Extreme values.**  Scores of segments of chance follow the Gumbel law with
  parameters ``lam`` and ``k`` (Karlin and Altschul); a segment of score s in a
  text of n words is expected ``k n exp(-lam s)`` times.  The segments of a text
  are joined by their sum statistic; a logistic curve turns it into a score.

Token counts and calibration come from at most ``max_rows`` labelled rows, those
with the smallest hash; a text that several of them share counts once.  The curve
is fitted on scores that each half of the sample gets from the other half's counts.
Scoring covers all rows.  A NULL or empty text has no words and gets the curve's
score of no evidence; without labels, or with those of one class, all texts get
that class's smoothed share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Documented bounds of what the driver sees: labelled rows, and words and
#: prefixes of them (those in the most texts; the others take their prefix's odds).
MAX_ROWS = 20_000
MAX_TERMS = 200_000
#: Strength of the prior, in texts.
PRIOR = 6.0
#: Cost of a word without evidence.
DRIFT = 1.0
PREFIXES = range(2, 11)
#: Bins a unit of score in the histogram of words.
BINS = 64
#: A passage is reported when fewer than this many of its score are expected by chance.
MAX_EXPECTED = 0.05

_WORD = re.compile(r"[^\W_]+")
_EULER = 0.5772156649015329


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if isinstance(text, str) else []


def chain(word: str) -> list[str]:
    """The prefixes of a word and, marked, the word itself, shortest first."""
    return [word[:k] for k in PREFIXES if k <= len(word)] + [word + "$"]


@dataclass
class Model:
    """``terms``: prefix or marked word -> (toxic, clean) texts holding it."""

    share: float = 0.5
    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def odds(self, word: str) -> float:
        """Log-odds of a word over those of all texts, less the drift."""
        got = self._seen.get(word)
        if got is None:
            p = self.share
            for term in chain(word.lower()):
                if term in self.terms:
                    toxic, clean = self.terms[term]
                    p = (toxic + PRIOR * p) / (toxic + clean + PRIOR)
            p = min(max(p, 1e-6), 1 - 1e-6)
            got = float(np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))) - DRIFT
            if len(self._seen) > 1_000_000:
                self._seen.clear()
            self._seen[word] = got
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        return np.array([self.odds(w) for w in words])

    def expected(self, score: float, n: int) -> float:
        return self.k * n * float(np.exp(-self.lam * score))

    def evidence(self, scores: list[float], n: int) -> float:
        """-log P of the segments of a text of n words, 0 without any: the least of
        P over the r best segments, r halving the weight each time (so that trying
        several r costs), by the sum statistic P = exp(-t) t^(r-1) / (r! (r-1)!)."""
        best, total, log_f = 0.0, 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            above = self.lam * s - np.log(self.k * max(n, 1))
            if above <= 0:
                break
            total += above
            log_f += np.log(r) + (np.log(r - 1) if r > 1 else 0.0)
            best = max(best, total - (r - 1) * np.log(total) + log_f - r * np.log(2) if r > 1 else total - np.log(2))
        return float(best)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -40, 40))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), end exclusive, in one scan
    (Ruzzo and Tompa): a segment is maximal when no extension or part scores more.
    Only words of positive score open a segment, the others move the running sum."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with less before
    for i in np.flatnonzero(scores > 0):
        start, end, before, after = int(i), int(i) + 1, float(total[i]), float(total[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            nearest = stack[j][4]
            del stack[j:]
            j = nearest
    return [(s, e, after - before) for s, e, before, after, _ in stack]


def fit_gumbel(bins: Counter, best: list[tuple[float, int]]) -> tuple[float, float]:
    """(lam, k): lam > 0 solves E exp(lam s) = 1 over the words of clean texts (their
    scores' histogram), k is set by the mean of their best segments (score, words)."""
    values = np.array(sorted(bins), dtype="float64") / BINS
    weights = np.array([bins[b] for b in sorted(bins)], dtype="float64")
    if not len(values) or values[-1] <= 0 or np.average(values, weights=weights) >= 0:
        return 1.0, 1.0
    low, high = 0.0, 64.0
    for _ in range(60):
        mid = (low + high) / 2
        below = np.average(np.exp(np.minimum(mid * values, 700)), weights=weights) < 1
        low, high = (mid, high) if below else (low, mid)
    lam = max(high, 1e-6)
    above = [lam * s - np.log(n) for s, n in best if s > 0]
    return lam, float(np.exp(np.mean(above) - _EULER)) if above else 1.0


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (x, y) by Newton steps, lightly ridged; never falling."""
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def calibrate(model: Model, texts: list[tuple[float, int, list[float]]], bins: Counter) -> Model:
    """The model with its Gumbel law and curve, from (toxic share, words, scores of
    segments) of the sample's texts and the histogram of the clean texts' words."""
    lam, k = fit_gumbel(bins, [(max(s, default=0.0), n) for y, n, s in texts if y < 0.5 and n])
    model = replace(model, lam=lam, k=k, _seen={})
    x = np.log1p(np.array([model.evidence(s, n) for _, n, s in texts], dtype="float64"))
    return replace(model, curve=fit_curve(x, np.array([t[0] for t in texts], dtype="float64")), _seen={})


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when
    divided by 4.  A NULL id counts as the empty text (not held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, toxic share) of the labelled rows to learn from.  Ids that have both
    labels are left out, NULL ids and labels too; an id has one text (the smallest of
    its rows'), and equal texts are one row."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("s_id"), F.col(label_col).cast("int").alias("s_label"))
              .where(F.col("s_id").isNotNull() & F.col("s_label").isin(0, 1) & ~held_out(F.col("s_id")))
              .groupBy("s_id").agg(F.min("s_label").alias("s_label"), F.max("s_label").alias("s_max"))
              .where(F.col("s_label") == F.col("s_max")).orderBy(F.xxhash64("s_id"), "s_id").limit(max_rows))
    return (docs.select(F.col(id_col).cast("long").alias("s_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(chosen.select("s_id", "s_label")), "s_id")
            .groupBy("s_id").agg(F.min("text").alias("text"), F.first("s_label").alias("s_label"))
            .groupBy("text").agg(F.avg("s_label").alias("toxic")))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts holding each term, by fold (crc32 of the text) and label."""
    for b in batches:
        seen: dict[str, list[float]] = {}
        for text, toxic in zip(b["text"], b["toxic"]):
            at = 2 * (zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1)
            for term in {t for w in {w.lower() for w in words_of(text)} for t in chain(w)}:
                n = seen.setdefault(term, [0.0] * 4)
                n[at] += toxic
                n[at + 1] += 1 - toxic
        yield pd.DataFrame([(t, *n) for t, n in seen.items()], columns=["term", "t0", "c0", "t1", "c1"])


def _model(share: float, terms: list[str], toxic: np.ndarray, clean: np.ndarray) -> Model:
    known = (toxic >= 2) | (toxic + clean >= 8)
    return Model(share, {terms[i]: (float(toxic[i]), float(clean[i])) for i in np.flatnonzero(known)})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Fit on labelled rows that are not held out."""
    spark = docs.sparkSession
    texts = cut(_sample(docs, labels, id_col, text_col, label_col, max_rows))
    size = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = ((size["toxic"] or 0.0) + 0.5) / (size["n"] + 1)
    got = (texts.mapInPandas(_count, "term string, t0 double, c0 double, t1 double, c1 double")
           .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
           .where("t0 + t1 >= 2 OR t0 + c0 + t1 + c1 >= 8")
           .orderBy(F.expr("t0 + c0 + t1 + c1").desc(), "term").limit(max_terms).toArrow())
    terms = got["term"].to_pylist()
    t0, c0, t1, c1 = (got[c].to_numpy() for c in ("t0", "c0", "t1", "c1"))
    halves = spark.sparkContext.broadcast([_model(share, terms, t1, c1), _model(share, terms, t0, c0)])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins: Counter = Counter()
            rows = []
            for text, toxic in zip(b["text"], b["toxic"]):
                scores = halves.value[zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1].scores(words_of(text))
                rows.append((toxic, len(scores), [s for _, _, s in segments(scores)], []))
                if toxic < 0.5:
                    bins.update(np.rint(scores * BINS).astype(int).tolist())
            rows.append((None, None, [float(v) for v in bins], [float(n) for n in bins.values()]))
            yield pd.DataFrame(rows, columns=["toxic", "n", "s", "counts"]).astype({"n": "Int64"})

    measured, bins = [], Counter()
    for r in texts.mapInPandas(measure, "toxic double, n long, s array<double>, counts array<double>").toArrow().to_pylist():
        if r["toxic"] is None:
            bins.update(dict(zip(map(int, r["s"]), r["counts"])))
        else:
            measured.append((r["toxic"], r["n"], r["s"]))
    return calibrate(_model(share, terms, t0 + t1, c0 + c1), sorted(measured), bins)


_RESULT = "struct<score: double, passages: array<struct<start: int, end: int, score: double, expected: double>>>"


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely toxic) and ``passages``:
    start and end in code points, the score and the number of such passages that
    chance makes in a text of that length, best first.  Columns of those names are
    replaced.  Row for row: repeated rows get equal scores, no rows give none."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        m, scores, passages = known.value, [], []
        for text in texts:
            words = words_of(text)
            found = segments(m.scores(words))
            scores.append(m.score(m.evidence([s for _, _, s in found], len(words))))
            told = sorted((m.expected(s, len(words)), a, b, s) for a, b, s in found)
            told = [t for t in told if t[0] < MAX_EXPECTED]
            spans = [w.span() for w in _WORD.finditer(text)] if told else []
            passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "expected": e} for e, a, b, s in told])
        return pd.DataFrame({"score": scores, "passages": passages})

    return (docs.withColumn("__toxicity", judge(F.col(text_col).cast("string")))
            .withColumns({"score": F.col("__toxicity.score"), "passages": F.col("__toxicity.passages")}).drop("__toxicity"))
