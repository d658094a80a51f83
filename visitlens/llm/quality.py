"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (byte classes, word and line shapes, repetition)
are binned into quantile histograms; depth-limited trees are grown level by
level from gradient and hessian sums per (node, feature, bin).  The fitted
trees are complete binary trees flattened into arrays, so scoring walks all
rows of a batch down a tree with a few numpy gathers per level.

Fitting uses a bounded sample: at most ``max_rows`` labelled rows, those with
the smallest hash.  Scoring and everything else covers all rows.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of the training sample (labelled rows sent to the driver).
MAX_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
MIN_CHILD = 5.0
L2 = 1.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "blank", "newline", "punct", "above_ascii",
    "entropy", "mean_word", "longest_word", "unique_words", "unique_triples", "top_word", "same_as_before",
    "punct_end", "symbols", "bars", "same_lines", "words_per_line", "short_words", "capital_words", "period",
)

_BYTE = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_SYMBOL = np.isin(_BYTE, np.frombuffer(b"#$%&*@^~_=+<>\\{}[]", "uint8"))
_CAPITAL = _UPPER | (_BYTE >= 195)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, all 0 where it has no bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    if not data:
        return out
    codes = np.frombuffer(data, "uint8")
    counts = np.bincount(codes, minlength=256)
    n = len(codes)
    share = counts[counts > 0] / n
    words, lines = data.split(), data.split(b"\n")
    out[0], out[2] = np.log1p(n), np.log1p(len(lines))
    out[3:8] = [counts[m].sum() / n for m in (_UPPER, _LOWER, _DIGIT, _BLANK)] + [counts[10] / n]
    out[8], out[9], out[10] = counts[_PUNCT].sum() / n, counts[128:].sum() / n, -(share * np.log2(share)).sum()
    out[18], out[19] = counts[_SYMBOL].sum() / n, counts[124] / n
    out[20], out[24] = 1 - len(set(lines)) / len(lines), counts[46] / n
    if words:
        w = len(words)
        starts = np.flatnonzero(~_BLANK[codes] & np.concatenate(([True], _BLANK[codes[:-1]])))
        ends = np.flatnonzero(~_BLANK[codes] & np.concatenate((_BLANK[codes[1:]], [True])))
        sizes = ends - starts + 1
        out[1], out[11], out[12] = np.log1p(w), sizes.mean(), np.log1p(sizes.max())
        out[13], out[14] = len(set(words)) / w, len(set(zip(words, words[1:], words[2:]))) / max(1, w - 2)
        out[15], out[16] = max(Counter(words).values()) / w, sum(map(operator.eq, words, words[1:])) / w
        out[17] = _PUNCT[codes[ends]].mean()
        out[21], out[22], out[23] = w / len(lines), (sizes <= 3).mean(), _CAPITAL[codes[starts]].mean()
    return out


def statistics_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts]).reshape(-1, len(STATISTICS))


@dataclass
class FlatTrees:
    """``feature``/``threshold``: (trees, inner nodes) in heap order, a row goes
    right where its value is above the threshold; ``leaf``: (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), "int64")
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE, min_child: float = MIN_CHILD, l2: float = L2) -> FlatTrees:
    """Logistic boosting on binned features.  Without rows the score is 0.5;
    with one class it is that class's smoothed share."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, k), int)
    raw = np.full(n, base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, "int64"), np.full(inner, np.inf)
        node = np.zeros(n, "int64")  # heap order
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = (node - first) * bins
            best = [(0.0, 0, np.inf)] * width
            for j in range(k):
                at = place + binned[:, j]
                gs = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                # a child needs min_child / 4 of hessian: as many undecided rows as min_child
                gain[(hs < min_child / 4) | (ht - hs < min_child / 4)] = 0
                cut = gain[:, :len(edges[j])]
                if cut.shape[1]:
                    b = cut.argmax(axis=1)
                    for i in range(width):
                        if cut[i, b[i]] > best[i][0] + 1e-12:
                            best[i] = (float(cut[i, b[i]]), j, float(edges[j][b[i]]))
            for i, (_, j, t) in enumerate(best):
                feature[first + i], threshold[first + i] = j, t
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        raw += leaf[at]
        out.append((feature, threshold, leaf))
    if not out:
        return FlatTrees(base if n else 0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    return FlatTrees(base, *(np.array(a) for a in zip(*out)))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is
    divisible by 5.  A NULL id counts as the empty text (held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS, **params) -> FlatTrees:
    """Fit on labelled rows that are not held out.

    At most ``max_rows`` of them, by hash of the id; NULL ids and labels are
    left out, ids that have both labels too, a repeated label row counts once.  The sample's ids are broadcast
    (bounded by ``max_rows``), their texts' statistics come to the driver.
    """
    sample = (labels.select(F.col(id_col).cast("long").alias("s_id"), F.col(label_col).cast("int").alias("s_label"))
              .where(F.col("s_label").isin(0, 1) & ~held_out(F.col("s_id")))
              .groupBy("s_id").agg(F.min("s_label").alias("s_label"), F.max("s_label").alias("s_other"))
              .where(F.col("s_label") == F.col("s_other")).drop("s_other")
              .orderBy(F.xxhash64("s_id"), "s_id").limit(max_rows))
    rows = (docs.select(F.col(id_col).cast("long").alias("s_id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(sample), "s_id"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s_id": b["s_id"], "s_label": b["s_label"], "x": list(statistics_of(b["text"]))})

    got = (rows.mapInPandas(measure, "s_id long, s_label int, x array<double>")
           .orderBy("s_id", F.xxhash64("x"), "s_label").limit(max_rows).toPandas())
    x = np.array(got["x"].tolist(), dtype="float64").reshape(-1, len(STATISTICS))
    return fit_trees(x, got["s_label"].to_numpy("float64"), **params)


def quality_score(text: Column, model: FlatTrees) -> Column:
    """Score of a text column, 0 to 1 (higher: label 1 likelier).  NULL and
    empty texts have the statistics 0 and a score like any other."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics_of(texts)))

    return score(text.cast("string"))


def classify(docs: DataFrame, model: FlatTrees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of its text; a column of that name is replaced.
    Row for row: repeated rows get equal scores, empty input gives no rows."""
    return docs.withColumn(score_col, quality_score(F.col(text_col), model))
