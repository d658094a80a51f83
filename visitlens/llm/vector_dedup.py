"""Embedding near-duplicates by collision counting over projections.

Each vector, scaled to length one, is projected on many random directions.
Two unit vectors with the threshold's cosine are a known distance d apart, so
their projections differ like a normal variate with deviation d: a window of
half-width d around a query's projection holds a partner's with probability
0.68, whatever the direction.  The number of projections in which a pair
collides is binomial; the count a pair has to reach is calibrated so that a
pair at the threshold is missed with probability below ``MISS``.

Equal vectors are first collapsed.  The others are range-partitioned and
sorted by (label, first projection) and cut into blocks; two blocks of a label
meet only if their ranges of projections overlap, to within the window, in as
many projections as the count asks for.  Where two blocks meet, every vector
of one is a query: its windows are cut from the other block's sorted
projections and the collisions of each pair are counted.  Pairs that reach the
count are verified by their cosine in double precision.

A meeting of blocks sends on the number of links of every vector and a
spanning forest of the links, so what it returns is linear in the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .vectors import read_vectors, usable

COSINE = 0.93
PROJECTIONS = 64
#: Most often that a pair at the threshold may miss the count.
MISS = 1e-4
BLOCK = 1024
SEED = 20


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def window(cosine: float) -> float:
    """Half-width: the distance of unit vectors at the threshold."""
    return math.sqrt(2 - 2 * cosine)


def needed_count(projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold reaches with probability
    1 - ``miss``; closer pairs collide more often."""
    p = math.erf(1 / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def collisions(mine: np.ndarray, theirs: np.ndarray, width: float) -> np.ndarray:
    """Per pair, in how many projections (columns) ``theirs`` lies in the
    window around ``mine``."""
    count = np.zeros((len(mine), len(theirs)), "uint8" if mine.shape[1] < 256 else "uint16")
    rank = np.empty(len(theirs), "int16" if len(theirs) < 2**15 else "int32")
    for m in range(mine.shape[1]):
        order = np.argsort(theirs[:, m], kind="stable")
        line = theirs[order, m]
        rank[order] = np.arange(len(line))
        lo = np.searchsorted(line, mine[:, m] - width, "left").astype(rank.dtype)
        hi = np.searchsorted(line, mine[:, m] + width, "right").astype(rank.dtype)
        count += (rank >= lo[:, None]) & (rank < hi[:, None])
    return count


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links that span the components of n vertices."""
    root, keep = list(range(n)), []
    # breadth before depth does not matter: any spanning set will do
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, int)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", projections: int = PROJECTIONS, miss: float = MISS) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows are linked when their labels are equal and not NULL and the cosine is
    at least ``cosine``.  Vectors that are NULL, empty, zero or hold a NULL or
    non-finite component, and rows without an id, link with nothing; vectors
    of different lengths neither.  Repeated rows are linked like any two rows,
    and rows that share an id share its links.  ``kept`` marks the smallest id of a
    component (false for a NULL id).  Empty input gives no rows; other columns
    are ignored.
    """
    width, need = window(cosine), needed_count(projections, miss)
    rows = read_vectors(vectors, id_col, vector_col, F.col(label_col).alias("label"))
    some = F.exists("embedding", lambda x: x != 0)
    live = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.coalesce(some, F.lit(False))
    rows = rows.select("vec_id", "label", "embedding", live.alias("live"), F.xxhash64("label", "embedding").alias("g1"),
                       F.xxhash64("embedding", F.lit(1), "label").alias("g2"))
    groups = rows.where("live").groupBy("g1", "g2").agg(F.min("vec_id").alias("node"), F.count("*").cast("long").alias("times"))
    grouped = cut(rows.where("live").join(groups, ["g1", "g2"]).select("vec_id", "node", "times", "label", "embedding", "g1", "g2"))
    single = grouped.where("vec_id = node").dropDuplicates(["g1", "g2"]).select("label", "node", "times", "embedding")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["label", "node", "times", "embedding"]].copy()
            first = []
            for v in b["embedding"]:
                v = np.asarray(v, dtype="float64") / np.abs(v).max()
                first.append(float(directions(len(v), projections)[:, 0] @ (v / np.linalg.norm(v))))
            out["at"], out["dim"] = first, [len(v) for v in b["embedding"]]
            yield out

    kind = dict(single.dtypes)["label"]
    sorted_ = (single.mapInPandas(project, f"label {kind}, node long, times long, embedding array<double>, at double, dim int")
               .repartitionByRange("label", "dim", "at").sortWithinPartitions("label", "dim", "at"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            while len(rest):
                head = rest[(rest["label"] == rest["label"].iloc[0]) & (rest["dim"] == rest["dim"].iloc[0])]
                if len(head) == len(rest) and len(rest) < BLOCK:
                    break  # the next batch may go on
                yield block(head.iloc[:BLOCK])
                rest = rest.iloc[min(len(head), BLOCK):]
        if rest is not None and len(rest):
            yield block(rest)

    def block(rows_: pd.DataFrame) -> pd.DataFrame:
        values = np.array(rows_["embedding"].tolist(), dtype="float64")
        values /= np.abs(values).max(axis=1, keepdims=True)  # no square overflows or vanishes
        p = (values / np.linalg.norm(values, axis=1, keepdims=True)) @ directions(values.shape[1], projections)
        return pd.DataFrame([(rows_["label"].iloc[0], int(values.shape[1]), int(rows_["node"].min()), p.min(axis=0), p.max(axis=0),
                              rows_["node"].to_numpy("int64").tobytes(), rows_["times"].to_numpy("int64").tobytes(), values.tobytes(), p.tobytes())],
                            columns=["label", "dim", "block", "low", "high", "nodes", "times", "data", "lines"])

    blocks = cut(sorted_.mapInPandas(pack, f"label {kind}, dim int, block long, low array<double>, high array<double>, "
                                           "nodes binary, times binary, data binary, lines binary"))
    card = blocks.select("label", "dim", "block", "low", "high")
    other = card.select("label", "dim", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    overlap = F.expr(f"""aggregate(sequence(0, {projections - 1}), 0, (n, i) -> n + if(
        low2[i] <= high[i] + {width!r}D and low[i] <= high2[i] + {width!r}D, 1, 0))""")
    meetings = card.join(other, ["label", "dim"]).where("block <= block2").where(overlap >= need).select("block", "block2")
    body = blocks.select("block", "dim", "nodes", "times", "data", "lines")
    body2 = blocks.select(F.col("block").alias("block2"), F.col("nodes").alias("nodes2"), F.col("times").alias("times2"),
                          F.col("data").alias("data2"), F.col("lines").alias("lines2"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = np.frombuffer(r.data).reshape(-1, r.dim), np.frombuffer(r.data2).reshape(-1, r.dim)
                id_x, id_y = np.frombuffer(r.nodes, "int64"), np.frombuffer(r.nodes2, "int64")
                count = collisions(np.frombuffer(r.lines).reshape(len(x), -1), np.frombuffer(r.lines2).reshape(len(y), -1), width)
                same = r.block == r.block2
                i, j = np.nonzero(np.triu(count >= need, 1) if same else count >= need)
                length_x, length_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                cos = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]]) for k in range(0, max(1, len(i)), 65536)])
                near = cos / (length_x[i] * length_y[j]) >= cosine
                i, j = i[near], j[near]
                times_x, times_y = np.frombuffer(r.times, "int64"), np.frombuffer(r.times2, "int64")
                deg_x = np.bincount(i, times_y[j], len(x)).astype("int64")
                deg_y = np.bincount(j, times_x[i], len(y)).astype("int64")
                keep = forest(len(x) + len(y), i, j + (0 if same else len(x)))
                yield pd.DataFrame({"a": np.concatenate((id_x[deg_x > 0], id_y[deg_y > 0], id_x[i[keep]])),
                                    "b": pd.array(np.concatenate((np.zeros((deg_x > 0).sum() + (deg_y > 0).sum(), "int64"), id_y[j[keep]])), dtype="Int64"),
                                    "links": np.concatenate((deg_x[deg_x > 0], deg_y[deg_y > 0], np.zeros(len(keep), "int64")))})

    found = cut(meetings.join(body, "block").join(body2, "block2")
                .select("block", "block2", "dim", "nodes", "times", "data", "lines", "nodes2", "times2", "data2", "lines2")
                .mapInPandas(compare, "a long, b long, links long"))
    degrees = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("links = 0"), "a", "b")
    # an id with several vectors stands in several groups
    linked = (grouped.select("vec_id", "node", "times").join(degrees, "node", "left").join(classes, "node", "left")
              .groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
                                     F.min(F.coalesce("component", "node")).alias("component")))
    return (rows.select("vec_id").join(linked, "vec_id", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept")))
