"""Exact top-k search by inner product over vector-approximation files.

Vectors are dealt into blocks.  A block keeps two files: the approximation,
one small cell number per component, and the exact vectors.  A query scans the
approximation: the ends of a component's cell bound its part of the inner
product, so every vector gets a lower and an upper bound; the k-th best lower
bound rules out most vectors.  The exact vectors of the rest are read in the
order of their upper bounds until the k-th best score so far is above all
bounds still to come.  The best k of all blocks are merged per query.

The queries are a stated set and go against all rows in blocks: a vector block is
grouped with all query blocks (in stripes, if there are many) and looked through one
query block after another.  Both sides are shuffled whatever their size, as copies of
the query blocks, one for each vector block, are far larger than the queries; components
travel as the smallest numbers that hold them, and blocks grow with the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import read_vectors, usable

K = 5
SCALE = 256.0
CELLS = 16
BLOCK_VECTORS = 2048
BLOCK_QUERIES = 512
#: Blocks of that size at most; beyond, blocks are larger, by ``GROWN`` times at most.
FEW_BLOCKS = 64
GROWN = 8
#: Query blocks that a vector block meets in one group.
STRIPE = 256
#: Bounds held at a time.
PAIRS = 2**21
#: Exact vectors read at a time while walking the bounds.
READ = 32


def build_file(values: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(edges, cell numbers): per component ``cells`` cells between quantiles
    of the block, the outer edges at its extremes."""
    edges = np.quantile(values, np.linspace(0, 1, cells + 1), axis=0, method="lower").T.copy()
    number = np.stack([np.clip(np.searchsorted(e[1:-1], v, side="right"), 0, cells - 1) for e, v in zip(edges, values.T)], axis=1)
    return edges, number.astype("uint8")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as the smallest of 16-bit and 32-bit integers and doubles that holds
    all of them; a zero below zero needs doubles."""
    top = np.abs(values).max(initial=0)
    if top >= 2**31 or (np.signbit(values) & (values == 0)).any():
        return values.astype("float64").tobytes()
    return values.astype("int16" if top < 2**15 else "int32").tobytes()


def unpacked(values: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {2: "int16", 4: "int32", 8: "float64"}[len(values) // (rows * dim)]
    return np.frombuffer(values, kind).astype("float64").reshape(rows, dim)


def search_file(queries: np.ndarray, query_ids: np.ndarray, edges: np.ndarray, cells: np.ndarray, exact: np.ndarray,
                ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores) of the k best vectors of a block.

    Ties go to the smaller id (an id of NULL, the largest number, last).  Sums
    are exact while they stay below 2**53; beyond, Python integers take over.
    """
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(exact).max(initial=0)) * exact.shape[1]
    if big >= 2**53:
        whole = np.array([[int(x) for x in v] for v in exact], dtype=object)
        for q in range(len(queries)):
            score = np.array([sum(a * b for a, b in zip(v, map(int, queries[q]))) for v in whole], dtype=object)
            at = [i for i in sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])) if ids[i] != query_ids[q]][:k]
            yield q, np.array(at, int), np.array([min(max(score[i], -2**63), 2**63 - 1) for i in at], dtype="int64")
        return
    column = np.arange(exact.shape[1])
    low, high = edges[column, cells], edges[column, cells.astype(int) + 1]
    step = max(1, PAIRS // max(1, len(ids)))
    for first in range(0, len(queries), step):
        plus, minus = np.maximum(queries[first:first + step], 0), np.minimum(queries[first:first + step], 0)
        upper = plus @ high.T + minus @ low.T
        lower = plus @ low.T + minus @ high.T
        own = query_ids[first:first + step, None] == ids[None, :]
        upper[own], lower[own] = -np.inf, -np.inf
        for q in range(len(upper)):
            found = min(k, int((~own[q]).sum()))
            if not found:
                continue
            bar = np.partition(lower[q], len(ids) - found)[len(ids) - found]
            open_ = np.flatnonzero((upper[q] >= bar) & ~own[q])
            open_ = open_[np.argsort(-upper[q, open_], kind="stable")]
            score = np.zeros(0)
            for at in range(0, len(open_), READ):
                if len(score) >= found and np.partition(score, len(score) - found)[len(score) - found] > upper[q, open_[at]]:
                    break
                score = np.concatenate((score, exact[open_[at:at + READ]] @ queries[first + q]))
            read = open_[:len(score)]
            best = np.lexsort((ids[read], -score))[:found]
            yield first + q, read[best], score[best].astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding", cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query its ``k`` best other rows
    (all, if fewer) by the integer inner product of floor(scale * x).

    ``is_query`` is a condition on ``vec_id``.  A query's own row is every row
    with its id.  Vectors that are NULL, empty or hold a NULL or non-finite
    component take no part; vectors of another length are no candidates.  A
    NULL id is never a query and ranks last among ties.  Repeated rows are
    candidates each; a repeated query row counts once.  Scores beyond 64 bits
    come back as the nearest 64-bit number.  Empty input gives no rows; other
    columns are ignored.
    """
    last = 2**63 - 1
    rows = (read_vectors(vectors, id_col, vector_col).where(usable(F.col("embedding")))
            .select("vec_id", "embedding", F.size("embedding").alias("dim")))
    asked = rows.where(is_query & F.col("vec_id").isNotNull()).distinct()
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_v, n_q = max(1, -(-size["n"] // BLOCK_VECTORS)), max(1, -(-size["q"] // BLOCK_QUERIES))
    n_v = max(min(n_v, FEW_BLOCKS), -(-n_v // GROWN))
    n_s = -(-n_q // STRIPE)

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.floor(np.array(frame["embedding"].tolist(), dtype="float64") * scale)

    def pack_vectors(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        exact = matrix(frame)
        edges, number = build_file(exact, cells)
        ids = frame["vec_id"].astype("Int64").fillna(last).to_numpy("int64")
        return pd.DataFrame([(key[0], key[1], ids.tobytes(), edges.tobytes(), number.tobytes(), packed(exact))],
                            columns=["vb", "dim", "ids", "edges", "cells", "exact"])

    def pack_queries(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], frame["vec_id"].to_numpy("int64").tobytes(), packed(matrix(frame)))],
                            columns=["qb", "q_dim", "q_ids", "queries"])

    place = F.xxhash64("vec_id", "embedding")
    files = (rows.withColumn("vb", F.pmod(place, F.lit(n_v)).cast("int")).groupBy("vb", "dim")
             .applyInPandas(pack_vectors, "vb int, dim int, ids binary, edges binary, cells binary, exact binary"))
    query_blocks = (asked.withColumn("qb", F.pmod(place, F.lit(n_q)).cast("int")).groupBy("qb", "dim")
                    .applyInPandas(pack_queries, "qb int, q_dim int, q_ids binary, queries binary"))
    # few bytes and much work: a task for each group, not for so many bytes
    dealt = n_v * n_s
    asking = (query_blocks.withColumn("q_s", F.col("qb") % n_s).withColumn("q_vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
              .repartition(dealt, "q_vb", "q_dim", "q_s"))
    held = files.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_s - 1)))).repartition(dealt, "vb", "dim", "s")
    met = held.groupBy("vb", "dim", "s").cogroup(asking.groupBy("q_vb", "q_dim", "q_s"))

    def search(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in block.itertuples(index=False) if len(asking) else ():
            ids = np.frombuffer(v.ids, "int64")
            edges, number = np.frombuffer(v.edges).reshape(v.dim, -1), np.frombuffer(v.cells, "uint8").reshape(len(ids), v.dim)
            exact = unpacked(v.exact, len(ids), v.dim)
            for r in asking.itertuples(index=False):
                q_ids = np.frombuffer(r.q_ids, "int64")
                queries = unpacked(r.queries, len(q_ids), v.dim)
                for q, at, score in search_file(queries, q_ids, edges, number, exact, ids, k):
                    which = np.full(len(at), zlib.crc32(queries[q].tobytes()))
                    out.append((np.full(len(at), q_ids[q]), which, ids[at], score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "int64")] * 4
        found = pd.DataFrame(dict(zip(("query_id", "which", "vec_id", "score"), columns)))
        return found.assign(dim=block["dim"].iloc[0] if len(found) else 0)

    found = met.applyInPandas(search, "query_id long, which long, vec_id long, score long, dim int")
    order = Window.partitionBy("query_id", "dim", "which").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != last, F.col("vec_id")).alias("vec_id"), "score"))
