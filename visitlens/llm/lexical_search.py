"""Ranked lexical search by pipelined term partitioning.

* **Index.**  Documents are gathered into blocks of at most ``BLOCK_DOCS``, in each
  by ascending id.  A block has one row with its documents' ids and one row per term
  of the queries with its postings: place in the block, occurrences, document length.
  A bitmap of fixed size keeps other terms out (a few that hash alike are joined away).
* **Owners.**  Terms belong to ``len(OWNERS) + 1`` owners, by the share of documents
  that hold them, rare terms first.
* **Stages.**  Items travel in bundles.  At each owner a cogroup by (block, bundle)
  brings a bundle's sparse accumulators together with that owner's postings, adds
  integer contributions and sends the accumulators on.  The last one keeps each item's
  ``k`` best of the block; a window over those of all blocks gives the result.

An accumulator is dropped between stages only if it cannot reach the k best of its own
block, even with the largest contribution of every term to come; results are exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of a block and items of a bundle (on average): together the size of the
#: accumulators that one task holds.
BLOCK_DOCS = 4096
BUNDLE_ITEMS = 128
#: Upper bounds of the owners' shares of documents; the last owner has the rest.
OWNERS = (0.001, 0.02, 0.2)
#: Bits of the bitmap of query terms: 1 MB.
FILTER_BITS = 23
#: No term contributes more than this times its weight.
MOST = 999_999

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INDEX = "block long, term string, docs long, words long, ids array<long>, places binary, times binary, lengths binary"
_SCORES = "block long, bundle int, cells binary, scores binary"


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, A-Z in lower case."""
    lower = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(_TERM_PATTERN), 0))


def _bitmap(terms: DataFrame) -> bytes:
    place = F.shiftright(F.crc32(F.col("term").cast("binary")), 32 - FILTER_BITS) + 1
    out = np.zeros((1 << FILTER_BITS) // 8, "uint8")
    for r in terms.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["bits"], "uint8")
    return out.tobytes()


class _Wanted(dict):
    """Whether the bitmap has a term, remembered for the last million of them."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        at = zlib.crc32(term) >> (32 - FILTER_BITS)
        self[term] = got = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return got


def _block(block: int, docs: list[tuple]) -> pd.DataFrame:
    """Rows of one block from (id or None, length, [(term, occurrences)])."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    postings: dict[bytes, list[tuple[int, int, int]]] = {}
    for place, (_, length, terms) in enumerate(docs):
        for term, times in terms:
            postings.setdefault(term, []).append((place, times, length))
    rows = [(block, None, len(docs), sum(d[1] for d in docs), [d[0] for d in docs], None, None, None)]
    for term, found in postings.items():
        places, times, lengths = np.array(found, dtype="int32").T
        rows.append((block, term.decode("utf-8", "replace"), len(found), None, None, places.tobytes(), times.tobytes(), lengths.tobytes()))
    return pd.DataFrame(rows, columns=["block", "term", "docs", "words", "ids", "places", "times", "lengths"]).astype({"words": "Int64"})


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of all documents with at least one term, postings for ``terms`` (column
    ``term``) only, in the shared checkpoint folder."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, waiting = _Wanted(bits.value), []
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b["id"].astype("Int64")
            for doc_id, text in zip(ids, b["text"]):
                tokens = _TERM.findall(text.encode("utf-8", "replace").lower())
                if tokens:
                    waiting.append((None if doc_id is pd.NA else int(doc_id), len(tokens), [x for x in Counter(tokens).items() if wanted[x[0]]]))
                if len(waiting) == block_docs:
                    yield _block(block, waiting)
                    waiting, block = [], block + 1
        if waiting:
            yield _block(block, waiting)

    return cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
               .where("text <> ''").mapInPandas(read, _INDEX))


def _stage(n: int, words: int, k: int, last: bool):
    """One owner's work on the accumulators of a bundle in a block.  ``cells``: item
    times ``2**32`` plus place.  ``rest``: what later owners can add at most to item ``who``."""
    def add(key: tuple, came: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cells = [np.frombuffer(c, "int64") for c in came["cells"]]
        cells = np.concatenate(cells) if cells else np.zeros(0, "int64")
        places = [np.frombuffer(p, "int32") for p in own["places"]]
        items = [np.asarray(i) for i in own["items"]]
        rows = 1 + max([int(i.max()) for i in items] + ([int((cells >> 32).max())] if len(cells) else []), default=-1)
        width = 1 + max([int(p[-1]) for p in places] + ([int((cells & 0xFFFFFFFF).max())] if len(cells) else []), default=-1)
        total = np.zeros((rows, width), "int64")
        if len(cells):
            total[cells >> 32, cells & 0xFFFFFFFF] = np.concatenate([np.frombuffer(s, "int64") for s in came["scores"]])
        for at, who, w, t, l in zip(places, items, own["w"], own["times"], own["lengths"]):
            tf, length = np.frombuffer(t, "int32").astype("int64"), np.frombuffer(l, "int32").astype("int64")
            total[np.ix_(who, at)] += w * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * length * n // words)))
        item, place = np.nonzero(total)
        score = total[item, place]
        if last:
            order = np.lexsort((place, -score, item))
            item, place, score = item[order], place[order], score[order]
            nth = np.arange(len(item)) - np.searchsorted(item, item)
            best = nth < k
            return pd.DataFrame({"block": key[0], "bundle": key[1], "item": item[best], "place": place[best], "score": score[best]})
        if len(came) and width >= k:
            rest = np.zeros(rows, "int64")
            who, most = np.asarray(came["who"].iloc[0]), np.asarray(came["rest"].iloc[0])
            rest[who[who < rows]] = most[who < rows]
            least = np.partition(total, width - k, axis=1)[:, width - k]
            may = score + rest[item] >= least[item]
            item, place, score = item[may], place[may], score[may]
        return pd.DataFrame({"block": [key[0]], "bundle": [key[1]], "cells": [((item.astype("int64") << 32) | place).tobytes()], "scores": [score.tobytes()]})

    return add


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_docs: int = BLOCK_DOCS, bundle_items: int = BUNDLE_ITEMS) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    NULL and empty texts have no terms: as documents they are not counted, as items they
    have no result.  Rows that share an item id (NULL too) are one item with all their
    terms; every document row counts and ranks by itself, equal scores by ascending id,
    NULL ids last.  Other columns are ignored; without documents or items no rows."""
    spark = docs.sparkSession
    words = items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(item_text_col))).alias("term")).distinct()
    bundles = max(1, -(-words.select("item_id").distinct().count() // bundle_items))
    numbered = (words.select("item_id").distinct().withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
                .withColumn("item", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1))
    named = cut(numbered)
    asked = cut(words.join(named, words["item_id"].eqNullSafe(named["item_id"])).select("bundle", "item", "term"))
    index = build_index(docs, asked.select("term").distinct(), id_col, text_col, block_docs)

    size = index.where("term IS NULL").agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n, length = size["n"] or 0, size["words"] or 1
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("df"))
    share = F.col("df") / F.lit(max(n, 1))
    weighed = (asked.join(df, "term").withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))))
               .where("w > 0").withColumn("owner", sum((share > b).cast("int") for b in OWNERS)))
    owned = cut(weighed.groupBy("owner", "term", "bundle").agg(F.max("w").alias("w"), F.sort_array(F.collect_list("item")).alias("items")))
    rests = [F.sum(F.when(F.col("owner") > s, F.col("w") * MOST).otherwise(0)).alias(f"r{s}") for s in range(len(OWNERS) + 1)]
    left = cut(weighed.groupBy("bundle", "item").agg(*rests).groupBy("bundle")
               .agg(F.collect_list(F.struct("item", *[f"r{s}" for s in range(len(OWNERS) + 1)])).alias("x")))

    scores = spark.createDataFrame([], _SCORES)
    for s in range(len(OWNERS) + 1):
        last = s == len(OWNERS)
        rest = left.select("bundle", F.col("x.item").alias("who"), F.col(f"x.r{s}").alias("rest"))
        own = (index.where("term IS NOT NULL").select("block", "term", "places", "times", "lengths")
               .join(owned.where(F.col("owner") == s).drop("owner"), "term").drop("term"))
        scores = (scores.join(rest, "bundle").groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle"))
                  .applyInPandas(_stage(n, length, k, last), "block long, bundle int, item int, place int, score long" if last else _SCORES))
    ids = index.where("term IS NULL").select("block", "ids")
    order = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "block", "place")
    best = (scores.join(ids, "block").withColumn("doc_id", F.expr("ids[place]")).drop("ids")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return best.join(named, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
