"""Hierarchical weighted hash tree: rows to shards by region, rack and shard.

A tree is a list of regions, a region a list of racks, a rack a list of
``(shard number, weight)``.  A row descends level by level.  At each level
every child draws an exponential variate ``-ln(u) / weight`` from a hash of
(row key, child's path) and the smallest draw wins, so a child is chosen with
probability weight / sum of weights, and a child's draw does not depend on its
siblings.  Changing a weight therefore moves rows only into (or out of) the
subtrees that hold it: rows that stay in another region, rack or shard keep
every draw they had.

Growth opens an annex region with one rack and one shard per added shard.
Region draws of the old regions are unchanged, so a row either stays where it
was or goes to the annex, whose only shard is the new one.

All native: built-in expressions, one shuffle of (key, size, checksum) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_key

#: Regions of racks of (shard number, weight).
Tree = list[list[list[tuple[int, float]]]]

BASE_SHARDS = 24
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4
#: Hash ranges per shard in which slots are counted; a range of a shard is the
#: unit of one task's sort, so it bounds memory at rows / (shards * ranges).
SLOT_RANGES = 4096


def tree_for(shards: int, base: int = BASE_SHARDS, racks: int = RACKS_PER_REGION,
             per_rack: int = SHARDS_PER_RACK) -> Tree:
    """The tree of ``shards`` equal shards: the first ``base`` fill regions of
    ``racks`` x ``per_rack``, each further one is an annex region of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    per_region = racks * per_rack
    tree: Tree = []
    for lo in range(0, min(shards, base), per_region):
        numbers = range(lo, min(lo + per_region, shards, base))
        tree.append([[(n, 1.0) for n in numbers[i:i + per_rack]] for i in range(0, len(numbers), per_rack)])
    tree.extend([[(n, 1.0)]] for n in range(base, shards))
    return tree


def _weight(tree) -> float:
    return float(tree[1]) if isinstance(tree, tuple) else sum(_weight(t) for t in tree)


def _children(nodes: list[tuple[str, float]]) -> Column:
    """(path, weight, number) of the children that have weight, as a literal."""
    live = [F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(i).alias("i"))
            for i, (p, w) in enumerate(nodes) if w > 0]
    return F.array(*live) if live else F.lit(None).cast("array<struct<path:string,weight:double,i:int>>")


def _winner(key: Column, children: Column) -> Column:
    """Number of the child with the smallest exponential variate, taken from
    52 bits of an md5 (the first of equal ones)."""
    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), c["path"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / c["weight"]).alias("d"), c["i"].alias("i"))

    return F.array_min(F.transform(children, draw))["i"]


def with_shard(rows: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """``rows`` with the shard number of ``key`` (text) under ``tree``."""
    if _weight(tree) <= 0:
        raise ValueError("the tree has no weight")
    region, rack, leaf = f"__{out}_region", f"__{out}_rack", f"__{out}_leaf"
    regions = _children([(f"r{r}", _weight(racks)) for r, racks in enumerate(tree)])
    racks = F.array(*[_children([(f"r{r}/k{k}", _weight(s)) for k, s in enumerate(ks)]) for r, ks in enumerate(tree)])
    shards = F.array(*[F.array(*[_children([(f"r{r}/k{k}/s{n}", w) for n, w in s]) for k, s in enumerate(ks)])
                       for r, ks in enumerate(tree)])
    numbers = F.array(*[F.array(*[F.array(*[F.lit(n) for n, _ in s]) for s in ks]) for ks in tree])
    return (rows.withColumn(region, _winner(key, regions))
            .withColumn(rack, _winner(key, F.get(racks, F.col(region))))
            .withColumn(leaf, _winner(key, F.get(F.get(shards, F.col(region)), F.col(rack))))
            .withColumn(out, F.get(F.get(F.get(numbers, F.col(region)), F.col(rack)), F.col(leaf)).cast("int"))
            .drop(region, rack, leaf))


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id",
                  text_col: str = "text", ranges: int = SLOT_RANGES) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot,
    grown_shard``.

    ``shard`` depends on the id and the tree alone (a NULL id is the key
    ``~``), so rows of one id share a shard.  ``size`` is the UTF-8 length of
    the text plus 8 (NULL text: 8), ``text_crc32`` its CRC-32 (NULL or empty:
    0).  ``slot`` numbers a shard's rows from 0 without gaps in the order of a
    hash of (id, text); fully equal rows take neighbouring slots.  Empty
    input gives no rows; other input columns are ignored.

    Slots need no shard in one task: rows are dealt by (shard, hash range),
    numbered inside, and shifted by the summed counts of the lower ranges.
    A hot text spreads because the range comes from a hash that holds the id.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"),
                    F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                    F.md5("text").alias("digest")))
    rows = with_shard(rows, key, tree, "shard")
    rows = with_shard(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = (rows.withColumn("place", hex_key(F.col("doc_id"), F.col("digest"))).drop("digest")
            .withColumn("range", F.pmod(F.conv(F.substring("place", 1, 6), 16, 10).cast("long") * ranges / 2**24,
                                        F.lit(ranges)).cast("int")))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    below = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "range").orderBy("place", "doc_id", "size", "text_crc32")
    placed = rows.withColumn("nth", F.row_number().over(inside))
    return (placed.join(starts, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"))
