"""Mix sources to target weights by weighted fair queueing.

Each source's documents queue in a shuffled order (a hash of id and text), the
whole queue once per allowed pass.  A document's virtual finish time is its
source's cumulative size up to and with it, divided by the source's target.
All finish times are range-sorted together and served until the total budget
is used up, so at every moment each source has received its share, up to the
document it is serving.

No source is held in one task: cumulative sizes are sums over hash ranges plus
a running sum inside a range, and the running total over the global order is
the same over ranges of the finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_key

#: Weights given in turn to the sources in code point order, NULL last.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
#: Hash ranges of a source and finish-time ranges of a unit of virtual time
#: (the last one, at 64 units, is open).
QUEUE_RANGES = 4096
TIME_RANGES = 8192


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not blank (``[ \\t-\\r]``)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   passes: int = PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    ``share`` of all sizes is split by weight; no target exceeds ``passes``
    times its source's size, the excess goes to the others by weight until
    none is above.  Sources ordered by cap / weight are capped in a prefix:
    the shortest one after which the common level (rest of the budget / rest
    of the weight) is at most the next source's ratio.  The windows run over
    one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.select("source", "source_size")
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                               ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
            .withColumn("cap", (F.col("source_size") * passes).cast("double"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(every) * share)
            .withColumn("all_weight", F.sum("weight").over(every))
            .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
            .withColumn("nth", F.row_number().over(by_ratio))
            # the level that holds is that of the first source not capped
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(every)["level"])
            .select("source", "source_size",
                    F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per document: ``doc_id, place`` (hash of id and text),
    ``source, size, source_size, target, passes, taken, finish`` (virtual
    finish time of its first pass; NULL where its source has no target).

    ``passes`` counts how often the mix serves the document, ``taken`` is
    ``passes * size``.  NULL or empty texts have size 0 and take nothing; a
    source without words has target 0.  A NULL source is a source of its own,
    the last one.  Rows that repeat id and text queue one after another.
    Empty input gives no rows; other columns are ignored.
    """
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
            .select("doc_id", "source", word_count(F.col("text")).alias("size"),
                    hex_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("place"))
            .withColumn("range", F.floor(F.conv(F.substring("place", 1, 6), 16, 10).cast("double") * QUEUE_RANGES / 2**24).cast("int")))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, passes)
    below = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.withColumn("start", F.coalesce(F.sum("range_size").over(below), F.lit(0)))
              .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
              .select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), "start", "source_size", "target"))
    queue = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size")
    queued = (rows.withColumn("nth", F.row_number().over(queue))
              .withColumn("inside", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
              .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
              .withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("inside")) / F.col("target")))
              .select("doc_id", "place", "source", "range", "nth", "size", "source_size", "target", "finish"))

    # one event per document and pass, in the order of the virtual finish time
    step = F.col("source_size") / F.col("target")
    events = (queued.where((F.col("target") > 0) & (F.col("size") > 0))
              .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
              .select("source", "range", "nth", "place", "size", "pass", (F.col("finish") + F.col("pass") * step).alias("at"))
              .withColumn("slice", F.least(F.floor(F.col("at") * TIME_RANGES), F.lit(64 * TIME_RANGES)).cast("long")))
    slices = events.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    budget = targets.agg(F.sum("target").alias("budget")).withColumn("all", F.lit(0))
    # slices that begin within the budget: all of a served prefix of the order
    open_slices = (slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
                   .withColumn("all", F.lit(0)).join(F.broadcast(budget), "all")  # one row
                   .where(F.col("before") <= F.col("budget")))
    in_order = Window.partitionBy("slice").orderBy("at", F.col("source").asc_nulls_last(), "pass", "place", "nth")
    served = (events.repartitionByRange("slice")
              .withColumn("until", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
              .join(open_slices, "slice")
              .where(F.col("before") + F.col("until") <= F.col("budget") + F.lit(1e-6))
              .groupBy("source", "range", "nth").agg(F.count("*").cast("long").alias("served"))
              .select(F.col("source").alias("e_source"), F.col("range").alias("e_range"), F.col("nth").alias("e_nth"), "served"))
    return (queued.join(served, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range"))
                        & (F.col("nth") == F.col("e_nth")), "left")
            .withColumn("passes", F.coalesce("served", F.lit(0)).cast("long"))
            .select("doc_id", "place", "source", "size", "source_size", "target", "passes",
                    (F.col("passes") * F.col("size")).alias("taken"), "finish"))


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 **params) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row once per pass that serves it.
    Rows that repeat id, text and source have places of their own in the queue, in the
    order of their other columns, and each is served by its own passes."""
    place = hex_key(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    queue = Window.partitionBy("m_place", "m_source").orderBy("finish", "passes")
    taken = (mix_documents(docs, id_col, text_col, source_col, **params)
             .select(F.col("place").alias("m_place"), F.col("source").alias("m_source"), "finish", "passes")
             .withColumn("m_nth", F.row_number().over(queue)).where("passes > 0"))
    rest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}))
    own = docs.select(F.struct(*docs.columns).alias("row"), place.alias("place"), F.col(source_col).alias("own_source"), rest.alias("rest"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("place", "own_source").orderBy("rest")))
    return (own.join(taken, (F.col("place") == F.col("m_place")) & F.col("own_source").eqNullSafe(F.col("m_source")) & (F.col("nth") == F.col("m_nth")))
            .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
