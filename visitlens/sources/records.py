"""Records of delimited files, cut by a scan of quote states (A1-A3).

A quoted cell may hold line breaks, so whether a line starts a record depends on
all quotes before it in its file.  Files are nevertheless read in splits:

* A line maps the state before it (inside a quoted cell or not) to the state after
  it; both outcomes are computed from the line alone.  A quote opens a cell only at
  the cell's start, two quotes inside are one, and one that is followed by neither
  the delimiter nor the line's end makes the cell an unquoted one, as for Spark's
  CSV reader.
* Inside a split, a running sum of the swapping lines and the last line with a fixed
  outcome give the state at every line, for both states at the split's start.
* Per file, the splits' own outcomes (one row each) are run through in the same way,
  as are their numbers of lines.  That settles each split's first state.

Lines are written to the checkpoint folder once, as every step needs the same splits
of the files, and shuffled once, by split.  Only records of several lines are grouped;
a record is one row however many lines it has (a quote that is never closed takes the
rest of its file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.session import checkpoint_dir

_SPLIT = ["file", "split"]


def _ends_quoted(line: Column, inside: bool, quote: str, sep: str) -> Column:
    """Whether a quoted cell is open after the line: one regular expression, whose
    possessive loops neither go back nor recurse however long the line is."""
    q, body = f"\\Q{quote}\\E", f"(?:[^\\Q{quote}\\E]++|\\Q{quote * 2}\\E)*+"
    opens = f"(?:\\A|(?<=\\Q{sep}\\E)){q}{body}"
    stray = f"(?<!\\A)(?<!\\Q{sep}\\E){q}"
    outside = f"(?:{opens}{q}|[^{q}]++|{stray})*+{opens}\\z"
    scanned = line.rlike(f"\\A{body}(?:\\z|{q}{outside})" if inside else f"\\A{outside}")
    return F.when(F.contains(line, F.lit(quote)), scanned).otherwise(F.lit(inside))


def _states(swaps: Column, fixed: Column, over) -> tuple[Column, Column]:
    """(fixed outcome, swaps since) of the rows of a window frame: the state after
    them is the last fixed outcome, or else the first state, swapped so often."""
    done = F.coalesce(F.sum(swaps.cast("long")).over(over), F.lit(0))
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("value"), F.col("__done").alias("done"))), ignorenulls=True).over(over)
    return last["value"], done - F.coalesce(last["done"], F.lit(0))


def _after(first: Column, fixed: Column, swaps: Column) -> Column:
    return F.coalesce(fixed, first) != (swaps % 2 == 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files of ``path``: file, split, number (from 1), line."""
    checkpoint_dir(spark)
    meta = F.col("_metadata")
    raw = (spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"),
                                        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
           .checkpoint())
    # the lines of a split are neighbours of one task
    splits = raw.groupBy(*_SPLIT).agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select(*_SPLIT, (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first") + 1).alias("base"))
    return raw.join(base, _SPLIT).select(*_SPLIT, (F.col("at") + F.col("base")).alias("number"), "line")


def cut_records(lines: DataFrame, skip: int = 0, quote: str = '"', sep: str = ",") -> DataFrame:
    """Lines to records: file, number (of the first line), record.  The first ``skip``
    lines of each file are left out, blank records too; a record's line breaks are
    ``\\n`` whatever they were."""
    out = F.when(F.col("number") > skip, _ends_quoted(F.col("line"), False, quote, sep)).otherwise(F.lit(False))
    inside = F.when(F.col("number") > skip, _ends_quoted(F.col("line"), True, quote, sep)).otherwise(F.lit(False))
    here = Window.partitionBy(*_SPLIT).orderBy("number")
    so_far, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    # a line maps (outside, inside) to (o, i): fixed where equal, a swap where turned round
    mapped = lines.withColumns({"o": out, "i": inside}).select(
        *_SPLIT, "number", "line", (F.col("o") & ~F.col("i")).alias("swap"), F.when(F.col("o") == F.col("i"), F.col("o")).alias("fixed"))
    counted = mapped.withColumn("__done", F.sum(F.col("swap").cast("long")).over(so_far))
    value, swaps = _states(F.col("swap"), F.col("fixed"), before)
    run = counted.withColumns({"value": value, "swaps": swaps}).drop("__done")

    def opens(first: bool) -> Column:
        return ~_after(F.lit(first), F.col("value"), F.col("swaps")) & (F.col("number") > skip)

    # one row a split: its own outcome, and where its last record starts under both first states
    tail = run.groupBy(*_SPLIT).agg(
        F.max_by(F.struct("value", "swaps", "swap", "fixed"), "number").alias("t"),
        *[F.max(F.when(opens(s), F.col("number"))).alias(f"last{int(s)}") for s in (False, True)])
    tail = tail.select(*_SPLIT, "last0", "last1", F.coalesce("t.fixed", "t.value").alias("fixed"),
                       F.when(F.col("t.fixed").isNotNull(), 0).otherwise(F.col("t.swaps") + F.col("t.swap").cast("long")).alias("swaps"))
    # a fixed outcome that was swapped afterwards is the other one
    tail = tail.select(*_SPLIT, "last0", "last1", (F.col("fixed") != (F.col("swaps") % 2 == 1)).alias("fixed"),
                       (F.col("fixed").isNull() & (F.col("swaps") % 2 == 1)).alias("swap"))
    in_file = Window.partitionBy("file").orderBy("split")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    value, swaps = _states(F.col("swap"), F.col("fixed"), earlier)
    firsts = (tail.withColumn("__done", F.sum(F.col("swap").cast("long")).over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("first", _after(F.lit(False), value, swaps))
              .withColumn("last", F.when(F.col("first"), F.col("last1")).otherwise(F.col("last0")))
              .select(*_SPLIT, "first", F.last("last", ignorenulls=True).over(earlier).alias("carried")))

    known = run.join(firsts, _SPLIT)
    known = known.withColumn("open", _after(F.col("first"), F.col("value"), F.col("swaps")))
    known = known.withColumn("stays", F.coalesce("fixed", F.col("open") != F.col("swap"))).where(F.col("number") > skip)
    start = F.last(F.when(~F.col("open"), F.col("number")), ignorenulls=True).over(so_far)
    known = known.withColumn("start", F.coalesce(start, F.col("carried")))
    single = ~F.col("open") & ~F.col("stays")
    several = (known.where(~single).groupBy("file", F.col("start").alias("number"))
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("record")))
    return known.where(single).select("file", "number", F.col("line").alias("record")).unionByName(several).where(F.trim("record") != "")
