"""All tables of a page from one scan.

A row is expanded to entries (measure, key, item, amount): one per table it counts
in.  The first aggregation, by (measure, key, item), combines map-side and removes
repeated items; the second, by (measure, key), counts entries, distinct items and
amounts.  The tables of a page are then slices of that one small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.text import non_blank_tokens
from visitlens.session import checkpoint_dir

_ENTRIES = "array<struct<measure: string, key: string, item: string, amount: double>>"


def _entry(name: str, key: Column | None = None, item: Column | None = None, amount: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(F.lit(name).alias("measure"), text(key).alias("key"), text(item).alias("item"),
                    (F.lit(None) if amount is None else amount).cast("double").alias("amount"))


def _if(condition: Column, entries: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), entries).otherwise(F.array()).cast(_ENTRIES)


def rows_where(name: str, condition: Column | None = None, key: str | None = None) -> Column:
    """Rows that fulfil a condition, by ``key`` if given (a NULL key counts nowhere)."""
    condition = F.lit(True) if condition is None else condition
    if key is None:
        return _if(condition, F.array(_entry(name)))
    return _if(condition & F.col(key).isNotNull(), F.array(_entry(name, F.col(key))))


def amount_of(name: str, col: str) -> Column:
    """The sum of a column, NULL as 0."""
    return _if(F.lit(True), F.array(_entry(name, amount=F.coalesce(F.col(col), F.lit(0.0)))))


def tokens_of(name: str, col: str, seps: list[str], condition: Column | None = None) -> Column:
    """Occurrences of each token of a multi-valued cell."""
    found = F.transform(non_blank_tokens(col, seps), lambda t: _entry(name, t))
    return _if(F.lit(True) if condition is None else condition, F.coalesce(found, F.array().cast(_ENTRIES)))


def distinct_of(name: str, col: str, key: str | None = None, seps: list[str] | None = None, condition: Column | None = None) -> Column:
    """Distinct values, or tokens where ``seps`` are given, by ``key`` if given."""
    at = None if key is None else F.col(key)
    if seps:
        found = F.coalesce(F.transform(non_blank_tokens(col, seps), lambda t: _entry(name, at, t)), F.array().cast(_ENTRIES))
    else:
        found = F.when(F.col(col).isNotNull(), F.array(_entry(name, at, F.col(col)))).otherwise(F.array().cast(_ENTRIES))
    condition = F.lit(True) if condition is None else condition
    return _if(condition if key is None else condition & at.isNotNull(), found)


def measure(df: DataFrame, entries: list[Column]) -> DataFrame:
    """(measure, key, n, amount) of all entries, from one scan of ``df``."""
    combined = (df.select(F.explode(F.concat(*entries)).alias("e")).select("e.*")
                .groupBy("measure", "key", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))
    return combined.groupBy("measure", "key").agg(
        F.sum(F.when(F.col("item").isNull(), F.col("n")).otherwise(F.lit(1))).alias("n"), F.sum("amount").alias("amount"))


def measured(df: DataFrame, entries: list[Column]) -> DataFrame:
    """``measure``, computed once for the tables that are cut from it: one row per
    measure and key, in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return measure(df, entries).checkpoint()


def part(table: DataFrame, name: str, key: str = "name", count: str = "cnt") -> DataFrame:
    """One measure's (key, count)."""
    return table.filter(F.col("measure") == name).select(F.col("key").alias(key), F.col("n").alias(count))


def scalars(table: DataFrame, counts: list[str] = (), amounts: list[str] = ()) -> DataFrame:
    """Measures without a key as the columns of one row, 0 where nothing was counted."""
    def at(name: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("measure") == name, F.col(col))), F.lit(0)).alias(name)

    return table.agg(*[at(c, "n") for c in counts], *[at(a, "amount") for a in amounts])
