"""Rewrite multi-valued cells with canonical labels.

Per item: blank -> ``''``; otherwise ``upper(map.get(normalize(item),
normalize(item)))``; items and cases are re-joined with the *bare*
separators, positions and empty items kept; a NULL or blank cell is left
as it is.

The rewrite works on one dictionary of distinct (column, cell), made in one pass
over the table: their distinct items, each with its cell's number and its place, are
normalised and joined with the maps, cells put together again from the labels found, and
the table is read once more to be joined with it.  It needs no row id, gives the same result at every map size, and a
cell that a third of all rows hold is rewritten once; in the join back its partner is
a single row, so a skewed partition can be split.  NULL and blank cells, which have no
partner, are spread by their row's hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.constants import NA_TOKENS, WHITESPACE_CLASS
from visitlens.functions.text import normalize_text, split_literal, strip
from visitlens.session import checkpoint_dir, delete_path, freed_shuffles, scratch_path


def load_canonical_map(df: DataFrame, variant: str = "variante", canonical: str = "canonical_propuesto",
                       order_col: str = "orden") -> DataFrame:
    """A4: reviewed proposals -> (variant, canonical): rows with a NULL or NA
    key or value dropped, both trimmed, the last duplicate key by ``order_col``
    wins (``write_proposals`` numbers the rows; equal numbers: the larger
    canonical).  Without that column there is no order to speak of, so a
    duplicate key takes its largest canonical."""
    order = F.col(order_col) if order_col in df.columns else F.lit(0)

    def cell(c: str) -> Column:
        v = strip(F.col(c).cast("string"))
        return F.when(~F.col(c).cast("string").isin(NA_TOKENS), v)

    d = df.select(cell(variant).alias("variant"), cell(canonical).alias("canonical"), order.alias("__ord"))
    return (d.filter(F.col("variant").isNotNull() & F.col("canonical").isNotNull())
             .groupBy("variant").agg(F.max_by("canonical", F.struct("__ord", "canonical")).alias("canonical")))


def _blank(c: Column) -> Column:
    return c.rlike(f"^{WHITESPACE_CLASS}*\\z")


def _blank_cell(c: Column) -> Column:
    return c.isNull() | _blank(c)


def _splitter(sep: str):
    return lambda part: split_literal(part, sep)


def _relabeller(sep: str, labels: Column):
    return lambda part: F.array_join(F.transform(split_literal(part, sep), lambda x: F.element_at(labels, x)), sep)


def _bound(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: build(v)), 1)


def _nested(column: Column, seps: dict[str, tuple[str, str]], build) -> Column:
    """``build(outer, inner)`` of a cell's own column."""
    out = F
    for c, (outer, inner) in seps.items():
        out = out.when(column == c, build(outer, inner))
    return out


def rewritten_cells(df: DataFrame, mappings: dict[str, DataFrame], seps: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, cell, rewritten) of the distinct non-blank cells of the columns in
    ``mappings``, in the shared checkpoint folder.

    Three jobs, each of which frees its shuffles when it ends: cells are written once
    with a number each; items go to the map with their cell's number and their place, and
    only the labels found come back; cells meet their labels by number.  Items without a
    label are normalised again where the cell is put together."""
    spark = df.sparkSession
    seps = {c: seps[c] for c in mappings}
    cells = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in mappings])).alias("s"))
             .select("s.*").filter(~_blank_cell(F.col("cell"))).distinct())
    own_items = F.array_distinct(F.flatten(_nested(F.col("column"), seps, lambda outer, inner: F.transform(split_literal(F.col("cell"), outer), _splitter(inner)))))
    staged, met = scratch_path(spark, "cells"), scratch_path(spark, "labels")
    checkpoint_dir(spark)
    with freed_shuffles(spark):
        try:
            cells.withColumn("id", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(staged)
            cells = spark.read.schema("column string, cell string, id long").parquet(staged)
            items = cells.select("id", "column", F.posexplode(own_items).alias("place", "item")).filter(~_blank(F.col("item")))
            items = items.select("id", "column", "place", normalize_text("item").alias("key"))
            # a column at a time: its items and its map are both dealt by the text alone
            found = [items.filter(F.col("column") == c).drop("column").join(m.select(F.col("variant").alias("key"), F.upper("canonical").alias("label")), "key", "left")
                     # the second condition is never true and keeps the join an outer one: the map may be broadcast, but not the items
                     .where(F.col("label").isNotNull() | (F.rand() < 0)).select("id", "place", "label") for c, m in mappings.items()]
            reduce(DataFrame.unionByName, found).write.option("compression", "zstd").parquet(met)
            labels = (spark.read.schema("id long, place int, label string").parquet(met)
                      .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "label"))).alias("found")))
            label = lambda x, i: F.when(_blank(x), F.lit("")).otherwise(F.coalesce(F.element_at("found", i), F.upper(normalize_text(x))))
            joined = lambda own: _nested(F.col("column"), seps, lambda outer, inner: F.array_join(
                F.transform(split_literal(F.col("cell"), outer), _relabeller(inner, own)), outer))
            rewritten = _bound(own_items, lambda x: _bound(F.map_from_arrays(x, F.transform(x, label)), joined))
            return cells.join(labels, "id", "left").select("column", "cell", rewritten.alias("rewritten")).checkpoint()
        finally:
            delete_path(spark, staged)
            delete_path(spark, met)


def canonicalize_cells(df: DataFrame, mappings: dict[str, DataFrame], seps: dict[str, tuple[str, str]],
                       out: dict[str, str] | None = None) -> DataFrame:
    """N4 over several columns: each is rewritten with its map (variant, canonical;
    unique on variant) and its (outer, inner) separators, into column ``out[c]`` or
    in place.  NULL and blank cells stay as they are."""
    if not mappings:
        return df
    found = rewritten_cells(df, mappings, {c: seps[c] for c in mappings})
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant"]), F.lit(1024))
    rows = df
    for n, c in enumerate(mappings):
        blank = _blank_cell(F.col(f"`{c}`").cast("string"))
        rows = rows.withColumns({f"__cell{n}": F.when(~blank, F.col(f"`{c}`").cast("string")), f"__spread{n}": F.when(blank, spread).otherwise(-1)})
    for n, c in enumerate(mappings):
        own = found.filter(F.col("column") == c).select(F.col("cell").alias("__key"), F.lit(-1).cast("long").alias("__none"), F.col("rewritten").alias("__new"))
        rows = rows.join(own, (F.col(f"__cell{n}") == F.col("__key")) & (F.col(f"__spread{n}") == F.col("__none")), "left")
        rows = rows.withColumn((out or {}).get(c, c), F.coalesce("__new", F.col(f"`{c}`"))).drop("__key", "__none", "__new", f"__cell{n}", f"__spread{n}")
    return rows


def canonicalize_cell(df: DataFrame, col: str, mapping: DataFrame, outer: str = "||", inner: str = ",",
                      out: str | None = None) -> DataFrame:
    """N4 over one column."""
    return canonicalize_cells(df, {col: mapping}, {col: (outer, inner)}, {col: out or col})
