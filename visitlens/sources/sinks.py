"""Table sinks (A5-A9): the sheet's clear / header / append / full refresh,
as table directories written by executors.  Row counts are taken with
``DataFrame.observe`` during the write (no second pass).

A table is replaced by writing beside it and then swapping the folders, so a write
that fails leaves the old table, and a table may be refreshed from itself.  A
*numbered* table keeps the sheet's row order in the column ``_row``; appends go on
from its last number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from visitlens.constants import NO_DATA
from visitlens.session import checkpoint_dir, delete_path, replace_path

#: Number of a row in a numbered table, from 1.
ROW = "_row"


def number_rows(df: DataFrame, after: int = 0) -> DataFrame:
    """``df`` with its rows numbered in their order, from ``after + 1``: counts per
    partition and their prefix sum, no sort and no single task.  The frame is written
    to the checkpoint folder once, so that both steps see the same partitions."""
    checkpoint_dir(df.sparkSession)
    placed = df.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    base = (placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
            .select("__part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + after + 1 - F.col("first")).alias("__base")))
    numbered = placed.withColumn("__part", part).join(F.broadcast(base), "__part")
    return numbered.withColumn(ROW, F.col("__at") + F.col("__base")).select(ROW, *df.columns)


def _write(df: DataFrame, path: str, mode: str, fmt: str = "parquet",
           partition_by: list[str] | None = None) -> int:
    obs = Observation()
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(obs.get["rows"])


def _replace(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None = None) -> int:
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:12]}"
    try:
        rows = _write(df, beside, "errorifexists", fmt, partition_by)
        replace_path(spark, beside, path)
    finally:
        delete_path(spark, beside)  # gone already unless something failed
    return rows


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None) -> dict[str, int]:
    """A5: several named outputs in one export: ``<path>/<name>`` each."""
    return {name: _replace(df, f"{path.rstrip('/')}/{name}", fmt, partition_by) for name, df in tables.items()}


def refresh_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                  numbered: bool = False) -> int:
    """Replace header and all rows; returns rows written.  ``partition_by``
    (e.g. ``["region"]``) lays the table out by that column, so readers that
    filter on it prune whole directories.  ``numbered``: keep the rows' order."""
    return _replace(number_rows(df) if numbered else df, path, fmt, partition_by)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Append a positional batch after the existing rows.  Columns are aligned
    by position to the target's header (``_row`` left out); in a numbered table the
    batch goes on from its last row.  An empty batch is a no-op."""
    spark = df.sparkSession
    table = spark.read.format(fmt).load(path)
    target = [f for f in table.schema.fields if f.name != ROW]
    if len(df.columns) != len(target):
        raise ValueError(f"batch has {len(df.columns)} columns, table has {len(target)}")
    # positional: the i-th batch column fills the i-th header, cast to its type
    aligned = df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target)])
    if ROW in table.columns:
        aligned = number_rows(aligned, table.agg(F.max(ROW)).first()[0] or 0).select(*table.columns)
    return _write(aligned, path, "append", fmt)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of a table, those of a numbered one in order and without ``_row``."""
    table = spark.read.format(fmt).load(path)
    return table.orderBy(ROW).drop(ROW) if ROW in table.columns else table


def init_table(spark: SparkSession, columns: list[str], path: str, fmt: str = "parquet", numbered: bool = False) -> int:
    """Empty the table and set its header (all STRING columns)."""
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return refresh_table(spark.createDataFrame([], schema), path, fmt, numbered=numbered)


def clear_table(spark: SparkSession, path: str, fmt: str = "parquet") -> int:
    """Remove every row, keep the header."""
    schema = spark.read.format(fmt).load(path).schema
    return _replace(spark.createDataFrame([], schema), path, fmt)


def table_info(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Rows (header excluded) and the first cell of the first data row, or
    ``sin datos`` (an empty first cell counts as none).  The order is that of a
    numbered table's rows, or else of ``order_col``."""
    order_col = order_col or (ROW if ROW in df.columns else None)
    if order_col is None:
        raise ValueError("the table is not numbered: name a column that orders its rows")
    first_col = [c for c in df.columns if c != order_col][0]
    first = F.min_by(F.col(first_col).cast("string"), F.col(order_col))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.nullif(first, F.lit("")), F.lit(NO_DATA)).alias("updated"))
