"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.session import checkpoint_dir

#: Bytes that separate words where words are runs of non-blank characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage,
    so a lost executor costs a re-read and not a recomputation.

    ``batch_rows``: rows that go to a Python worker at a time during this job,
    where rows are texts or long arrays and the default would hold many MB."""
    conf = df.sparkSession.conf
    checkpoint_dir(df.sparkSession)
    before = conf.get(BATCH_ROWS)
    if batch_rows:
        conf.set(BATCH_ROWS, str(batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(BATCH_ROWS, before)


def hex_key(*parts: Column) -> Column:
    """md5 (hex) of the parts as text, ``|``-joined, NULL written as ``~``.
    It orders rows in a way that is random with respect to their content and
    the same in every run."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
