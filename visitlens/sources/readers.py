"""Scans (A1-A4, A11).  Delimited text is read with every column as STRING
(no inference, so ids never turn into ``123.0``); typing is explicit.

Exports quote cells, double quotes inside them and let a quoted cell hold line
breaks.  Such files are read in splits and cut into records by their quotes
(``sources.records``).  ``multiLine=False`` may be passed for files known to hold
no line break in a cell; Spark's own reader then takes each line as a record.
"""

from __future__ import annotations

import csv
import io
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from visitlens.constants import NA_TOKENS
from visitlens.operators.clean import clean_plan, type_followup
from visitlens.session import checkpoint_dir
from visitlens.sources.records import cut_records, read_lines

CSV_OPTIONS = {"header": "true", "inferSchema": "false", "multiLine": "true", "quote": '"', "escape": '"'}
#: Column of ``malformed_rows``.
RECORD = "record"
#: Different headers that one read may meet: their texts come to the driver.
MAX_HEADERS = 1000


def na_to_null(df: DataFrame) -> DataFrame:
    """Spellings of a missing value -> NULL, in every text column."""
    text = {c for c, t in df.dtypes if t == "string"}

    def cell(c: str) -> Column:
        v = F.col(f"`{c}`")
        return F.when(~v.isin(NA_TOKENS), v).alias(c) if c in text else v

    return df.select(*[cell(c) for c in df.columns])


def _csv_options(options: dict) -> dict[str, str]:
    return CSV_OPTIONS | {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Headered delimited text (all STRING, missing spellings as NULL) or any
    Spark source format.  A record with fewer fields than the header is filled
    with NULL; ``malformed_rows`` shows records whose fields do not fit."""
    if fmt == "csv" and _csv_options(options)["multiLine"] == "true":
        rows = _read_records(spark, path, 0, options)
        return spark.createDataFrame([], StructType([])) if rows is None else rows
    if fmt == "csv":
        return na_to_null(spark.read.options(**_csv_options(options)).csv(path))
    return spark.read.format(fmt).options(**options).load(path)


def malformed_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """The raw records whose number of fields is not the header's: what a
    permissive read fills up or cuts off."""
    opts = _csv_options(options)
    schema = spark.read.options(**opts).csv(path).schema.add(RECORD, "string")
    rows = spark.read.options(**opts, columnNameOfCorruptRecord=RECORD, mode="PERMISSIVE").schema(schema).csv(path)
    # reading the fields keeps them from being pruned: only then are they counted
    fields = F.concat_ws("", *[F.col(f"`{c}`") for c in schema.names[:-1]])
    return rows.filter(F.col(RECORD).isNotNull() & (F.length(fields) >= 0)).select(RECORD)


def read_plan(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """A1: plan sheet -> typed plan (``operators.clean.clean_plan``)."""
    return clean_plan(read_raw(spark, path, fmt, **options))


def read_followup(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """A2: follow-up sheet -> typed follow-up; an empty input gives an empty table."""
    return type_followup(read_raw(spark, path, fmt, **options))


def _names(header: str, opts: dict[str, str]) -> list[str]:
    """Column names of a header record, named as Spark's CSV reader does: blank
    ones by their place, repeated ones with it."""
    cells = next(csv.reader(io.StringIO(header.removeprefix("\ufeff")), delimiter=_sep(opts), quotechar=opts["quote"]))
    times = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if times[c.lower()] > 1 else c for i, c in enumerate(cells)]


def _sep(opts: dict[str, str]) -> str:
    return opts.get("sep", opts.get("delimiter", ","))


def read_delimited_skip(spark: SparkSession, path: str, skip: int, **options) -> DataFrame:
    """A3: delimited files whose first ``skip`` lines, in every file, are a
    preamble before the header.  Each file's cells go by its own header: the result
    has the columns of all headers, those of the first file (by path) first, and NULL
    where a file lacks one.  Files are read in splits of any size; see ``records``."""
    rows = _read_records(spark, path, skip, options)
    if rows is None:
        raise ValueError(f"no header after {skip} lines in {path}")
    return rows


def _read_records(spark: SparkSession, path: str, skip: int, options: dict) -> DataFrame | None:
    """``read_delimited_skip``, None where no file has a header."""
    opts = _csv_options(options)
    if opts["escape"] != opts["quote"]:
        raise ValueError("quotes inside cells must be doubled")
    records = cut_records(read_lines(spark, path), skip, opts["quote"], _sep(opts))
    checkpoint_dir(spark)
    records = records.checkpoint()
    heads = records.groupBy("file").agg(F.min("number").alias("first"), F.min_by("record", "number").alias("header"))
    known = heads.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(MAX_HEADERS + 1).collect()
    if not known:
        return None
    if len(known) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers in {path}")
    names = {r["header"]: _names(r["header"], opts) for r in known}
    columns = list(dict.fromkeys(n for own in names.values() for n in own))
    width = max(map(len, names.values()))
    ddl = ", ".join(f"_{i} string" for i in range(width))
    cells = F.from_csv(F.col("record"), F.lit(ddl), {k: v for k, v in opts.items() if k not in ("header", "inferSchema", "multiLine", "sep", "delimiter")} | {"sep": _sep(opts)})
    rows = records.join(heads, "file").where(F.col("number") > F.col("first")).select("header", cells.alias("c"))

    def cell(name: str) -> Column:
        places: dict[int, list[str]] = {}
        for header, own in names.items():
            if name in own:
                places.setdefault(own.index(name), []).append(header)
        if len(places) == 1 and sum(map(len, places.values())) == len(names):
            return F.col(f"c._{next(iter(places))}").alias(name)
        return F.coalesce(*[F.when(F.col("header").isin(h), F.col(f"c._{i}")) for i, h in places.items()]).alias(name)

    return na_to_null(rows.select(*[cell(n) for n in columns]))


def register(df: DataFrame, name: str) -> DataFrame:
    """Expose a frame under a SQL name (``spark.sql`` can then query it)."""
    df.createOrReplaceTempView(name)
    return df


def sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)
