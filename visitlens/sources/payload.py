"""JSON batch payloads ``{"headers": [...], "rows": [[...], ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = "struct<headers: array<string>, rows: array<array<string>>>"


def parse_payload(col: str = "payload"):
    return F.from_json(F.col(col), PAYLOAD_SCHEMA)


def _problem(p: "F.Column", payload: "F.Column", columns: list[str] | None = None) -> "F.Column":
    """Why a payload cannot be used, NULL if it can.  Without headers of its own, no
    row may have more cells than there are ``columns``."""
    width = F.size(p["headers"])
    most = F.lit(len(columns)) if columns is not None else F.lit(2**31 - 1)
    return (F.when(payload.isNull() | (F.trim(payload) == ""), F.lit("empty payload"))
            .when(p.isNull() | (p["headers"].isNull() & p["rows"].isNull()), F.lit("malformed payload"))
            .when(p["headers"].isNotNull() & F.exists(F.coalesce(p["rows"], F.array()), lambda r: r.isNull() | (F.size(r) != width)),
                  F.lit("row width differs from header"))
            .when(p["headers"].isNull() & F.exists(F.coalesce(p["rows"], F.array()), lambda r: r.isNull() | (F.size(r) > most)),
                  F.lit("row wider than the table")))


def payload_status(df: DataFrame, col: str = "payload", keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A10: one row per payload: ``status`` (ok / error), ``error`` and the
    number of ``rows`` that ``payload_to_rows`` gives for it (under ``columns``)."""
    parsed = df.select(*(keep or []), F.col(col).alias("__raw"), parse_payload(col).alias("__p"))
    problem = _problem(F.col("__p"), F.col("__raw"), columns)
    return parsed.select(*(keep or []), F.when(problem.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                         problem.alias("error"),
                         F.when(problem.isNull(), F.coalesce(F.size("__p.rows"), F.lit(0))).otherwise(F.lit(0)).alias("rows"))


def payload_to_rows(df: DataFrame, columns: list[str], col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """A10: one output row per positional row of each usable payload, with the
    cells under ``columns`` found by the payload's own headers (by position
    where it has none; a column it lacks is NULL).  An empty or missing
    ``rows`` array yields nothing; unusable payloads are reported by
    ``payload_status``, so input payloads = usable + reported."""
    keep = keep or []
    parsed = df.select(*keep, F.col(col).alias("__raw"), parse_payload(col).alias("__p"))
    usable = parsed.filter(_problem(F.col("__p"), F.col("__raw"), columns).isNull())
    rows = usable.select(*keep, F.col("__p.headers").alias("__h"),
                         F.posexplode(F.coalesce(F.col("__p.rows"), F.array().cast("array<array<string>>"))).alias("row_no", "__r"))

    def cell(i: int, c: str) -> "F.Column":
        at = F.array_position("__h", c)  # from 1; 0: not there
        return F.when(F.col("__h").isNull(), F.get("__r", F.lit(i))).when(at > 0, F.get("__r", (at - 1).cast("int"))).alias(c)

    return rows.select(*keep, "row_no", *[cell(i, c) for i, c in enumerate(columns)])


def build_payload(df: DataFrame, batch_cols: list[str], columns: list[str], order_col: str,
                  alias: str = "payload", chunk_rows: int = 1000) -> DataFrame:
    """The inverse: JSON payloads of positional rows ordered by ``order_col``.

    Every batch is cut into chunks by ``floor(order_col / chunk_rows)``
    (``order_col`` numeric, unique within a batch), so no payload — and no
    collected group — holds more than ``chunk_rows`` rows, however large one
    batch is.  The chunk number is returned as column ``chunk``."""
    chunk = F.floor(F.col(order_col) / F.lit(chunk_rows)).cast("bigint")
    row = F.struct(F.col(order_col).alias("__o"), F.array(*[F.col(c).cast("string") for c in columns]).alias("__a"))
    agg = df.groupBy(*batch_cols, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return agg.select(*batch_cols, "chunk", F.to_json(F.struct(
        F.array(*[F.lit(c) for c in columns]).alias("headers"),
        F.transform("__rows", lambda r: r["__a"]).alias("rows"))).alias(alias))


def result_envelope(rows_col: str = "rows_written") -> "F.Column":
    """``{"success":true,"rows_written":n}`` for a count column."""
    return F.to_json(F.struct(F.lit(True).alias("success"), F.col(rows_col).alias("rows_written")))
