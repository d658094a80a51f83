"""Typing of the two loosely structured inputs (A1/A2 logic after the scan).

Input: DataFrames whose cells are text with the sheet's headers (any order,
columns may be missing).  Output: the typed schema of SURVEY §1.2 with our
column names.  Every step is a column expression, so cleaning is one
narrow projection fused with the scan — no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens import constants as K
from visitlens.functions.dates import month_name_es, parse_date_flexible
from visitlens.functions.text import strip_point_zero
from visitlens.functions.values import parse_bool_flexible
from visitlens.operators.shape import (drop_empty_rows, first_existing, has_case,
                                       match_columns, rename_headers, strip_headers)

PLAN_COLUMNS = [
    "center_id", "planned_date", "month", "month_name", "region", "specialist", "account",
    "holding", "employer", "center_name", "address", "commune", "men", "women", "has_case",
    "case_ids", "occupations", "tasks", "diagnoses", "segments", "icd10", "notes",
]


def _s(c: str):
    return F.col(f"`{c}`").cast("string")


def clean_region(c) -> "F.Column":
    """NULL -> ``S/R``, then every ``.0`` removed (quirk Q5 kept)."""
    return strip_point_zero(F.coalesce(c.cast("string"), F.lit(K.REGION_NULL)))


def clean_plan(raw: DataFrame, keep_extra: bool = False, drop_empty: bool = False) -> DataFrame:
    """A1 cleaning: headers trimmed then aliases renamed (Q12), case cells
    defaulted to ``''``, region/specialist/account/holding/commune defaults,
    flexible date + month, numeric worker counts via ``try_cast``.

    Q4: the source drops all-empty rows only *after* adding constant columns,
    so no row is ever dropped; that is the default here, and it keeps column
    pruning (a two-column report reads two columns).  ``drop_empty=True``
    removes rows whose raw cells are all NULL, which reads every column."""
    df = rename_headers(strip_headers(raw), K.HEADER_ALIASES)
    if drop_empty:
        df = drop_empty_rows(df)
    cols = set(df.columns)

    out = {}
    out["center_id"] = _s(K.H_CENTER_ID) if K.H_CENTER_ID in cols else F.lit(None).cast("string")
    planned = parse_date_flexible(_s(K.H_PLANNED)) if K.H_PLANNED in cols else F.lit(None).cast("date")
    out["planned_date"] = planned
    out["month"] = F.month(planned)
    out["month_name"] = month_name_es(F.month(planned))
    out["region"] = clean_region(F.col(f"`{K.H_REGION}`")) if K.H_REGION in cols else F.lit(K.REGION_MISSING)
    for name, header, default in [("specialist", K.H_SPECIALIST, K.SPECIALIST_DEFAULT),
                                  ("account", K.H_ACCOUNT, K.ACCOUNT_DEFAULT),
                                  ("holding", K.H_HOLDING, K.HOLDING_DEFAULT)]:
        out[name] = F.coalesce(_s(header), F.lit(default)) if header in cols else F.lit(default)
    for name, header in [("employer", K.H_EMPLOYER), ("center_name", K.H_CENTER_NAME),
                         ("address", K.H_ADDRESS)]:
        out[name] = _s(header) if header in cols else F.lit(None).cast("string")
    # Commune: the second commune column wins when present; NULL -> S/D (Q3: evident intent)
    out["commune"] = F.coalesce(first_existing(df, [K.H_COMMUNE_2, K.H_COMMUNE]).cast("string"),
                                F.lit(K.COMMUNE_DEFAULT))
    for name, header in [("men", K.H_MEN), ("women", K.H_WOMEN)]:
        out[name] = (_s(header).try_cast("double") if header in cols
                     else F.lit(None).cast("double"))
    for header, name in K.CASE_COLUMNS.items():
        out[name] = F.coalesce(_s(header), F.lit("")) if header in cols else F.lit("")
    extra = []
    if keep_extra:
        used = {K.H_CENTER_ID, K.H_PLANNED, K.H_REGION, K.H_SPECIALIST, K.H_ACCOUNT, K.H_HOLDING,
                K.H_EMPLOYER, K.H_CENTER_NAME, K.H_ADDRESS, K.H_COMMUNE, K.H_COMMUNE_2, K.H_MEN,
                K.H_WOMEN, *K.CASE_COLUMNS}
        extra = [c for c in df.columns if c not in used and c not in PLAN_COLUMNS]
    typed = df.select(*[v.alias(k) for k, v in out.items()], *[F.col(f"`{c}`") for c in extra])
    return typed.withColumn("has_case", has_case("case_ids")).select(*PLAN_COLUMNS, *extra)


def type_followup(raw: DataFrame) -> DataFrame:
    """A2 typing: headers trimmed; date-named columns (``Fecha``/``Prescripción``
    without ``Pilar``/``Estado``) parsed flexibly; flag-named columns
    (``Pilar``/``Cumplida``/``Validado``) parsed as flexible booleans; region
    cleaned as in the plan (Q13); known headers renamed to our names."""
    df = strip_headers(raw)
    date_cols = match_columns(df, K.DATE_NAME_INCLUDE, K.DATE_NAME_EXCLUDE)
    bool_cols = match_columns(df, K.BOOL_NAME_INCLUDE)
    exprs = []
    for c in df.columns:
        if c in date_cols:
            e = parse_date_flexible(_s(c))
        elif c in bool_cols:
            e = parse_bool_flexible(_s(c))
        elif c == K.H_REGION:
            e = clean_region(F.col(f"`{c}`"))
        else:
            e = F.col(f"`{c}`")
        exprs.append(e.alias(K.FOLLOWUP_RENAMES.get(c, c)))
    return df.select(*exprs)
