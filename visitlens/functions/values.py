"""Flags, percentages, rounding, labels, custom orders, URLs and JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.constants import (PILLAR_LABEL_REPLACEMENTS, SHEET_EXPORT_URL, SHEET_GID_PATTERN,
                                 SHEET_ID_PATTERN, TRUE_SPELLINGS)
from visitlens.functions.text import _c, strip


def parse_bool_flexible(c) -> Column:
    """Upper + strip; ``TRUE``/``1``/``VERDADERO`` are true, everything
    else (``FALSE``, ``0``, ``FALSO``, ``si``, blank, NULL...) is false."""
    return F.coalesce(F.upper(strip(_c(c))).isin(*TRUE_SPELLINGS), F.lit(False))


def round1(x) -> Column:
    """Round to one decimal, half to even on ``x*10`` (``0.25`` -> ``0.2``)."""
    return F.rint(_c(x) * 10) / 10


def pct(n, d) -> Column:
    """C14 + C15: ``n/d*100`` rounded to one decimal; 0 when ``d`` is 0 or NULL."""
    return F.coalesce(round1(F.try_divide(_c(n).cast("double"), _c(d)) * 100), F.lit(0.0))


def n_pct_label(n, p) -> Column:
    """``"n (p%)"``."""
    return F.concat(_c(n).cast("bigint").cast("string"), F.lit(" ("), _c(p).cast("string"), F.lit("%)"))


def short_label(c) -> Column:
    """C17: chained literal replacements (pillar header -> short label)."""
    out = _c(c)
    for a, b in PILLAR_LABEL_REPLACEMENTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def short_label_text(text: str) -> str:
    for a, b in PILLAR_LABEL_REPLACEMENTS:
        text = text.replace(a, b)
    return text


def custom_order_key(c, order: list[str]) -> Column:
    """1-based position of ``upper(c)`` in ``order``; unknown values
    sort after all known ones (use the value itself as the second key)."""
    arr = F.array(*[F.lit(v) for v in order])
    pos = F.array_position(arr, F.upper(_c(c)))
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1)).cast("int")


def export_url(c) -> Column:
    """Spreadsheet link -> CSV export link; NULL when no id is found."""
    sheet_id = F.regexp_extract(_c(c), SHEET_ID_PATTERN, 1)
    gid = F.regexp_extract(_c(c), SHEET_GID_PATTERN, 1)
    gid = F.when(gid == "", F.lit("0")).otherwise(gid)
    start, middle = SHEET_EXPORT_URL.split("{id}")
    url = F.concat(F.lit(start), sheet_id, F.lit(middle.removesuffix("{gid}")), gid)
    return F.when(F.coalesce(sheet_id, F.lit("")) == "", F.lit(None).cast("string")).otherwise(url)


def sheet_id(c) -> Column:
    v = F.regexp_extract(_c(c), SHEET_ID_PATTERN, 1)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(v)


def sheet_gid(c) -> Column:
    v = F.regexp_extract(_c(c), SHEET_GID_PATTERN, 1)
    return F.when(v == "", F.lit("0")).otherwise(v)
