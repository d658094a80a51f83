"""Indel similarity of token-sorted labels.

``ratio(a, b) = 100 * 2 * LCS(a, b) / (len(a) + len(b))`` — the share of
characters kept when turning one string into the other with inserts and
deletes only (substitutions are not allowed, so this is *not* Levenshtein).

The LCS length is computed with the bit-parallel recurrence of Allison & Dix
(1986) / Hyyrö (2004): one machine-word (here: Python int) update per
character of ``b``.  It runs inside an Arrow-batched pandas UDF over
candidate pairs that the blocked join (``operators.similarity_join``) has
already reduced, so it is the only Python on the hot path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of ``a`` and ``b``."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio_py(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def lcs(a, b) -> Column:
    """Column: LCS length of two string columns (Arrow-batched)."""
    return lcs_udf(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def ratio_from_lcs(lcs_col, len_a, len_b) -> Column:
    """Unrounded similarity in [0, 100] from an LCS length."""
    tot = len_a + len_b
    return F.when(tot == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_col / tot)


def meets_threshold(lcs_col, len_a, len_b, threshold: int) -> Column:
    """Exact rational test ``200*LCS >= threshold*(len_a+len_b)`` (no float cut-off)."""
    return F.lit(200) * lcs_col >= F.lit(threshold) * (len_a + len_b)
