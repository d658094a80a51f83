"""Row filters and linked facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.constants import OUTER_SEP, SEGMENT_EXTRA_SEPS
from visitlens.functions.text import contains_ci, non_blank_tokens, strip
from visitlens.operators.shape import and_all

# The five linked facets, in the order the selection is validated.
FACETS = ["specialist", "account", "holding", "employer", "region"]
#: D7 asks for every subset of the chosen values.
MAX_CHOSEN = 10
#: Separators inside a case's part of a cell.
TOKEN_SEPS = {"segments": [",", *SEGMENT_EXTRA_SEPS], "occupations": [" | "]}


def _match(df: DataFrame, col: str, value) -> Column | None:
    if value is None or col not in df.columns:
        return None
    # NULL never matches a selection
    return F.coalesce(F.col(col) == F.lit(value), F.lit(False))


def apply_filters(df: DataFrame, selection: dict[str, object | None]) -> DataFrame:
    """AND of equalities; ``None`` means "all"; absent columns are skipped.
    Plain comparisons (a NULL is no match in a filter), which Spark can push
    to the scan."""
    conds = [F.col(k) == F.lit(v) for k, v in selection.items() if v is not None and k in df.columns]
    return df.filter(and_all(conds)) if conds else df


def only_cases(df: DataFrame) -> DataFrame:
    """Rows with at least one case."""
    return df.filter(F.col("has_case"))


def scheduled(df: DataFrame, month: int | None = None) -> DataFrame:
    """D3: rows with a planned date, optionally in one month."""
    out = df.filter(F.col("planned_date").isNotNull())
    return out.filter(F.col("month") == month) if month is not None else out


def contains_filter(df: DataFrame, col: str, text: str | None) -> DataFrame:
    """Case-insensitive literal substring of the whole cell (``MANO`` also
    hits ``MANO_DER``, as in the source application); ``None`` = all."""
    if text is None:
        return df
    return df.filter(contains_ci(col, text))


def has_token(col: str, value: str) -> Column:
    """Whether a token of the cell equals ``value``, whatever the case."""
    seps = [OUTER_SEP, *TOKEN_SEPS.get(col, [","])]
    return F.exists(F.coalesce(non_blank_tokens(col, seps), F.array().cast("array<string>")), lambda t: F.upper(t) == value.strip().upper())


def token_filter(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """D4 by whole tokens (Q14: the source's filter takes any substring); ``None`` = all."""
    return df if value is None else df.filter(has_token(col, value))


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop NULL/blank cells."""
    return df.filter(F.coalesce(strip(F.col(col)) != "", F.lit(False)))


def facet_options(df: DataFrame, selection: dict[str, object | None],
                  facets: list[str] = FACETS) -> DataFrame:
    """D6 (cross-filtering): for each facet, the sorted distinct non-NULL
    values among rows that pass every *other* facet's selection.

    One scan: per row, pass flags for all facets; a row failing two or more
    facets contributes nothing and is dropped first; the rest is exploded into
    (facet, value) pairs and de-duplicated with a partial (map-side)
    aggregation.  Not k separate scans."""
    facets = [f for f in facets if f in df.columns]
    passes = {f: (_match(df, f, selection.get(f)) if selection.get(f) is not None else F.lit(True))
              for f in facets}
    n_fail = sum((F.when(~passes[f], 1).otherwise(0) for f in facets), F.lit(0))
    pairs = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"),
                 and_all([passes[g] for g in facets if g != f]).alias("ok"))
        for f in facets])
    return (df.filter(n_fail <= 1)
              .select(F.explode(pairs).alias("p"))
              .filter(F.col("p.ok") & F.col("p.value").isNotNull())
              .select(F.col("p.facet").alias("facet"), F.col("p.value").alias("value"))
              .distinct()
              .orderBy("facet", "value"))


def validate_selection(df: DataFrame, selection: dict[str, object | None],
                       facets: list[str] = FACETS) -> dict[str, object | None]:
    """In facet order, reset a selection that is not among its available
    options (given the other active selections); repeat until stable, at most
    k rounds.

    The active selections are always a subset of the initial ones, and a
    selection is available exactly when some row matches all active
    selections.  So one aggregation answers "does any row match subset S"
    for every subset S of the initial selections (at most 2^k conditional
    counts; k = 5, more than ``MAX_CHOSEN`` are refused), and the reset rounds are replayed on those booleans."""
    facets = [f for f in facets if f in df.columns]
    sel = {f: selection.get(f) for f in facets}
    chosen = [f for f in facets if sel[f] is not None]
    if not chosen:
        return sel
    if len(chosen) > MAX_CHOSEN:
        raise ValueError(f"at most {MAX_CHOSEN} facets can be validated together, not {len(chosen)}")
    match = {f: F.coalesce(F.col(f) == F.lit(sel[f]), F.lit(False)) for f in chosen}
    subsets = []
    for mask in range(1, 1 << len(chosen)):
        subsets.append(frozenset(f for i, f in enumerate(chosen) if mask >> i & 1))
    aggs = [F.max(and_all([match[f] for f in sorted(s)])).alias(f"s{i}") for i, s in enumerate(subsets)]
    row = df.agg(*aggs).collect()[0]  # one row of at most 31 booleans
    exists = {s: bool(row[f"s{i}"]) for i, s in enumerate(subsets)}
    for _ in range(len(facets)):
        changed = False
        for f in facets:
            if sel[f] is None:
                continue
            active = frozenset(g for g in chosen if sel[g] is not None)
            if not exists[active]:
                sel[f] = None
                changed = True
        if not changed:
            break
    return sel


def selection_frame(spark: SparkSession, sel: dict[str, object | None]) -> DataFrame:
    """A validated selection as rows (facet, value); ``None`` -> NULL (= all)."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sel.items()],
                                 "facet string, value string")
