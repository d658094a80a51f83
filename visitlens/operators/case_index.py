"""A stored index that answers distinct cases, KPIs and facets for any selection.

Case ids are numbered once (``sources.sinks.number_rows``).  Per combination of facet
values and month the index keeps the plan's counts and a bitmap of the cases, by words
of 64 numbers of which only those with a case are stored; per combination of facet
values the follow-up's counts.  Cases of a selection are then an OR of its words and a
count of bits, exact for every selection, and no cell is split again.  The plan itself
is read once: what the index needs of its visits is written beside and deleted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators import aggregates as A
from visitlens.operators.cells import case_ids
from visitlens.operators.filters import FACETS, apply_filters, facet_options
from visitlens.operators.lookup import attach_scalars
from visitlens.session import delete_path, scratch_path
from visitlens.sources.sinks import number_rows, refresh_table

KEYS = [*FACETS, "month", "has_case"]


#: Numbers in a word of a bitmap.
WORD_BITS = 64


def build_case_index(plan: DataFrame, fu: DataFrame, path: str) -> dict[str, int]:
    """Write the index of a typed plan and follow-up; returns rows per table."""
    base, spark = path.rstrip("/"), plan.sparkSession
    staged = scratch_path(spark, "case_index_visits")
    try:
        plan.select(*KEYS, F.col("planned_date").isNotNull().alias("planned"), "case_ids").write.parquet(staged)
        visits = spark.read.parquet(staged)
        distinct = case_ids(visits).distinct()
        out = {"cases": refresh_table(number_rows(distinct).withColumnRenamed("_row", "number"), f"{base}/cases")}
        numbers = spark.read.parquet(f"{base}/cases")
        combos = visits.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("visits"), F.count_if("planned").alias("scheduled"))
        out["combos"] = refresh_table(combos, f"{base}/combos")
        held = case_ids(visits, keep=KEYS).join(numbers, "case_id")
        word, bit = F.floor(F.col("number") / WORD_BITS), F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} AS int))")
        out["bits"] = refresh_table(held.groupBy(*KEYS, word.alias("word")).agg(F.bit_or(bit).alias("bits")), f"{base}/bits")
    finally:
        delete_path(spark, staged)
    counts = fu.groupBy(*[c for c in FACETS if c in fu.columns]).agg(*A.followup_counts(fu))
    out["followup"] = refresh_table(counts, f"{base}/followup")
    return out


class CaseIndex:
    """The stored index; each answer equals that of the operator of the same name on
    ``apply_filters`` of the tables it was built from."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        base = path.rstrip("/")
        self.combos, self.bits, self.followup = (spark.read.parquet(f"{base}/{t}") for t in ("combos", "bits", "followup"))

    def _cases(self, bits: DataFrame) -> DataFrame:
        """Distinct cases of some words: one row, ``n_cases``."""
        return (bits.groupBy("word").agg(F.bit_or("bits").alias("bits"))
                .agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n_cases")))

    def _plan_counts(self, selection: dict, month: int | None) -> DataFrame:
        at = F.lit(True) if month is None else F.coalesce(F.col("month") == month, F.lit(False))
        own = apply_filters(self.combos, selection).agg(
            F.coalesce(F.sum(F.when(at, F.col("scheduled"))), F.lit(0)).alias("scheduled"),
            F.count_distinct(F.when(F.col("has_case"), F.col("employer"))).alias("employers_with_cases"))
        return attach_scalars(own, self._cases(apply_filters(self.bits, selection)))

    def _fu_counts(self, selection: dict) -> DataFrame:
        own = apply_filters(self.followup, selection)
        return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fu_rows", "goals", "overdue", *A.PILLARS)])

    def kpi_global(self, selection: dict, month: int | None = None) -> DataFrame:
        """F17."""
        return A.kpi_global_row(attach_scalars(self._plan_counts(selection, month), self._fu_counts(selection)))

    def kpi_followup(self, selection: dict, month: int | None = None) -> DataFrame:
        """F18."""
        return A.kpi_followup_of(self._plan_counts(selection, month).select("scheduled"), self._fu_counts(selection))

    def case_summary(self, selection: dict) -> DataFrame:
        """F19 of the visits with cases."""
        combos = apply_filters(self.combos, selection).filter("has_case")
        own = combos.agg(F.count_distinct("employer").alias("n_employers"), F.coalesce(F.sum("visits"), F.lit(0)).alias("n_visits"))
        return attach_scalars(own, self._cases(apply_filters(self.bits, selection).filter("has_case"))).select("n_cases", "n_employers", "n_visits")

    def cases_by(self, facet: str, selection: dict | None = None) -> DataFrame:
        """F4 by a facet: distinct cases per value (NULL dropped)."""
        chosen = apply_filters(self.bits, selection or {}).filter(F.col(facet).isNotNull())
        return (chosen.groupBy(facet, "word").agg(F.bit_or("bits").alias("bits"))
                .groupBy(facet).agg(F.sum(F.bit_count("bits")).alias("n_cases")))

    def facet_options(self, selection: dict) -> DataFrame:
        """D6."""
        return facet_options(self.combos, selection)
