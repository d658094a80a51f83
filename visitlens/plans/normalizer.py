"""Two-phase vocabulary normaliser.

Phase 1 extracts the atomic labels of the occupation and task columns,
clusters them with the blocked similarity join and returns one proposals
table per column.  A person reviews the written tables.  Phase 2 reads the
reviewed tables back (``load_canonical_map``) and rewrites the cells.  The
review gap is a durable table, so the two jobs share no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.constants import SIMILARITY_THRESHOLD
from visitlens.operators.aggregates import change_stats
from visitlens.operators.canonicalize import canonicalize_cells, load_canonical_map
from visitlens.operators.cells import atomic_values_by_column
from visitlens.operators.similarity_join import cluster, propose
from visitlens.session import checkpoint_dir
from visitlens.sources.sinks import write_tables

# Column -> (outer, inner) separators of each phase, as in the source
# application.  Phase 2 splits occupations by "||" only (quirk Q9): a cell
# "A | B" is normalised as one item; pass other separators to change that.
PHASE1_SEPS = {"ocupaciones": ("||", "|"), "tareas": ("||", ",")}
PHASE2_SEPS = {"ocupaciones": ("||", "||"), "tareas": ("||", ",")}


def vocabulary(raw: DataFrame, seps: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Distinct normalised labels of every phase-1 column, from ONE scan of the
    raw table, pinned with a reliable checkpoint: (column, value)."""
    checkpoint_dir(raw.sparkSession)
    return atomic_values_by_column(raw, seps or PHASE1_SEPS).checkpoint()


def phase1_proposals(raw: DataFrame, threshold: int = SIMILARITY_THRESHOLD,
                     seps: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """One proposals table (variante, canonical_propuesto, similitud) per column."""
    out = {}
    vocab = vocabulary(raw, seps)
    for col in (seps or PHASE1_SEPS):
        if col not in raw.columns:
            continue
        p = propose(vocab.filter(F.col("column") == col), "value", threshold)
        # the proposals are phase 1's durable output: materialise them once
        out[col] = p.select(F.col("variant").alias("variante"), F.col("canonical").alias("canonical_propuesto"),
                            F.col("similarity").alias("similitud")).checkpoint()
    return out


def phase1_stats(raw: DataFrame, threshold: int = SIMILARITY_THRESHOLD,
                 seps: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """F24 per column: (column, n_values, n_clusters, n_variants, n_proposals)."""
    frames = []
    vocab = vocabulary(raw, seps)
    for col in (seps or PHASE1_SEPS):
        if col not in raw.columns:
            continue
        c = cluster(vocab.filter(F.col("column") == col), "value", threshold)
        counts = (c["labels"].select(F.lit(1).alias("kind"))
                  .unionByName(c["canonicals"].select(F.lit(2).alias("kind")))
                  .unionByName(c["proposals"].select(F.lit(3).alias("kind"))))
        frames.append(counts.agg(F.lit(col).alias("column"),
                                 F.count_if(F.col("kind") == 1).alias("n_values"),
                                 F.count_if(F.col("kind") == 2).alias("n_clusters"),
                                 F.count_if(F.col("kind") == 3).alias("n_proposals")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("column", "n_values", "n_clusters",
                      (F.col("n_values") - F.col("n_clusters")).alias("n_variants"), "n_proposals")


def write_proposals(proposals: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, int]:
    """A5: one table per column under ``path``; returns rows written per table.
    The rows are numbered (``orden``) in proposal order, so a reviewer's later
    duplicate of a variant wins whatever files the table is read from."""
    numbered = {}
    for name, p in proposals.items():
        # a vocabulary-sized table; numbers follow the global sort
        ordered = p.orderBy("canonical_propuesto", F.col("similitud").desc(), "variante")
        numbered[name] = ordered.withColumn("orden", F.monotonically_increasing_id())
    return write_tables(numbered, path, fmt=fmt)


def read_proposals(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {c: spark.read.format(fmt).load(f"{path.rstrip('/')}/{c}") for c in columns}


def phase2_apply(raw: DataFrame, reviewed: dict[str, DataFrame],
                 seps: dict[str, tuple[str, str]] | None = None, keep_original: bool = False) -> DataFrame:
    """Rewrite each column with its reviewed map (A4 + N4).  With
    ``keep_original`` the input cells stay beside the new ones as ``<col>__before``."""
    seps = {c: s for c, s in (seps or PHASE2_SEPS).items() if c in raw.columns and c in reviewed}
    before = {f"{c}__before": F.col(c) for c in seps} if keep_original else {}
    maps = {c: load_canonical_map(reviewed[c]) for c in seps}
    return canonicalize_cells(raw.withColumns(before) if before else raw, maps, seps)


def phase2_changes(applied: DataFrame, columns: list[str]) -> DataFrame:
    """F23 on a ``phase2_apply(..., keep_original=True)`` result."""
    return change_stats(applied, {f"changed_{c}": (f"{c}__before", c) for c in columns})
