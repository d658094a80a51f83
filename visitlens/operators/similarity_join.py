"""Fuzzy label clustering on Spark.

Similarity is the indel ratio of token-sorted labels
(``100 * 2*LCS / (len a + len b)``, ``functions.similarity``); two labels
*match* when it is at least the threshold ``T`` (exact rational test).

Lossless blocked self-join (never a cross join):

1. Distinct labels are collapsed to distinct token-sort keys ``ts``; equal
   keys score 100 without any comparison.
2. Length bound: a match needs ``min(n) * (200 - T) >= T * max(n)``.
3. Segment signatures (after Pass-Join, Li et al. 2011, for inserts and deletes).
   Two keys of lengths ``a <= b`` match within ``D(a, b)`` edits.  Cut the shorter
   key into ``D + 1`` segments and give every edit to one of them: going from the
   left, the first segment ``i`` with no more than ``i`` edits up to its end is
   intact and has exactly ``i`` edits before it and at most ``D - i`` after it.  It
   is therefore found in the longer key moved by one of ``-i, -i + 2, .., i``
   characters, and no further than ``D - i`` from where the right end would put it.
   Segments are equi-joined with those few substrings on (both lengths, number,
   text): a match is never lost, and a key meets only keys that share a whole
   segment in place.
4. Lengths at which the shorter key has fewer characters than segments (not for
   T = 88) are equi-joined on the lengths alone.
5. Candidates whose character counts differ more than a match's edits allow
   are dropped by a native bound.
6. The rest are verified with the exact LCS (Arrow UDF) and the rational
   threshold.

Clustering then works on key-level pairs only: a key's *representative* is
the longest (then largest) label among the labels of its matching keys; the
canonical set is the set of representatives (not transitive, as in the
source application); every other label maps to the best-scoring canonical
(ties: the smallest canonical).  No label-level pair list is ever built, so
a key shared by many spellings never fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.constants import SIMILARITY_THRESHOLD
from visitlens.functions.similarity import lcs, meets_threshold, ratio_from_lcs
from visitlens.functions.text import token_sort
from visitlens.session import checkpoint_dir


def label_keys(values: DataFrame, col: str = "value") -> DataFrame:
    """(value, ts, n): each distinct label with its token-sort key and length."""
    return (values.select(F.col(col).alias("value")).distinct()
                  .withColumn("ts", token_sort("value"))
                  .withColumn("n", F.length("ts")))


def _max_edits(a, b, t: int):
    """Most inserts and deletes of a match of these lengths; their number is even
    where the lengths' sum is."""
    most = F.floor((a + b) * F.lit(100 - t) / F.lit(100)).cast("int")
    return most - (most + a + b) % 2


def _len_hi(n, t: int):
    """Longest admissible partner length of a key of length n."""
    return F.floor(n * F.lit(200 - t) / F.lit(t)).cast("int")


def _len_lo(n, t: int):
    """Shortest admissible partner length of a key of length n."""
    return F.ceil(n * F.lit(t) / F.lit(200 - t)).cast("int")


BAG_CELLS = 16


def _bags(ts):
    """Character counts of a key by code point modulo 32, at most 15 each, in two
    longs of 16 cells: one insert or delete changes one count by one at most."""
    codes = F.transform(F.split(ts, ""), lambda ch: F.ascii(ch) % (2 * BAG_CELLS))

    def packed(first: int):
        cells = F.transform(F.sequence(F.lit(first), F.lit(first + BAG_CELLS - 1)),
                            lambda cell: F.least(F.size(F.filter(codes, lambda x: x == cell)), F.lit(15)).cast("long"))
        return F.aggregate(cells, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x))

    return packed(0), packed(BAG_CELLS)


def _bags_match(bags_a, bags_b, n_a, n_b, t: int):
    """No more count differences than a match of these lengths has edits."""
    apart = F.lit(0).cast("long")
    for x, y in zip(bags_a, bags_b):
        for cell in range(BAG_CELLS):
            apart += F.abs(F.shiftrightunsigned(x, 4 * cell).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(y, 4 * cell).bitwiseAND(F.lit(15)))
    return apart * 100 <= (n_a + n_b) * (100 - t)


def _segment(a, d, i):
    """(start, length) of segment ``i`` of a key of length ``a`` cut into ``d + 1``."""
    start = F.floor(i * a / (d + 1)).cast("int")
    return start, F.floor((i + 1) * a / (d + 1)).cast("int") - start


def segment_index(keys: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(own, other): the segments of the keys as shorter ones, and the substrings that
    they are looked for under as longer ones."""
    bag_lo, bag_hi = _bags(F.col("ts"))
    k = keys.select("ts", "n").filter(F.col("n") > 0).distinct().select("ts", "n", bag_lo.alias("x"), bag_hi.alias("y"))
    edits = _max_edits(F.col("n_a"), F.col("n_b"), threshold)
    start, length = _segment(F.col("n_a"), F.col("d"), F.col("i"))

    def numbered(side: DataFrame) -> DataFrame:
        cut = side.withColumn("d", edits)
        numbers = F.when(F.col("d") < F.col("n_a"), F.sequence(F.lit(0), F.col("d"))).otherwise(F.array(F.lit(-1)))
        return cut.withColumn("i", F.explode(numbers)).withColumns({"start": start, "length": length})

    # without enough characters for the segments (number -1) the lengths alone are the key
    own = numbered(k.select(F.col("ts").alias("ts_a"), F.col("n").alias("n_a"), F.col("x").alias("x_a"), F.col("y").alias("y_a"),
                            F.explode(F.sequence(F.col("n"), _len_hi(F.col("n"), threshold))).alias("n_b")))
    own = own.select("ts_a", "n_a", "x_a", "y_a", F.col("n_b").alias("to"), F.col("i").alias("at"),
                     F.when(F.col("i") < 0, F.lit("")).otherwise(F.substring("ts_a", F.col("start") + 1, F.col("length"))).alias("segment"))
    other = numbered(k.select(F.col("ts").alias("ts_b"), F.col("n").alias("n_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"),
                              F.explode(F.sequence(_len_lo(F.col("n"), threshold), F.col("n"))).alias("n_a")))
    moves = F.when(F.col("i") < 0, F.array(F.lit(0))).otherwise(F.sequence(-F.col("i"), F.col("i"), F.lit(2)))
    moved = (F.abs(F.col("n_b") - F.col("n_a") - F.col("move")) <= F.col("d") - F.col("i"))
    inside = (F.col("start") + F.col("move") >= 0) & (F.col("start") + F.col("move") + F.col("length") <= F.col("n_b"))
    other = (other.withColumn("move", F.explode(moves)).filter((F.col("i") < 0) | (moved & inside))
             .select("ts_b", "n_b", "x_b", "y_b", F.col("n_a").alias("from"), "i",
                     F.when(F.col("i") < 0, F.lit("")).otherwise(F.substring("ts_b", F.col("start") + F.col("move") + 1, F.col("length"))).alias("text")))
    return own, other


def meet(own: DataFrame, other: DataFrame) -> DataFrame:
    """Key pairs (ts_a, n_a, ts_b, n_b, and bags) that share a segment in place, once
    per segment, shorter key first (ties by key)."""
    return own.join(other, (F.col("n_a") == F.col("from")) & (F.col("to") == F.col("n_b")) & (F.col("at") == F.col("i"))
                    & (F.col("segment") == F.col("text")) & ((F.col("n_a") < F.col("n_b")) | (F.col("ts_a") < F.col("ts_b"))))


def segment_pairs(keys: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """``meet`` of the keys with each other."""
    return meet(*segment_index(keys, threshold))


def close_pairs(met: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """The pairs of ``meet`` whose character counts allow a match, each once."""
    # becomes part of the join's condition: only close pairs leave the join
    near = _bags_match((F.col("x_a"), F.col("y_a")), (F.col("x_b"), F.col("y_b")), F.col("n_a"), F.col("n_b"), threshold)
    return met.filter(near).select("ts_a", "n_a", "ts_b", "n_b").distinct()


def candidate_pairs(keys: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """Unordered candidate key pairs (ts_a, n_a, ts_b, n_b), shorter key first
    (ties by key).  Contains every pair that can match."""
    return close_pairs(segment_pairs(keys, threshold), threshold)


def matching(candidates: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """Candidates that match, with ``lcs`` and ``score``."""
    ver = candidates.withColumn("lcs", lcs("ts_a", "ts_b"))
    ok = ver.filter(meets_threshold(F.col("lcs"), F.col("n_a"), F.col("n_b"), threshold))
    return ok.withColumn("score", ratio_from_lcs(F.col("lcs"), F.col("n_a"), F.col("n_b")))


def similar_keys(keys: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """E3 at key level: verified matching key pairs (ts_a, n_a, ts_b, n_b, lcs, score)."""
    return matching(candidate_pairs(keys, threshold), threshold)


def _symmetric(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(x, y, score) for both directions of every matching pair plus (x, x, 100)."""
    fwd = pairs.select(F.col("ts_a").alias("x"), F.col("ts_b").alias("y"), "score")
    bwd = pairs.select(F.col("ts_b").alias("x"), F.col("ts_a").alias("y"), "score")
    selfp = keys.select(F.col("ts").alias("x"), F.col("ts").alias("y"), F.lit(100.0).alias("score")).distinct()
    return fwd.unionByName(bwd).unionByName(selfp)


def choose_canonicals(labels: DataFrame, sym: DataFrame) -> DataFrame:
    """(value, ts, rep) — each label's representative: the longest, then
    largest, label among the labels of its matching keys."""
    best = labels.groupBy("ts").agg(
        F.max_by("value", F.struct(F.length("value"), F.col("value"))).alias("best"))
    rep_ts = (sym.join(best, sym.y == best.ts)
                 .groupBy("x").agg(F.max_by("best", F.struct(F.length("best"), F.col("best"))).alias("rep")))
    return labels.join(rep_ts, labels.ts == rep_ts.x).select("value", "ts", "rep")


def nearest_canonical(sym: DataFrame, canon: DataFrame) -> DataFrame:
    """E4 at key level: for each key x, the canonical with the highest score
    among matching keys (ties: smallest canonical).  (x, canonical, score)."""
    min_c = canon.groupBy("ts").agg(F.min("canonical").alias("mc"))
    cand = sym.join(min_c, sym.y == min_c.ts)
    return cand.groupBy("x").agg(
        F.min_by(F.struct(F.col("mc"), F.col("score")), F.struct(-F.col("score"), F.col("mc"))).alias("b")
    ).select("x", F.col("b.mc").alias("canonical"), F.col("b.score").alias("score"))


def cluster(values: DataFrame, col: str = "value", threshold: int = SIMILARITY_THRESHOLD) -> dict[str, DataFrame]:
    """N2 building blocks: labels with keys, verified key pairs, canonical set,
    representatives and proposals (variant, canonical, similarity)."""
    # The vocabulary and the verified pairs feed several branches below; pin
    # them once with a reliable checkpoint (shared checkpoint folder) so the
    # scan, the explode and the LCS verification run exactly once.
    checkpoint_dir(values.sparkSession)
    labels = label_keys(values, col).checkpoint()
    return clustered(labels, similar_keys(labels.select("ts", "n").distinct(), threshold).checkpoint(), threshold)


def clustered(labels: DataFrame, pairs: DataFrame, threshold: int = SIMILARITY_THRESHOLD) -> dict[str, DataFrame]:
    """The clusters of labels (value, ts, n) whose keys' matching pairs are known."""
    keys = labels.select("ts", "n").distinct()
    sym = _symmetric(pairs, keys)
    reps = choose_canonicals(labels, sym)
    # the canonical set feeds the anti-join, the nearest-canonical search and
    # the statistics: materialise it once (vocabulary-sized)
    canon = (reps.select(F.col("rep").alias("canonical")).distinct()
                 .join(labels.select(F.col("value").alias("canonical"), "ts"), "canonical")).checkpoint()
    near = nearest_canonical(sym, canon)
    variants = labels.join(canon.select(F.col("canonical").alias("value")), "value", "left_anti")
    proposals = (variants.join(near, variants.ts == near.x)
                         .filter(F.col("score") >= threshold)
                         .select(F.col("value").alias("variant"), "canonical",
                                 F.rint("score").cast("int").alias("similarity")))
    return {"labels": labels, "pairs": pairs, "canonicals": canon.select("canonical"),
            "representatives": reps, "proposals": proposals}


def propose(values: DataFrame, col: str = "value", threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """Proposals (variant, canonical, similarity) for every non-canonical
    label, ordered canonical ascending, similarity descending, then variant (H2)."""
    return cluster(values, col, threshold)["proposals"].orderBy("canonical", F.col("similarity").desc(), "variant")


def cluster_stats(values: DataFrame, col: str = "value", threshold: int = SIMILARITY_THRESHOLD) -> DataFrame:
    """labels, clusters (canonicals) and variants (= labels - clusters)."""
    c = cluster(values, col, threshold)
    n_vals = c["labels"].agg(F.count(F.lit(1)).alias("n_values"))
    n_can = c["canonicals"].agg(F.count(F.lit(1)).alias("n_clusters"))
    from visitlens.operators.lookup import attach_scalars
    out = attach_scalars(n_vals, n_can)
    return out.select("n_values", "n_clusters", (F.col("n_values") - F.col("n_clusters")).alias("n_variants"))
