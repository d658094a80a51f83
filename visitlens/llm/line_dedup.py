"""Line de-duplication over a corpus, as keep bitmaps.

Every line gets a key (blanks stripped, A-Z lower-cased).  A key of at least
``min_chars`` code points that stands in two or more documents keeps its lines
only in the document with the smallest id; all other lines stay.

Method: (two 64-bit hashes of the key, id, position) rows are range-partitioned
by hash and sorted by id and position inside; one stream over each range sees
the first document of every key and marks the lines of later ones.  What comes
back is not text but, per document that loses lines, the 64-line words of its
keep bitmap that are not all ones.

Hot keys: the most frequent hashes are found by a bounded frequent-items
sketch over all lines (at most ``hot_keys`` of them).  Their first documents
come from a map-side-combined minimum and are broadcast, so their lines are
decided where they are read and never meet in one range.  The sketch decides
only which way a key goes; both ways give the same result.

All native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut

MIN_CHARS = 10
#: Frequent hashes taken out of the range partitioning; bounds the broadcast.
HOT_KEYS = 1000
SKETCH_ITEMS = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of the lines whose key counts."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"),
                    "doc_id", "version", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Per document that loses lines: ``doc_id, version`` (xxhash64 of the
    text), ``n_dropped, keep`` - the words of its keep bitmap, 64 lines each,
    that are not all ones, as sorted ``array<struct<word, bits>>``.

    NULL or empty text holds one empty line, whose key is too short to count.
    A NULL id sorts after all others; rows with NULL ids count as one document,
    as do rows that repeat an id.  Repeated rows get one bitmap, rows of one id
    with different texts one each.  Empty input gives no rows.
    """
    # small rows, read three times: split and hash the texts once
    lines = cut(_lines(docs, id_col, text_col, min_chars))
    sketch = lines.agg(F.expr(f"approx_top_k(h1, {hot_keys}, {SKETCH_ITEMS})").alias("top"))
    hot = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h1"))
    # doc_id and its NULL as one ordered value: NULL last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))).alias("first")
    hot_first = lines.join(F.broadcast(hot), "h1", "left_semi").groupBy("h1", "h2").agg(first)
    # at most hot_keys rows: one per hash
    marked = lines.join(F.broadcast(hot_first), ["h1", "h2"], "left")
    from_hot = marked.where(F.col("first").isNotNull()).select("doc_id", "version", "pos", F.col("first.id").alias("owner"))
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    from_rest = (marked.where(F.col("first").isNull()).select("h1", "h2", "doc_id", "version", "pos")
                 .repartitionByRange("h1", "h2")
                 .select("doc_id", "version", "pos", F.first("doc_id").over(stream).alias("owner")))
    dropped = from_hot.unionByName(from_rest).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    one = F.lit(1).cast("long")
    words = (dropped.groupBy("doc_id", "version", (F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", one, F.col("pos") % 64)).alias("gone")))
    return (words.groupBy("doc_id", "version")
            .agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
                 F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  out_col: str = "kept_text") -> DataFrame:
    """``docs`` with ``out_col`` (lines that stay, joined by newlines),
    ``n_lines`` and ``n_dropped``.  A text that loses nothing comes back as it
    was (NULL as the empty text); one that loses all lines as the empty text.
    Input columns of those names are replaced."""
    ours = [c for c in docs.columns if c not in (out_col, "n_lines", "n_dropped") or c in (id_col, text_col)]
    left = docs.select(F.struct(*ours).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("version"))
    # every word up to the last with a dropped line, so a line's bit is found by index
    gap = F.expr("""flatten(transform(keep, (w, i) -> concat(
        array_repeat(-1L, w.word - if(i = 0, -1, keep[i - 1].word) - 1), array(w.bits))))""")
    right = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("version").alias("b_version"),
                           F.col("n_dropped").alias("gone"), gap.alias("bits")).hint("shuffle_hash")
    joined = left.join(right, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("version") == F.col("b_version")), "left")
    lines = joined.withColumn("lines", F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n"))
    kept = F.expr("filter(lines, (x, i) -> coalesce(getbit(get(bits, cast(floor(i / 64) as int)), i % 64), 1) = 1)")
    out = F.when(F.col("gone").isNull(), F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return lines.select(*[F.col(f"row.`{c}`").alias(c) for c in ours if c != out_col], out.alias(out_col),
                        F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``keep_bitmaps`` applied to its own input, see ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
