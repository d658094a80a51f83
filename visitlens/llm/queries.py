"""Registered queries of the training-data operators: each applies one operator
with production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity as tox
from .collocations import collocations
from .common import table
from .html_text import extract_text
from .jaccard_join import jaccard_components
from .lexical_search import search
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_documents
from .packing import pack_documents
from .quality import classify, held_out, train
from .sharding import BASE_SHARDS, assign_shards, tree_for
from .vector_dedup import near_duplicates
from .vector_topk import top_k

#: A document is predicted good from this score on.
QUALITY_FLOOR = 0.3
#: A document is predicted toxic from this score on.
TOXIC_FLOOR = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by boosted trees."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (classify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= QUALITY_FLOOR, 1).otherwise(0).alias("predicted")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line de-duplication of all documents, digest of the lines kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to 24 shards by the hash tree, and to 25."""
    return (assign_shards(table(spark, sf_dir, "documents"), tree_for(BASE_SHARDS), tree_for(BASE_SHARDS + 1))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best partners of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes from each document."""
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by significant passages."""
    docs = table(spark, sf_dir, "documents")
    model = tox.train(docs, table(spark, sf_dir, "labels"))
    return (tox.toxicity(docs.select("doc_id", "text"), model)
            .select("doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= TOXIC_FLOOR, 1).otherwise(0).alias("predicted"),
                    F.size("passages").alias("n_passages")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_line_dedup, op3_vector_dedup, op4_packing, op5_sharding, op6_license_scan,
                            op7_jaccard_join, op8_vector_topk, op9_mixing, op10_html_text, op11_toxicity,
                            op12_collocations, op13_lexical_search)
}

_LINE_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_LINE_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS w
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k))),
counted AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, k, w HAVING count(*) >= 100),
inside AS (
  SELECT lang, w, max(a) AS longer
  FROM (SELECT lang, w[1:k - 1] AS w, a FROM counted WHERE k > 2 UNION ALL SELECT lang, w[2:k], a FROM counted WHERE k > 2) GROUP BY lang, w),
kept AS (SELECT c.* FROM counted c LEFT JOIN inside i ON c.lang = i.lang AND c.w = i.w WHERE c.k > 1 AND (i.longer IS NULL OR i.longer < c.a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n, CAST(1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c JOIN sizes s ON s.lang = c.lang
  JOIN counted l ON l.lang = c.lang AND l.w = c.w[1:c.cut] JOIN counted r ON r.lang = c.lang AND r.w = c.w[c.cut + 1:c.k]),
best AS (SELECT lang, phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""",
    "op13_lexical_search": rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
sized AS (SELECT doc_id, d, t, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(t) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op9_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, ''))) AS place
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         (source_size * 2)::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget FROM sizes),
ranked AS (SELECT *, cap / weight AS ratio, sum(weight) OVER () AS all_weight FROM weighed),
levels AS (
  SELECT *, row_number() OVER o AS nth,
         (budget - coalesce(sum(cap) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked
  WINDOW o AS (ORDER BY ratio, source NULLS LAST),
         b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least(cap, h.level * weight), cap) AS target FROM levels, held h),
queued AS (
  SELECT d.*, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
         row_number() OVER (PARTITION BY d.source ORDER BY place, doc_id, size) AS nth
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
events AS (
  SELECT source, nth, size, place, pass, cum / target + pass * (source_size / target) AS due
  FROM queued, (VALUES (0), (1)) p(pass) WHERE target > 0 AND size > 0),
served AS (
  SELECT source, nth, sum(size) OVER (ORDER BY due, source NULLS LAST, pass, place, nth ROWS UNBOUNDED PRECEDING) AS until FROM events),
taken AS (SELECT source, nth, count(*) AS passes FROM served WHERE until <= (SELECT sum(target) FROM targets) + 1e-6 GROUP BY source, nth)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.passes, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.source IS NOT DISTINCT FROM t.source AND q.nth = t.nth""",
}
