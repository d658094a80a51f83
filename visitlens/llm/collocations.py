"""Phrase collocation mining by Rabin-Karp fingerprints.

1. **Blocks.**  Texts are cut into words and gathered, language by language, into
   blocks of bounded size: a dictionary of words with their counts and the words'
   numbers in text order.  Pieces are kept apart by a mark; long texts may be cut
   between pieces, as no phrase spans two.  Word counts come from the dictionaries.
2. **Fingerprints.**  With P[i] = sum of h(word j) B^j over j < i, modulo 2^64, the
   phrase of words i to i + k has the fingerprint (P[i + k] - P[i]) B^-i: one numpy
   expression for all phrases of a block.  A block compares the words of occurrences
   that share a fingerprint and hands on, once for each phrase, its fingerprint, count,
   count times a second fingerprint by another base, and a pointer to one occurrence.
3. **Aggregation.**  The shuffle adds up both sums and keeps one pointer a fingerprint.
   Fingerprints with fewer than ``min_count`` occurrences go.
4. **Verification.**  The pointers left are followed into the text: only frequent phrases
   become strings.  Most point to the first blocks, which therefore go to several groups.
   If all occurrences were of the phrase found there, the second sum is their count times
   its second fingerprint.  Where it is not, phrases have collided; then all pointers of
   that fingerprint are followed and counted by their text.

A phrase holding an infrequent pair of words is infrequent itself.  Frequent pairs are
therefore marked in a bitmap of fixed size, and longer phrases that it rules out are
not handed on.  A full bitmap would rule out less and change no result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.session import delete_path, freed_shuffles, scratch_path, settings

from .common import BATCH_ROWS, cut

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Characters a block of one language is gathered from.
BLOCK_CHARS = 4_000_000
#: Bits of the bitmap of frequent pairs: 8 MB whatever the data.
FILTER_BITS = 26

_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(r"[.,;:!?\n-\r]+|[^ \t.,;:!?\n-\r]+")
_SEPARATOR = re.compile(r"[.,;:!?\n-\r]")
_LOWER = {i: i + 32 for i in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93

_BLOCK = "block long, lang string, n long, words array<string>, counts array<long>, ids binary"
_ENTRY = "fp long, cnt long, second long, pointer long"
#: A pointer: number of the task, of its block, place in that, words of the phrase.
_TASK_BITS, _SEQUENCE_BITS, _PLACE_BITS, _SIZE_BITS = 21, 11, 27, 4
#: Pointers followed into a block at a time.
FOLLOWED = 100_000
#: Blocks are large rows: few at a time go to a row group, are decoded at a time and go to Python.
_ROW_GROUP = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
_DECODED = {"spark.sql.parquet.columnarReaderBatchSize": 2}
_SINGLE = _DECODED | {BATCH_ROWS: 1}
#: Documents that go to Python at a time.
_DOCUMENTS = {BATCH_ROWS: 1000}


def _parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut after separators."""
    at = 0
    while len(text) - at > size:
        found = _SEPARATOR.search(text, at + size)
        if not found:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


class _Gathered:
    """Words of one language on their way to a block."""

    def __init__(self) -> None:
        self.raw: defaultdict[str, int] = defaultdict()
        self.raw.default_factory = self.raw.__len__
        self.ids: list[np.ndarray] = []
        self.chars = 0
        self.raw["\n"]

    def add(self, part: str) -> None:
        tokens = _TOKEN.findall(part)
        self.ids.append(np.fromiter(map(self.raw.__getitem__, tokens), "int32", len(tokens)))
        self.ids.append(np.zeros(1, "int32"))
        self.chars += len(part) + 1

    def row(self, block: int, lang: str) -> tuple:
        """Words in lower case, most frequent first, numbered from 1; 0 stands between
        pieces.  The numbers' bytes are laid out by significance, as most are small."""
        ids, words = np.concatenate(self.ids), {}
        self.raw.default_factory = None  # it holds the dictionary, which would stay until some late collection of garbage
        to = np.array([0 if w[0] in _SEPARATORS else words.setdefault(w.translate(_LOWER), len(words) + 1) for w in self.raw], "int32")
        ids = to[ids]
        ids = ids[(ids > 0) | np.concatenate((ids[1:] > 0, [False]))]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(words) + 1, "<i4")
        rank[order + 1] = np.arange(1, len(words) + 1)
        names = np.array(list(words), dtype=object)[order]
        return block, lang, int(counts.sum()), names.tolist(), counts[order], rank[ids].view("uint8").reshape(-1, 4).T.tobytes()


def _numbers(ids: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(ids, "uint8").reshape(4, -1).T).view("<i4").ravel()


def _hashes(words: list[str]) -> np.ndarray:
    """One of 64 bits a word, 0 for the mark between pieces."""
    names = np.array(list(words), dtype=object)
    return np.concatenate((np.zeros(1, "uint64"), pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, "uint64")))


def word_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block; NULL texts have no words, a NULL language is ``und``."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: defaultdict[str, _Gathered] = defaultdict(_Gathered)
        task, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())),
                            ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                if task >= 1 << _TASK_BITS or made >= 1 << _SEQUENCE_BITS:
                    raise ValueError("more tasks, or blocks in a task, than pointers can tell apart: raise block_chars")
                row = waiting.pop(lang).row(task << _SEQUENCE_BITS | made, lang)
                made += 1
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                lang = lang.as_py()
                for part in _parts(text.as_py(), block_chars):
                    waiting[lang].add(part)
                    if waiting[lang].chars >= block_chars:
                        yield from flush([lang])
                    elif sum(g.chars for g in waiting.values()) >= 2 * block_chars:
                        yield from flush(list(waiting))
        yield from flush(list(waiting))

    return (docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
            .where("text <> ''").mapInArrow(gather, _BLOCK))


def mixed(fp: np.ndarray, lang: str, k: int) -> np.ndarray:
    """Fingerprints told apart by language and number of words, bits spread."""
    with np.errstate(over="ignore"):
        x = fp ^ (pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0] + np.uint64(k))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _marked(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype("int64")] >> (at & np.uint64(7)).astype("uint8")) & 1 == 1


def _bitmap(fps: DataFrame) -> np.ndarray:
    """Bitmap of the leading bits of column ``fp``, put together by Spark in 4 KB pieces."""
    place = F.shiftrightunsigned("fp", 64 - FILTER_BITS) + 1
    out = np.zeros((1 << FILTER_BITS) // 8, "uint8")
    for r in fps.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        start = (r["b"] - 1) * 4096
        out[start:start + 4096] = np.frombuffer(r["bits"], "uint8")[: len(out) - start]
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    return np.cumprod(out, dtype="uint64")


class Fingerprints:
    """Prefix polynomial of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        with np.errstate(over="ignore"):
            self.down = _powers(pow(base, -1, 2**64), len(hashes))
            self.prefix = np.concatenate((np.zeros(1, "uint64"), np.cumsum(hashes * _powers(base, len(hashes)), dtype="uint64")))

    def at(self, at: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[at + k] - self.prefix[at]) * self.down[at]


def entries(fp: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, count, place of one occurrence) of each phrase among the places
    ``at``: places of one fingerprint whose words differ are entries of their own."""
    order = np.argsort(fp, kind="stable")
    fp, at = fp[order], at[order]
    new = np.concatenate(([True], fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, bool)
    first = at[new][np.cumsum(new) - 1] if len(fp) else at
    if any((ids[at + j] != ids[first + j]).any() for j in range(k)):
        order = np.lexsort([ids[at + j] for j in range(k)] + [fp])
        fp, at = fp[order], at[order]
        new = np.concatenate(([True], fp[1:] != fp[:-1]))
        for j in range(k):
            new[1:] |= ids[at[1:] + j] != ids[at[:-1] + j]
    starts = np.flatnonzero(new)
    return fp[starts], np.diff(np.append(starts, len(fp))), at[starts]


def _second(hashes: np.ndarray, lang: str, at: np.ndarray, k: int) -> np.ndarray:
    """Second fingerprints, of 16 bits: times any count they fit a long."""
    return (mixed(Fingerprints(hashes, _SECOND).at(at, k), lang, k) >> np.uint64(48)).astype("int64")


def phrase_entries(blocks: DataFrame, sizes: range, pairs: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """Entries of the phrases of ``sizes`` words; of those with an unmarked pair none."""
    known = blocks.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None
    keep = np.uint64(64 - bits)

    def of_block(block: int, lang: str, ids: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, first = len(ids), Fingerprints(hashes, _BASE)
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        if known is not None:
            at = np.flatnonzero(pair)
            pair[at] = _marked(known.value, mixed(first.at(at, 2), lang, 2) >> keep)
        for k in sizes:
            if n < k:
                continue
            fits = pair[:n - k + 1].copy()
            for j in range(1, k - 1):
                fits &= pair[j:n - k + 1 + j]
            at = np.flatnonzero(fits)
            fp, cnt, at = entries(mixed(first.at(at, k), lang, k) >> keep, at, ids, k)
            pointer = np.int64(block << (_PLACE_BITS + _SIZE_BITS)) | (at << _SIZE_BITS) | k
            columns = [fp.view("int64"), cnt, cnt * _second(hashes, lang, at, k), pointer]
            for i in range(0, len(fp), 100_000):
                yield pa.record_batch([pa.array(c[i:i + 100_000]) for c in columns], ["fp", "cnt", "second", "pointer"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, words, ids in zip(*(b.column(c) for c in ("block", "lang", "words", "ids"))):
                numbers = _numbers(ids.as_py())
                if len(numbers) > 1:
                    yield from of_block(block.as_py(), lang.as_py(), numbers, _hashes(words.as_py())[numbers])

    return blocks.select("block", "lang", "words", "ids").mapInArrow(find, _ENTRY)


def frequent(found: DataFrame, min_count: int) -> DataFrame:
    """One entry a fingerprint of ``min_count`` occurrences, with the sums of both counts."""
    return (found.groupBy("fp").agg(F.sum("cnt").alias("cnt"), F.sum("second").alias("second"), F.min("pointer").alias("pointer"))
            .where(F.col("cnt") >= min_count))


def _follow(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, k, cnt, fp, longer, agrees) of entries, read where they point to."""
    def read(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(own):
            lang, words, ids = block["lang"].iloc[0], block["words"].iloc[0], _numbers(block["ids"].iloc[0])
            hashes = _hashes(words)[ids]
            own = own.assign(k=own["pointer"] % (1 << _SIZE_BITS), at=own["pointer"] // (1 << _SIZE_BITS) % (1 << _PLACE_BITS))
            for k, group in own.groupby("k"):
                at = group["at"].to_numpy()
                agrees = group["cnt"].to_numpy() * _second(hashes, lang, at, int(k)) == group["second"].to_numpy()
                out += [(lang, " ".join([words[i - 1] for i in ids[a:a + k]]), k, c, fp, k > 2, ok)
                        for a, c, fp, ok in zip(at, group["cnt"], group["fp"], agrees)]
        return pd.DataFrame(out, columns=["lang", "phrase", "k", "cnt", "fp", "longer", "agrees"])

    own = found.withColumn("block", F.shiftright("pointer", _PLACE_BITS + _SIZE_BITS))
    # a row for each block, as many as MB of text
    parts = F.broadcast(own.groupBy("block").agg(F.ceil(F.count("*") / FOLLOWED).cast("int").alias("parts")))
    own = own.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("fp", "pointer"), "parts").cast("int")).drop("parts")
    held = (blocks.select("block", "lang", "words", "ids").join(parts, "block")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    return (held.groupBy("block", "part").cogroup(own.groupBy("block", "part"))
            .applyInPandas(read, "lang string, phrase string, k int, cnt long, fp long, longer boolean, agrees boolean"))


def frequent_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                   max_words: int = MAX_WORDS, block_chars: int = BLOCK_CHARS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(words and phrases of up to ``max_words`` words that occur ``min_count`` times:
    lang, phrase, k, a; all words of each language: lang, n).  ``bits``: width of the
    fingerprints; fewer collide more and give the same result."""
    spark = docs.sparkSession
    path = scratch_path(spark, "blocks")
    with freed_shuffles(spark):
        with settings(spark, _DOCUMENTS):
            word_blocks(docs, lang_col, text_col, block_chars).write.options(**_ROW_GROUP).parquet(path)
        blocks = spark.read.schema(_BLOCK).parquet(path)
        with settings(spark, _SINGLE):
            n = cut(blocks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
            words = cut(blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
                        .groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"))
                        .where(F.col("a") >= min_count).select("lang", "phrase", F.lit(1).alias("k"), "a"))
            entered = [phrase_entries(blocks, range(2, 3), bits=bits)]
            kept = [cut(frequent(entered[0], min_count))]
            if max_words > 2:
                entered.append(phrase_entries(blocks, range(3, max_words + 1), _bitmap(kept[0]), bits))
                kept.append(cut(frequent(entered[1], min_count)))
        entered, kept = ([df.withColumn("longer", F.lit(i > 0)) for i, df in enumerate(own)] for own in (entered, kept))
        with settings(spark, _DECODED):
            read = cut(_follow(blocks, reduce(DataFrame.unionByName, kept)))
        phrases = read.where("agrees")
        collided = read.where("NOT agrees").select("fp", "longer")
        if not collided.isEmpty():
            with settings(spark, _SINGLE):
                every = cut(reduce(DataFrame.unionByName, entered).join(collided, ["fp", "longer"], "left_semi"))
            with settings(spark, _DECODED):
                phrases = phrases.unionByName(cut(_follow(blocks, every)))
        phrases = cut(phrases.groupBy("lang", "phrase", "k").agg(F.sum("cnt").alias("a")).where(F.col("a") >= min_count))
    delete_path(spark, path)
    return words.unionByName(phrases.where(F.col("k") <= max_words)), n


def _words(start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, block_chars: int = BLOCK_CHARS, bits: int = 64) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``max_words`` words with a >= ``min_count`` occurrences scores
    floor(1000 a n / (l r)) at its lowest-scoring cut, l and r being the counts of the
    two parts.  Phrases inside a longer one that is as frequent are left out: as counts
    never rise with length, looking one word further is enough.  NULL and empty texts
    count for nothing, repeated rows count each time, other columns are ignored."""
    grams, n = frequent_grams(docs, lang_col, text_col, min_count, max_words, block_chars, bits)
    found = grams.where("k > 1")
    longer = found.where("k > 2")
    inside = (longer.select("lang", _words(F.lit(1), F.col("k") - 1).alias("phrase"), F.col("a").alias("longer"))
              .unionByName(longer.select("lang", _words(F.lit(2), F.col("k") - 1).alias("phrase"), F.col("a").alias("longer")))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = found.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": _words(F.lit(1), F.col("cut")), "right": _words(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    part = grams.select("lang", "phrase", "a")
    exact = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"]).join(n, "lang")
             .withColumn("score", F.expr("CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0))"
                                         " div (CAST(l AS DECIMAL(16, 0)) * CAST(r AS DECIMAL(16, 0)))")))
    best = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
