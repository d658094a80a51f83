"""N-gram Jaccard join by PartEnum signatures.

Sets are the distinct word shingles of a text, as 64-bit hashes.  Set sizes
fall into bands whose ends differ by at most the similarity, so two linked
sets lie in one band or in neighbours; a set takes part in its own band and
the next.  In a band, linked sets differ in at most k features.  The feature
domain is cut into P > k ranges; the differences touch at most k of them, so
two linked sets agree on whole ranges, and a range's content is a signature:
a feature subset that similar sets share.  P exceeds k by half, so a linked
pair agrees on at least m = P - k ranges, and a set may leave out its m - 1
least selective signatures (empty ranges first, then those that very many
sets share) without losing a link.

Signatures are met in buckets: a block of 32-bit signatures per input batch
and bucket, cut by hash, with as many buckets as the number of signatures
asks for.  A block holds 40 bits of its set's key beside each signature, so it
is as large in many buckets as in few; sets that agree in those bits are
candidates themselves.  A signature that many sets of one batch share is sent
once, with a mark.  Then

* groups of up to ``SMALL`` sets give all their pairs, and a pair stays if it
  shares more of them than both sets could have left out;
* larger groups matter only to sets whose signatures are so common that they
  cannot leave them all out (members of large groups of near copies).  Those
  keep their rarest ones, and sets connected by these form a region.  All sets
  of a large region are first compared with a few of them, the pivots; what these
  do not connect is compared chunk by chunk.

A pair whose parities over 512 cells of the feature domain differ more often than
linked sets differ in features is out, before any set is read again.  Every other
pair is verified on the whole sets; one that is already connected need not be, as
the result are components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut
from .components import connected_components

WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
SMALL = 32
#: Signatures of a bucket, on average; of a batch of blocks, at least.
BUCKET_SIGNATURES = 4_000_000
BATCH_SIGNATURES = 1_500_000
#: Sets in one batch that share a signature before it is sent once for all.
COMMON = 64
#: Texts or sets that a worker is handed at a time.
BATCH_ROWS = 1000
#: Sets of a region that are compared with as many others in one row, and their features.
CHUNK = 512
CHUNK_FEATURES = 1_000_000
#: Sets of a large region that all others are compared with first.
PIVOTS = 8
#: Cells of the parities that rule pairs out before sets are read again.
PARITY_CELLS = 512
#: Bits of a set's key that stand beside a signature.
KEY_BITS = 40
#: Ids (of sets to verify, of rows to drop) that are broadcast to pick texts; beyond, a shuffle join.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_STEP = _U(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS.encode())] = True
with np.errstate(over="ignore"):
    _CODE = np.where(_IS_BLANK, _U(0), _mix((np.arange(256, dtype=_U) + _U(1)) * _STEP) | _U(1))
    _TURN = _mix((np.arange(64, dtype=_U) + _U(977)) * _STEP) | _U(1)
_POWERS = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(max(n, 64), _U(0xD6E8FEB86659FD93)))))
    return _POWERS


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text: of
    the whole sequence where it is shorter, empty where there is no word."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    codes = np.frombuffer(data, "uint8")
    blank = _IS_BLANK[codes]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(codes) else np.zeros(0, int)
    n = len(starts)
    if not n:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        sizes = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.concatenate((np.zeros(starts[0], int), np.repeat(starts, sizes)))
        place[blank] = 0
        word = _mix(np.add.reduceat(_CODE[codes] * _powers(int(place.max()) + 1)[place], starts))
        if n < words:
            turns = _TURN[:n]
            return _mix(np.array([(word * turns).sum(dtype=_U) + _U(n) * _STEP], _U))
        total = np.zeros(n - words + 1, _U)
        for i in range(words):
            total += word[i:n - words + 1 + i] * _TURN[32 + i % 32]
        return np.unique(_mix(total))


class Band:
    """Sizes ``low`` to ``high``, at most ``k`` differences, ``parts`` ranges."""

    def __init__(self, number: int, low: int, percent: int):
        self.number, self.low = number, low
        self.high = max(low, low * 100 // percent)
        self.k = differences(self.high, self.high, percent)
        self.parts = (3 * (self.k + 1) + 1) // 2 + 2
        self.ends = np.array([i * 2**64 // self.parts for i in range(1, self.parts)], _U)
        with np.errstate(over="ignore"):
            self.salt = _mix((np.arange(self.parts, dtype=_U) + _U(number << 32)) * _STEP)


def differences(a: int, b: int, percent: int) -> int:
    """Most features in which linked sets of sizes a and b differ:
    I / (a + b - I) >= p bounds a + b - 2 I by (1 - p) / (1 + p) (a + b)."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple[Band, ...]:
    out, low = [], 1
    while low <= upto:
        out.append(Band(len(out), low, percent))
        low = out[-1].high + 1
    return tuple(out)


def signatures(features: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(band, slack, signatures) for a set's own band and, if it can have a
    larger partner there, the next.  ``slack``: how many of the signatures it
    may leave out besides its empty ranges."""
    n = len(features)
    if not n:
        return []
    partner = n * 100 // percent  # the largest set it can be linked with
    every = bands(percent, 1 << max(10, (2 * partner).bit_length()))
    own = next(b for b in every if b.low <= n <= b.high)
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_mix(features + _STEP), dtype=_U)))
        for band in (own, every[own.number + 1]):
            if band.low > partner:
                continue
            cuts = np.concatenate(([0], np.searchsorted(features, band.ends), [n]))
            full = cuts[1:] > cuts[:-1]
            found = _mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ band.salt)
            m = band.parts - min(band.k, differences(n, min(band.high, partner), percent))
            empty = band.parts - int(full.sum())
            # only where there are m empty ranges can they be all that a pair agrees on
            out.append((band.number, m - 1 - empty, found[full]) if empty < m else (band.number, 0, found))
    return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes laid out by significance."""
    return x.astype("<u4").view("uint8").reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "uint8").reshape(4, -1).T).view("<u4").ravel()


def _key(features: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(features.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def describe_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: ``doc_id, n, k1, k2`` (key of the set) and, for its own and the
    next band, ``slack0, slack1``; ``found``: the number of its signatures;
    ``parity``: see ``parity``."""
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                f = shingle_set(text if isinstance(text, str) else None, words)
                s = signatures(f, percent)
                out.append((doc_id, len(f), *_key(f), s[0][0] if s else 0, s[0][1] if s else 0, s[1][1] if len(s) > 1 else 0,
                            sum(len(x[2]) for x in s), parity(f, PARITY_CELLS).tobytes()))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "band", "slack0", "slack1", "found", "parity"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.mapInPandas(describe, "doc_id long, n long, k1 long, k2 long, band int, slack0 int, slack1 int, found long, parity binary")


def signature_blocks(docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Blocks of signatures by bucket, by rising signature (``found``: the steps),
    with the key (``low``, ``high``) and band of the set of each, and which are
    ``common``.  Rows without ``high`` hold the sets (``low``: whole keys, ``bands``) of
    one common signature (``found``) of a batch; they may lie in any bucket."""
    schema = "bucket int, low binary, high binary, bands binary, found binary, common binary"

    def flush(keys: list[int], band: list[int], parts: list[np.ndarray]) -> pd.DataFrame:
        entry_key, entry_band = np.array(keys, "int64") & ((1 << KEY_BITS) - 1), np.array(band, "uint8")
        entry = np.repeat(np.arange(len(parts), dtype="int32"), [len(p) for p in parts])
        sig = np.concatenate(parts)
        order = np.argsort(sig, kind="stable")
        sig, entry = sig[order], entry[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        rows, drop, common = [], np.zeros(len(sig), bool), np.zeros(len(sig), bool)
        for at, n in zip(first[size >= COMMON].tolist(), size[size >= COMMON].tolist()):
            members = entry[at:at + n]
            anywhere = (int(sig[at]) ^ int(entry_key[members[0]])) % buckets
            rows.append((anywhere, entry_key[members].tobytes(), b"", entry_band[members].tobytes(), sig[at:at + 1].tobytes(), b""))
            drop[at + 1:at + n] = True
            common[at] = True
        sig, entry, common = sig[~drop], entry[~drop], common[~drop]
        bucket = ((sig >> _U(32)) * _U(buckets)) >> _U(32)  # rises with the signature
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(sig) else np.zeros(1, int)
        for lo, hi in zip(edge[:-1], edge[1:]):
            part = (sig[lo:hi] & _U(0xFFFFFFFF)).astype("uint32")
            order = np.argsort(part, kind="stable")
            e, part = entry[lo:hi][order], part[order]
            key = entry_key[e]
            rows.append((int(bucket[lo]), _planes(key & 0xFFFFFFFF), (key >> 32).astype("uint8").tobytes(), entry_band[e].tobytes(),
                         _planes(np.diff(part, prepend=np.uint32(0))),
                         (sig[lo:hi][common[lo:hi]] & _U(0xFFFFFFFF)).astype("uint32").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "low", "high", "bands", "found", "common"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # copies in this task's rows
        keys: list[int] = []
        band: list[int] = []
        parts: list[np.ndarray] = []
        total = 0
        for b in batches:
            for text in b["text"]:
                f = shingle_set(text if isinstance(text, str) else None, words)
                key = _key(f)
                if not len(f) or key in seen:
                    continue
                seen.add(key)
                for number, _, found in signatures(f, percent):
                    keys.append(key[0])
                    band.append(number)
                    parts.append(found)
                    total += len(found)
                if total >= BATCH_SIGNATURES:
                    yield flush(keys, band, parts)
                    keys, band, parts, total = [], [], [], 0
        if parts:
            yield flush(keys, band, parts)

    return docs.select("text").mapInPandas(emit, schema)


def _unpack(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([_numbers(x).astype("int64") | np.frombuffer(y, "uint8").astype("int64") << 32 for x, y in zip(block["low"], block["high"])])
    bands_ = np.concatenate([np.frombuffer(x, "uint8") for x in block["bands"]])
    return keys, bands_, np.concatenate([np.cumsum(_numbers(x), dtype="uint32") for x in block["found"]])


_MET = "a long, b long, band int, gid long, hits long"


def meet(buckets: int):
    """What a bucket's blocks give, as rows of ``_MET``."""
    def of_bucket(key: tuple[Any, ...], block: pd.DataFrame) -> pd.DataFrame:
        whole = block["high"].str.len() == 0
        out = [common_members(block[whole], buckets)] + ([met_pairs(key[0], block[~whole])] if not whole.all() else [])
        return pd.concat(out, ignore_index=True)

    return of_bucket


def met_pairs(bucket: int, block: pd.DataFrame) -> pd.DataFrame:
    """Pairs of small groups (``a, b, band`` and their ``hits``, the groups they
    share) and members of large ones (``a, band`` and the group ``gid``) of one
    bucket."""
    keys, band, sig = _unpack(block)
    common = np.unique(np.concatenate([np.frombuffer(x, "uint32") for x in block["common"]] + [np.zeros(0, "uint32")]))
    # only signatures that occur more than once, or elsewhere, matter
    order = np.argsort(sig, kind="stable")
    sorted_sig = sig[order]
    same = sorted_sig[1:] == sorted_sig[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    twice |= np.isin(sorted_sig, common)
    order = order[twice]
    keys, band, sig = keys[order], band[order], sig[order]
    order = np.lexsort((keys, sig))
    keys, band, sig = keys[order], band[order], sig[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (keys[1:] != keys[:-1]))) if len(sig) else np.zeros(0, bool)
    keys, band, sig = keys[new], band[new], sig[new]  # copies from different batches
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, int)
    size = np.diff(np.append(first, len(sig)))
    large = (size > SMALL) | np.isin(sig[first], common)
    low, high = [np.zeros(0, int)], [np.zeros(0, int)]
    for n in range(2, SMALL + 1):
        at = first[(size == n) & ~large]
        for i in range(n):
            for j in range(i + 1, n):
                low.append(at + i)
                high.append(at + j)
    i, j = np.concatenate(low), np.concatenate(high)
    i, j = i[band[i] == band[j]], j[band[i] == band[j]]
    order = np.lexsort((band[i], keys[j], keys[i]))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[i[1:]] != keys[i[:-1]]) | (keys[j[1:]] != keys[j[:-1]])
                                         | (band[i[1:]] != band[i[:-1]])))) if len(i) else np.zeros(0, int)
    hits, i, j = np.diff(np.append(new, len(i))), i[new], j[new]
    member = np.repeat(large, size)
    gid = (np.int64(bucket) << np.int64(32)) | sig[member].astype("int64")
    return pd.DataFrame({"a": np.concatenate((keys[i], keys[member])),
                         "b": np.concatenate((keys[j], np.zeros(member.sum(), "int64"))),
                         "band": np.concatenate((band[i], band[member])).astype("int32"),
                         "gid": np.concatenate((np.full(len(i), -1), gid)),
                         "hits": np.concatenate((hits, np.zeros(member.sum(), "int64")))})


def common_members(block: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Members of the common signatures of batches, with their group."""
    out = [np.zeros((4, 0), "int64")]
    for keys, band, found in zip(block["low"], block["bands"], block["found"]):
        sig = int(np.frombuffer(found, _U)[0])
        gid = ((sig >> 32) * buckets >> 32) << 32 | sig & 0xFFFFFFFF
        a = np.frombuffer(keys, "int64")
        out.append(np.stack([a, np.zeros(len(a), "int64"), np.frombuffer(band, "uint8").astype("int64"), np.full(len(a), gid)]))
    a, b, band, gid = np.concatenate(out, axis=1)
    return pd.DataFrame({"a": a, "b": b, "band": band.astype("int32"), "gid": gid, "hits": np.zeros(len(a), "int64")})


def parity(features: np.ndarray, cells: int) -> np.ndarray:
    """The parity of a set's number of features in each cell, as 64-bit words.  Two
    sets' parities differ in at most as many cells as the sets in features."""
    return np.packbits(np.bincount((features >> _U(5)).astype("int64") & (cells - 1), minlength=cells).astype("uint8") & 1).view(_U)


def _may_link(percent: int):
    """Whether sets of these sizes and parities can be linked."""
    @F.pandas_udf("boolean")
    def may(n: pd.Series, n2: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
        words = [np.frombuffer(b"".join(x), _U).reshape(-1, PARITY_CELLS // 64) for x in (one, two)]
        return pd.Series(np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype="int64") <= differences(n.to_numpy(), n2.to_numpy(), percent))

    return may


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) set keys to linked (x, y) node ids, by the whole sets."""
    left = sets.select("a", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("features").alias("fx"))
    right = sets.select(F.col("a").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("features").alias("fy"))
    sized = (pairs.join(left.drop("fx"), "a").join(right.drop("fy"), "b")
             .where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
             .where("x <> y").select("a", "b").distinct())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for fx, fy in zip(b["fx"], b["fy"]):
                u, v = np.frombuffer(fx, _U), np.frombuffer(fy, _U)
                both = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.loc[keep, ["x", "y"]]

    return (sized.join(left, "a").join(right, "b").where("x <> y").select("x", "fx", "y", "fy")
            .mapInPandas(compare, "x long, y long").distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` - the
    smallest id reachable by links of similarity ``percent`` / 100 or more.

    NULL, empty and blank texts have no shingles and stand alone, as do rows
    with a NULL id (component NULL).  Rows that repeat an id are one document
    for the links of all their texts.  Equal sets are linked.  Empty input
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = cut(describe_sets(rows, words, percent), BATCH_ROWS)
    named = described.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # one node per distinct set: its smallest id
    nodes = cut(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("band").alias("band"),
                                              F.max("slack0").alias("slack0"), F.max("slack1").alias("slack1"),
                                              F.max("found").alias("found"), F.max("parity").alias("parity"))
                .withColumn("a", F.col("k1").bitwiseAND(F.lit((1 << KEY_BITS) - 1))))
    total = nodes.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_SIGNATURES))
    blocks = signature_blocks(rows.where(F.col("doc_id").isNotNull()), buckets, words, percent)
    met = cut(blocks.groupBy("bucket").applyInPandas(meet(buckets), _MET), BATCH_ROWS)
    members = met.where("gid >= 0").select("a", "band", "gid").distinct()

    # a linked pair agrees on more than slack signatures; those not in a small group are in a large one
    per_band = (nodes.select("a", F.explode(F.array(
        F.struct(F.col("band").alias("band"), F.col("slack0").alias("slack")),
        F.struct((F.col("band") + 1).alias("band"), F.col("slack1").alias("slack")))).alias("s"))
        .groupBy("a", "s.band").agg(F.min("s.slack").alias("slack")))
    large = members.groupBy("a", "band").agg(F.count("*").alias("large"))
    spare = cut(per_band.join(large, ["a", "band"], "left")
                .select("a", "band", (F.col("slack") - F.coalesce("large", F.lit(0))).alias("spare"), "large"))
    other = spare.select(F.col("a").alias("b"), "band", F.col("spare").alias("spare2"))
    small = (met.where("gid < 0").groupBy("a", "b", "band").agg(F.sum("hits").alias("hits"))
             .join(spare.drop("large"), ["a", "band"]).join(other, ["b", "band"])
             .where("hits > spare AND hits > spare2").select("a", "b").distinct())
    alike = nodes.groupBy("a").agg(F.count("*").alias("sets")).where("sets > 1").select("a", F.col("a").alias("b"))
    side = nodes.select("a", "n", "parity")
    small = cut(small.unionByName(alike).join(side, "a").join(side.toDF("b", "n2", "parity2"), "b")
                .where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
                .where(_may_link(percent)("n", "n2", "parity", "parity2")).select("a", "b").distinct())

    # members of large groups that cannot do without them keep their rarest
    sizes = members.groupBy("gid").agg(F.count("*").alias("size"))
    heavy = cut(members.join(spare.where("spare < 0"), ["a", "band"]).join(sizes, "gid")
                .withColumn("nth", F.row_number().over(Window.partitionBy("a", "band").orderBy("size", "gid")))
                .where(F.col("nth") <= -F.col("spare")).select("a", "gid"))
    sets = _sets(rows, nodes, small.select("a").unionByName(small.select(F.col("b").alias("a")))
                 .unionByName(heavy.select("a")).distinct(), words)
    links = cut(verify(small, sets, percent).unionByName(_links_of_groups(heavy, sets, percent)), BATCH_ROWS)
    classes = cut(connected_components(links, "x", "y"))
    to_class = nodes.join(classes, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return (described.join(to_class, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
                    .alias("component_id")))


def _links_of_groups(heavy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): links that span the components of sets that share large groups.

    Sets connected by such groups form a region.  A region of one chunk is compared
    whole.  In a larger one all sets meet a few pivots, one row a chunk: sets that are
    linked to the same pivot, or to pivots that some set connects, have one label.
    That leaves few labels where most sets are copies of one text; then chunks of
    different labels meet.  A meeting sends on a spanning forest of its links.
    """
    star = (heavy.join(heavy.groupBy("gid").agg(F.min("a").alias("center")), "gid").where("a <> center")
            .select("a", "center").distinct())
    regions = cut(connected_components(star, "a", "center").select(F.col("node").alias("a"), F.col("component").alias("region")))
    members = cut(sets.select("a", "node", "n").join(regions, "a").select("region", "node", "n"))
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_FEATURES)).cast("int")
    sizes = members.groupBy("region").agg(chunks.alias("chunks"))
    keys = members.join(sizes, "region").select("region", "chunks", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("string").alias("cell"))
    packed = cut(_packed(sets.join(keys, "node").withColumns({"label": F.col("node"), "pure": F.col("chunks").cast("long")})))
    whole = packed.where("pure = 1").mapInPandas(_meeting(percent), "x long, y long")

    large = packed.where("pure > 1")
    first = Window.partitionBy("region").orderBy("h", "node")
    pivots = (large.select("region", "nodes", "sizes", "features").mapInPandas(_smallest, "region long, h long, node long, n long, features binary")
              .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PIVOTS))
    pivots = _packed(pivots.withColumns({"cell": F.lit("pivots"), "label": F.col("node"), "pure": F.lit(None).cast("long")}))
    met = cut(large.join(_other(pivots), "region").select("region", *_SIDE, "nodes2", "labels2", "sizes2", "features2")
              .mapInPandas(_meeting(percent, "region"), "region long, x long, y long"))
    least = met.groupBy("region", "x").agg(F.min("y").alias("pivot"))
    joined = (met.join(least, ["region", "x"]).select("region", F.col("pivot").alias("p"), F.col("y").alias("q"))
              .unionByName(met.select("region", F.col("y").alias("p"), F.col("y").alias("q"))).distinct())
    # at most a row per two pivots of a region
    roots = joined.groupBy("region").applyInPandas(_roots, "region long, pivot long, root long")
    label = F.coalesce("root", "node")
    classes = cut(members.join(sizes.where("chunks > 1").select("region"), "region").select("region", "node")
                  .join(least.withColumnRenamed("x", "node"), ["region", "node"], "left").join(roots, ["region", "pivot"], "left")
                  .select("region", "node", label.alias("label")))

    # cells of one label where it fills some, else of several small ones
    counts = classes.groupBy("region", "label").agg(F.count("*").alias("sets"))
    apart = counts.groupBy("region").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("sets") <= CHUNK // 4, F.col("sets"))).alias("small")).where("labels > 1")
    full = F.col("sets") > CHUNK // 4
    cell = F.when(full, F.concat_ws("/", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("sets") / CHUNK)).cast("string"))) \
            .otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / CHUNK)).cast("string"))
    keys = (classes.join(counts, ["region", "label"]).join(apart, "region")
            .select("region", "node", "label", cell.alias("cell"), F.when(full, F.col("label")).alias("pure")))
    rest = large.join(apart.select("region"), "region").select("nodes", "sizes", "features").mapInPandas(_unpacked, "node long, n long, features binary")
    cells = cut(_packed(rest.join(keys, "node")))
    card = cells.select("region", "cell", "pure")
    meetings = (card.join(card.toDF("region", "cell2", "pure2"), "region")
                .where("cell <= cell2 AND NOT (pure IS NOT NULL AND pure <=> pure2)").select("region", "cell", "cell2"))
    across = (meetings.join(cells, ["region", "cell"]).join(_other(cells), ["region", "cell2"])
              .mapInPandas(_meeting(percent), "x long, y long"))
    return whole.unionByName(met.select("x", "y")).unionByName(across)


_SIDE = ["cell", "nodes", "labels", "sizes", "features"]
_PACKED = "region long, cell string, pure long, nodes binary, labels binary, sizes binary, features binary"


def _packed(placed: DataFrame) -> DataFrame:
    """One row per (region, cell) with all its sets; ``pure`` is the same for all of them."""
    def pack(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        raw = lambda c: frame[c].to_numpy("int64").tobytes()
        pure = None if pd.isna(frame["pure"].iloc[0]) else int(frame["pure"].iloc[0])
        return pd.DataFrame({"region": [key[0]], "cell": [key[1]], "pure": pd.array([pure], "Int64"), "nodes": [raw("node")], "labels": [raw("label")],
                             "sizes": [raw("n")], "features": [b"".join(frame["features"])]})

    return placed.select("region", "cell", "pure", "node", "label", "n", "features").groupBy("region", "cell").applyInPandas(pack, _PACKED)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of packed rows."""
    for b in batches:
        for nodes, sizes, features in zip(b["nodes"], b["sizes"], b["features"]):
            yield pd.DataFrame({"node": np.frombuffer(nodes, "int64"), "n": np.frombuffer(sizes, "int64"),
                                "features": [f.tobytes() for f in _split(sizes, features)]})


def _smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ``PIVOTS`` sets of each packed row that come first by hash."""
    for b in batches:
        for region, nodes, sizes, features in zip(b["region"], b["nodes"], b["sizes"], b["features"]):
            node, n, own = np.frombuffer(nodes, "int64"), np.frombuffer(sizes, "int64"), _split(sizes, features)
            with np.errstate(over="ignore"):
                h = _mix(node.view(_U) + _STEP).view("int64")
            at = np.argsort(h, kind="stable")[:PIVOTS]
            yield pd.DataFrame({"region": region, "h": h[at], "node": node[at], "n": n[at], "features": [own[i].tobytes() for i in at]})


def _roots(edges: pd.DataFrame) -> pd.DataFrame:
    """(region, pivot, root): the smallest pivot that edges between pivots lead to."""
    root = {p: p for p in edges["p"].tolist() + edges["q"].tolist()}
    for _ in root:
        for p, q in zip(edges["p"].tolist(), edges["q"].tolist()):
            root[p] = root[q] = min(root[p], root[q])
    return pd.DataFrame({"region": edges["region"].iloc[0], "pivot": list(root), "root": list(root.values())})


def _other(packed: DataFrame) -> DataFrame:
    """Packed rows as the other side of a meeting."""
    return packed.select("region", *[F.col(c).alias(f"{c}2") for c in _SIDE])


def _meeting(percent: int, *keep: str):
    """Links of each row's sets with those of the other side or, without one or with
    itself, among each other, beside the columns ``keep``.  Without a cell of its own the
    other side is one of pivots: all links with them count, also of a set with several."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                one = "nodes2" not in r or r.get("cell2") == r["cell"]
                x, mine, label = np.frombuffer(r["nodes"], "int64"), _split(r["sizes"], r["features"]), np.frombuffer(r["labels"], "int64")
                if one:
                    y, found = x, spanning_links(mine, None, percent, label)
                else:
                    y, theirs = np.frombuffer(r["nodes2"], "int64"), _split(r["sizes2"], r["features2"])
                    if "cell2" in r:
                        found = spanning_links(mine, theirs, percent, label, np.frombuffer(r["labels2"], "int64"))
                    else:
                        found = [(i, k) for k, t in enumerate(theirs) for i, _ in spanning_links(mine, [t], percent)]
                links = [(i, k) for i, k in found if x[i] != y[k]]
                yield pd.DataFrame({**{c: r[c] for c in keep}, "x": x[[i for i, _ in links]], "y": y[[k for _, k in links]]},
                                   columns=[*keep, "x", "y"]).astype("int64")

    return compare


def _split(sizes: bytes, features: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(features, _U), np.cumsum(np.frombuffer(sizes, "int64"))[:-1])


def spanning_links(mine: list[np.ndarray], theirs: list[np.ndarray] | None, percent: int,
                   labels: np.ndarray | None = None, labels2: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of verified links that span all links of two lists of sets,
    or of one where ``theirs`` is None, of sets with different labels where there
    are labels.  Pairs whose parities differ too often
    are out; of the rest those not yet connected are compared in full."""
    one = theirs is None
    theirs = mine if one else theirs
    p, q = (np.array([parity(f, 2048) for f in side]) for side in (mine, theirs))
    a, b = np.array([len(f) for f in mine]), np.array([len(f) for f in theirs])
    limit = (a[:, None] + b[None, :]) * (100 - percent) // (100 + percent)
    open_ = np.array([np.bitwise_count(q ^ x).sum(axis=1, dtype="int64") for x in p]) <= limit
    if one:
        open_ = np.triu(open_, 1)
    label = np.arange(len(mine) if one else len(mine) + len(theirs))
    if labels is not None:
        label = np.unique(labels if one else np.concatenate((labels, labels2)), return_inverse=True)[1]
    shift, found = 0 if one else len(mine), []
    while True:
        open_ &= label[:len(mine), None] != label[None, shift:shift + len(theirs)]
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return found
        for i, j in zip(rows.tolist(), open_[rows].argmax(axis=1).tolist()):
            if label[i] == label[shift + j]:
                continue
            open_[i, j] = False
            both = len(np.intersect1d(mine[i], theirs[j], assume_unique=True))
            if 100 * both >= percent * (len(mine[i]) + len(theirs[j]) - both):
                found.append((i, j))
                lo, hi = sorted((label[i], label[shift + j]))
                label[label == hi] = lo


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(a, node, n, features) of the sets to verify, read from their texts again."""
    chosen = cut(nodes.join(wanted, "a").select("a", "k1", "k2", "node"))
    side = chosen.withColumnRenamed("node", "doc_id")
    texts = rows.join(F.broadcast(side) if chosen.count() <= BROADCAST_IDS else side, "doc_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, text, k1, k2 in zip(b["doc_id"], b["text"], b["k1"], b["k2"]):
                f = shingle_set(text if isinstance(text, str) else None, words)
                if _key(f) == (k1, k2):
                    out.append((k1 & ((1 << KEY_BITS) - 1), node, len(f), f.tobytes()))
            yield pd.DataFrame(out, columns=["a", "node", "n", "features"])

    return cut(texts.select("doc_id", "text", "k1", "k2").mapInPandas(read, "a long, node long, n long, features binary"), BATCH_ROWS)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near
    copies does: those with the group's smallest id.  Rows with a NULL id
    stay; of rows that repeat a kept id all stay."""
    gone = cut(jaccard_components(docs, id_col, text_col, **params).where("doc_id <> component_id")
               .select(F.col("doc_id").alias("gone_id")).distinct())
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return (own.join(side, F.col("own_id") == F.col("gone_id"), "left_anti")
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
