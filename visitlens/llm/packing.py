"""Vector best-fit packing of tokenised documents into fixed-size sequences.

A sequence is a bin with three capacities: tokens, documents and attention
cost (the sum of squared piece lengths, what block-diagonal attention costs).
Pieces are placed in order of falling length; among the open bins whose
residual holds the piece in *every* dimension, the one with the smallest
weighted norm of the residual left after placing it wins, and a new bin opens
only if none fits.

Tokenising runs where the text is read and sends on one small row per piece.
Pieces are dealt into groups of about ``group_pieces`` by a hash of their
running number, so a group is bounded whatever the ids are, and each group is
packed by one task; only the last few bins of a group stay partly empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
#: These two cost no sequence: no 1024 tokens are more documents or attention.
#: They weigh in the choice of a bin; smaller ones given by a caller do bind.
MAX_DOCS = 1024
MAX_ATTENTION = 1024 * 1024
#: Weights of the residual's dimensions (tokens, documents, attention).
WEIGHTS = (1.0, 0.01, 0.05)
GROUP_PIECES = 16_384
END_ID = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Special strings of the vocabulary and their ids.
SPECIAL = {"<|endoftext|>": 50256}
LONG_BLANK = 100_000
_LONG_BLANK = re.compile(rf"(?<!\s)\s{{{LONG_BLANK},}}+")

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """Byte-level BPE over a public ranks file, one per worker process.

    The ids are those of the same vocabulary's ``tokenizers`` file (a test
    compares both over all code points); this form of it is the faster one."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _other_encoder(path: str):
    """The same vocabulary's ``tokenizers`` file, beside the ranks file."""
    path = path.removesuffix(".tiktoken") + ".json"
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path] = Tokenizer.from_file(path)
    return _ENCODERS[path]


def token_ids(text: str | None, path: str | None = None, end_id: int = END_ID, special: bool = False) -> np.ndarray:
    """Ids of a whole text and the end id, as little-endian unsigned 32 bits.
    ``special``: special strings in the text have their own ids, as a plain
    call of ``tokenizers`` gives; else they are ordinary text.

    The ranks' splitter runs out of stack on some million blanks in a row;
    texts that hold a long run of them take the vocabulary's other file."""
    text, path = text or "", path or vocabulary_path()
    if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
        encoder = _other_encoder(path)
        encoder.encode_special_tokens = not special
        ids = encoder.encode(text, add_special_tokens=False).ids
    elif special:
        ids = _encoder(path).encode(text, allowed_special="all")
    else:
        ids = _encoder(path).encode_ordinary(text)
    return np.array(ids + [end_id], dtype="<u4")


def piece_bounds(length: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``length`` ids; the first may be shorter."""
    first = length % max_tokens or max_tokens
    ends = range(first, length + 1, max_tokens)
    return [(max(0, e - max_tokens) if e > first else 0, e) for e in ends]


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, with
    ``with_ids``, the token ids themselves (``ids``).

    Only documents longer than ``max_tokens`` are cut.  NULL and empty texts
    are the end id alone.  Ids may be NULL or repeat: every row is cut by
    itself.  Empty input gives no rows; other columns are ignored.
    """
    schema = PIECE_SCHEMA + (", ids array<long>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(text if isinstance(text, str) else None, path, end_id, special=True)
                for n, (lo, hi) in enumerate(piece_bounds(len(ids), max_tokens)):
                    part = ids[lo:hi]
                    out.append((doc_id, n, lo, hi - lo, zlib.crc32(part.tobytes())) + ((part.astype("int64"),) if with_ids else ()))
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .select(F.col("doc_id").alias("doc_id"), "text").mapInPandas(cut, schema))


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS
             ) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, see the module's text.

    Pieces of full length never share a bin and are placed without a search;
    bins too full for the shortest piece leave the search.  Ties go to the
    older bin, equal pieces keep their order."""
    cap = np.array(capacity, dtype="int64")
    scale = np.array(weights, dtype="float64") / cap.astype("float64") ** 2
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    alone = int((lengths == cap[0]).sum())
    bins[order[:alone]] = np.arange(alone)
    if len(order) > alone and lengths[order[-1]] ** 2 > cap[2]:
        raise ValueError("a piece's attention cost exceeds the capacity of an empty sequence")
    opened, least = alone, int(lengths[order[-1]]) if len(order) else 0
    room = np.empty((1024, 3), "int64")  # residuals of the open bins, oldest first
    name = np.empty(1024, "int64")
    used = 0
    for n, i in enumerate(order[alone:].tolist()):
        size = int(lengths[i])
        need = np.array([size, 1, size * size])
        best = -1
        if used:
            left = room[:used] - need
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                best = int(fits[np.argmin((left[fits].astype("float64") ** 2) @ scale)])
        if best < 0:
            if used == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            room[used], name[used], best = cap, opened, used
            used, opened = used + 1, opened + 1
        bins[i], offsets[i] = name[best], cap[0] - room[best, 0]
        room[best] -= need
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < least * least:
            room[best:used - 1], name[best:used - 1] = room[best + 1:used].copy(), name[best + 1:used].copy()
            used -= 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, groups: int, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS,
                max_attention: int = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (place in the sequence,
    gapless from 0).  Every input column comes back; columns of those two
    names, ``pack_group`` and ``pack_n`` are replaced or reserved."""
    own = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "pack_group", "pack_n")]
    dealt = (pieces.select(*[f.name for f in own]).withColumn("pack_n", F.monotonically_increasing_id())
             .withColumn("pack_group", F.pmod(F.xxhash64("pack_n"), F.lit(groups)).cast("int")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", sequence_id long, offset long"

    def pack(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pack_n", kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy("int64"), (max_tokens, max_docs, max_attention), weights)
        out = group[[f.name for f in own]].copy()
        out["sequence_id"] = (np.int64(key[0]) << np.int64(40)) + bins
        out["offset"] = offsets
        return out

    return dealt.groupBy("pack_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS, max_attention: int = MAX_ATTENTION,
                   group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece, see
    ``tokenised_pieces`` and ``pack_pieces``.  A text of n bytes has at most
    n / max_tokens + 1 pieces, which bounds the mean size of a group."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b")).first()
    # bytes per token: one at least, about four in prose
    groups = max(1, -(-(size["n"] + size["b"] // (2 * max_tokens)) // group_pieces))
    pieces = tokenised_pieces(docs, id_col, text_col, path, max_tokens, with_ids=with_ids)
    return pack_pieces(pieces, groups, max_tokens, max_docs, max_attention)
