"""Encoding of the whole corpus with a public tokenizer (problem 6).

A byte-level BPE vocabulary given as a local rank file is run by the tiktoken library inside ``mapInArrow``.
Long texts are pre-split by a regular expression at boundaries that no token can cross, so a huge text is
encoded piece by piece with the same ids; ids of a batch are put together as one flat numpy array and handed
back as an Arrow list. Special tokens are ordinary text. Ids decode to raw bytes by one table gather.

Edge cases: a null or empty text has the empty list; text of any length or without any boundary is encoded
whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once, and where a text may be cut: before one white space between visible characters, or between a sign and a letter.
PIECE = 1 << 14
_SAFE = regex.compile(r"(?<=\S)(?=\s\S)|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def ship(spark: SparkSession, ranks: str) -> str:
    """Sends a rank file that the driver has to all executors; returns where it was."""
    if os.path.exists(ranks):
        spark.sparkContext.addFile(ranks)
    return ranks


def _here(ranks: str) -> str:
    """The rank file on this machine: at its path, or as it was sent."""
    return ranks if os.path.exists(ranks) else SparkFiles.get(os.path.basename(ranks))


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(_here(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of about ``most`` characters."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, ranks: str = RANKS, pattern: str = PATTERN) -> np.ndarray:
    """The ids of one text as uint32."""
    run = encoding(ranks, pattern)._core_bpe.encode_to_tiktoken_buffer
    return np.frombuffer(b"".join(bytes(run(p, set())) for p in pieces(text or "")), np.uint32)


def encode_array(texts: pa.Array, ranks: str = RANKS, pattern: str = PATTERN, counts_only: bool = False) -> pa.Array:
    """list<int32> of the ids of each text, or their number as int32."""
    run = encoding(ranks, pattern)._core_bpe.encode_to_tiktoken_buffer
    found = []
    for text in texts.to_pylist():
        if not text:
            found.append(b"")
        elif len(text) <= PIECE:
            found.append(bytes(run(text, set())))
        else:
            found.append(b"".join(bytes(run(p, set())) for p in pieces(text)))
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    if counts_only:
        return pa.array(lengths.astype(np.int32))
    ids = np.frombuffer(b"".join(found), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(ids))


def token_ids(df: DataFrame, key: str, text: str, out: str = "ids", ranks: str = RANKS, pattern: str = PATTERN, counts_only: bool = False) -> DataFrame:
    """(key, out): the ids of each text as array<int>, or with counts_only their number as int."""
    kind = dict(df.dtypes)[key]
    ship(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):  # bounds the ids held at once
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_array(part.column(1), ranks, pattern, counts_only)], [key, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{out}` {'int' if counts_only else 'array<int>'}")


@lru_cache(maxsize=4)
def _bytes_of(ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    enc = encoding(ranks, pattern)
    each = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
    return np.frombuffer(b"".join(each), np.uint8), np.r_[0, np.cumsum([len(x) for x in each])]


def decode(ids: np.ndarray, ranks: str = RANKS, pattern: str = PATTERN) -> bytes:
    """The raw bytes of ids, also where they end within a character."""
    flat, off = _bytes_of(ranks, pattern)
    ids = np.asarray(ids, np.int64)
    n = off[ids + 1] - off[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(off[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def texts_of(df: DataFrame, key: str, ids: str, out: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, out): the text of each list of ids; bytes that are no UTF-8 become U+FFFD. A null list has a null text."""
    kind = dict(df.dtypes)[key]
    ship(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode(np.array(x, np.int64), ranks, pattern).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, out])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{out}` string")
