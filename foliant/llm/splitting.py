"""Splitting oversized items at natural boundaries (problem 1).

A text above the limit is cut by dynamic programming over its boundary positions: line breaks, sentence ends,
other punctuation, white space and marks within words such as the points of a URL, each with a penalty, and the
path from start to end of least penalty plus imbalance of the pieces is taken, where no piece is longer than the
limit and each piece after the first begins with the last ``overlap`` characters of the one before. Positions
that are no boundary are allowed only in stretches without any that are longer than a piece can be, spread
evenly, at a penalty above all others. A weaker boundary is a candidate only where the next stronger ones are
farther apart than an eighth of a piece, at any limit, so that no stretch of a piece is without candidates.

Edge cases: a null or empty text has no piece; a text up to the limit is one piece; lengths are code points;
a text without any boundary is cut evenly; repeated rows give repeated pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import charspace as cs

LIMIT, OVERLAP = 1200, 100
CUTS = ["line", "sentence", "punctuation", "space", "mark", "hard", "end"]
PENALTY = np.array([0.0, 0.4, 1.5, 3.0, 6.0, 50.0, 0.0])
#: Weaker boundaries count only where stronger ones are farther apart than this share of a piece without its overlap.
REACH = 1 / 8
#: Punctuation at which a text may be cut, its part that ends sentences, and closing marks behind it.
PUNCTUATION, SENTENCE, CLOSING = ".,;:!?。，；：！？、…", ".!?。！？…", "\"'”’»」』)）]】"
SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINES = [10, 11, 12, 13, 0x85, 0x2028, 0x2029]


def _table(chars: list[int]) -> np.ndarray:
    t = np.zeros(0x10000, bool)
    t[chars] = True
    return t


_SPACE, _LINE, _PUNCT, _SENT, _CLOSE = _table(SPACES), _table(LINES), _table([ord(c) for c in PUNCTUATION]), _table([ord(c) for c in SENTENCE]), _table([ord(c) for c in CLOSING])


def runs_at(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of the run without white space and punctuation in which each position lies."""
    stops = np.r_[-1, np.flatnonzero(_SPACE[low] | _PUNCT[low]), len(low)]
    k = np.searchsorted(stops, at)
    return stops[k] - stops[k - 1] - 1


def boundaries(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a text may be cut (exclusive ends), in order, and the kind of each."""
    n = len(low)
    space, line, sent, close = _SPACE[low], _LINE[low], _SENT[low], _CLOSE[low]
    kind = np.full(n + 1, 9, np.int8)  # of a cut before position i
    kind[1:][space] = 3
    kind[1:][_PUNCT[low]] = 4
    kind[1:][_PUNCT[low] & np.r_[space[1:], True]] = 2
    kind[1:][_PUNCT[low] & (low >= 0x80)] = 2
    after = np.r_[low[1:], 10]
    ends = sent & ((low >= 0x80) | _SPACE[after] | _CLOSE[after])
    kind[1:][ends] = 1
    for _ in range(3):  # closing marks and white space belong to what they close
        more = np.flatnonzero((kind[:-1] <= 2) & (close | space))
        kind[more + 1] = np.minimum(kind[more + 1], kind[more])
        kind[more] = 9
    kind[1:][line] = 0
    kind[[0, n]] = 9
    at = np.flatnonzero(kind < 9)
    return at, kind[at].astype(np.int64)


def cuts(low: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces and the kinds of their cuts, for a text longer than the limit."""
    n, step = len(low), limit - overlap
    at, kind = boundaries(low)
    for weak in (1, 2, 3, 4):
        strong = np.r_[0, at[kind < weak], n]
        k = np.searchsorted(strong, at)
        alone = (kind < weak) | (strong[np.minimum(k, len(strong) - 1)] - strong[np.maximum(k - 1, 0)] > REACH * step) | (kind > weak)
        at, kind = at[alone], kind[alone]
    whole = np.r_[0, at, n]
    wide = np.flatnonzero(np.diff(whole) > step)
    hard = [np.linspace(whole[i], whole[i + 1], int(np.ceil((whole[i + 1] - whole[i]) / step)) + 1)[1:-1].astype(np.int64) for i in wide]
    at, kind = np.r_[at, *hard, n].astype(np.int64), np.r_[kind, np.full(sum(map(len, hard)), 5), 6].astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, kind = at[order], kind[order]
    ideal = (n - overlap) / np.ceil((n - overlap) / step)
    pen = PENALTY[kind]
    best, back = np.full(len(at), np.inf), np.full(len(at), -1)
    first = (at <= limit) & (at > overlap)
    best[first] = pen[first] + ((at[first] - overlap - ideal) / ideal) ** 2
    lo = np.searchsorted(at, at - step)
    for i in range(len(at)):
        if lo[i] < i:
            own = best[lo[i] : i] + ((at[i] - at[lo[i] : i] - ideal) / ideal) ** 2
            j = int(own.argmin())
            if own[j] + pen[i] < best[i]:
                best[i], back[i] = own[j] + pen[i], lo[i] + j
    path = [len(at) - 1]
    while back[path[-1]] >= 0:
        path.append(int(back[path[-1]]))
    path.reverse()
    return at[path], kind[path]


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece int, start_char int, end_char int, cut string, run int, n_chars int, text): the pieces of every text.

    start_char and end_char are positions in the whole text; cut is the kind of boundary at the end of the
    piece; run is, for a hard cut, the length of the run without white space and punctuation it lies in, else
    null. Texts up to the limit stay on the JVM side.
    """
    kind = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.length("text") > 0)
    n = F.length("text").alias("n_chars")
    short = source.where(F.length("text") <= limit).select("_key", F.lit(0).alias("piece"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.lit("end").alias("cut"), F.lit(None).cast("int").alias("run"), n, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = cs.flat(b.column(1))
            for i, j in cs.slices(texts):
                cps, off = cs.codepoints(texts.slice(i, j - i))
                low = np.minimum(cps, 0xFFFF)
                rows, number, starts, ends, kinds, runs = [], [], [], [], [], []
                for r in range(j - i):
                    own = low[off[r] : off[r + 1]]
                    e, k = cuts(own, limit, overlap)
                    rows.append(np.full(len(e), r)), number.append(np.arange(len(e))), ends.append(e), kinds.append(k)
                    starts.append(np.r_[0, e[:-1] - overlap]), runs.append(np.where(k == CUTS.index("hard"), runs_at(own, e), -1))
                row, s, e = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
                lengths = e - s
                flat = np.repeat(off[row] + s - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                pieces = cs.strings(cps[flat], np.r_[0, np.cumsum(lengths)]).cast(pa.string())
                run_ = np.concatenate(runs).astype(np.int32)
                ints = [*(pa.array(x.astype(np.int32)) for x in (np.concatenate(number), s, e)), pa.array(run_, mask=run_ < 0), pa.array(np.diff(off)[row].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(row)), *ints[:3], pa.array(np.array(CUTS)[np.concatenate(kinds)]), *ints[3:], pieces], names)

    names = ["_key", "piece", "start_char", "end_char", "cut", "run", "n_chars", "text"]
    long = source.where(F.length("text") > limit).mapInArrow(run, f"_key {kind}, piece int, start_char int, end_char int, cut string, run int, n_chars int, text string")
    return short.unionByName(long).withColumnRenamed("_key", key)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, kind): texts above the limit, told from their pieces; each once.

    A run without any place to cut that is longer than the limit has a hard cut inside: ``hard`` are the texts
    with such a cut, ``soft`` all others that have more than one piece.
    """
    pieces = split(df, key, text, limit, overlap).where(F.col("n_chars") > limit)
    forced = F.max(F.coalesce(F.col("run"), F.lit(0))) > limit
    return pieces.groupBy(key).agg(F.when(forced, "hard").otherwise("soft").alias("kind"))
