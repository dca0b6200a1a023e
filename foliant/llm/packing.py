"""Filling fixed-capacity containers with items (problem 7).

Hierarchical packing over context sizes ``tiers``, each a quarter of the one before. An item is routed to the
shortest tier that holds it; each tier packs its own items into windows of its own context size. Then the gaps
of the long windows are filled from the shorter tiers: whole packed windows first, from the longest tier down,
each into the smallest gap that holds it and that it nearly fills; the other windows are taken apart, their items
go into the smallest gaps that hold them, and what is left then opens new containers, largest first. Containers
are dealt to steps that hold about as many tokens each.

Groups of about ``GROUP`` items, formed by a hash of the key, are packed independently, so that the work is
parallel at any size; what a group wastes is at most its last containers.

Edge cases: an item above the capacity is cut into full containers and a rest, which is packed as an item of
its own; an item of size 0 or null takes no space and has no row; a repeated key counts once; ties in size go
by key, so the result is the same on every run.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import session

CAPACITY = 2048
#: Items packed together, and containers of one step.
GROUP, STEP = 20_000, 8
#: Part of its context size that a window put whole into a gap may leave open there.
LOOSE = 1 / 8


def tiers(capacity: int = CAPACITY) -> list[int]:
    """Context sizes from the capacity downwards, each a quarter of the one before, the last one at least 8."""
    out = [capacity]
    while out[-1] // 4 >= 8:
        out.append(out[-1] // 4)
    return out


class _Gaps:
    """Space left in open containers, smallest first."""

    def __init__(self) -> None:
        self.left: list[tuple[int, int]] = []

    def put(self, size: int, most: int | None = None) -> int:
        """The container with the smallest gap that holds the size, which it takes; -1 where there is none, or none that leaves at most ``most``."""
        at = bisect_left(self.left, (size, -1))
        if at == len(self.left) or (most is not None and self.left[at][0] - size > most):
            return -1
        left, box = self.left.pop(at)
        self.open(left - size, box)
        return box

    def open(self, left: int, box: int) -> None:
        if left:
            insort(self.left, (left, box))


def windows(sizes: np.ndarray, context: int) -> np.ndarray:
    """Window number of each item of one tier, best fit by falling size."""
    out, gaps, made = np.empty(len(sizes), np.int64), _Gaps(), 0
    for i in np.argsort(-sizes, kind="stable"):
        box = gaps.put(int(sizes[i]))
        if box < 0:
            box, made = made, made + 1
            gaps.open(context - int(sizes[i]), box)
        out[i] = box
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item; sizes in 1..capacity."""
    contexts = tiers(capacity)
    tier = np.searchsorted(-np.array(contexts), -sizes, "right") - 1
    where, gaps, made = np.full(len(sizes), -1, np.int64), _Gaps(), 0
    for level, context in enumerate(contexts):
        own = np.flatnonzero(tier == level)
        window = windows(sizes[own], context)
        content = np.bincount(window, sizes[own]).astype(np.int64)
        home = np.full(len(content), -1, np.int64)
        for w in np.argsort(-content, kind="stable"):
            if level:
                home[w] = gaps.put(int(content[w]), most=int(context * LOOSE))
            else:  # a window of the full size is a container
                home[w], made = made, made + 1
                gaps.open(capacity - int(content[w]), home[w])
        where[own] = home[window] if len(own) else -1
        apart = own[where[own] < 0]
        for i in apart[np.argsort(-sizes[apart], kind="stable")]:
            where[i] = box = gaps.put(int(sizes[i]))
            if box < 0:
                where[i], made = made, made + 1
                gaps.open(capacity - int(sizes[i]), where[i])
    return where


def steps(fill: np.ndarray, step: int = STEP) -> np.ndarray:
    """A step number for each container so that steps of ``step`` containers hold about as many tokens."""
    n = -(-len(fill) // step)
    order = np.argsort(-fill, kind="stable")
    row, col = np.divmod(np.arange(len(fill)), max(n, 1))
    out = np.empty(len(fill), np.int64)
    out[order] = np.where(row % 2 == 0, col, n - 1 - col)  # dealt to and fro
    return out


def containers(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(container bigint, key, piece int, tokens int, step bigint): where each item, or piece of one, lies.

    The sizes, one row of two numbers for each key, are written once in the shared folder when this is called,
    so that they are neither measured again to be counted nor after the loss of an executor.
    """
    kind = dict(df.dtypes)[key]
    once = session.written(df.where(F.col(key).isNotNull() & (F.col(size) > 0)).groupBy(key).agg(F.max(size).cast("int").alias("_tokens")))
    groups = max(1, -(-once.count() // group))  # of the footers
    dealt = once.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("bigint"))

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        total = pdf["_tokens"].to_numpy(np.int64)
        whole = (total - 1) // capacity  # full containers before the last piece
        row = np.repeat(np.arange(len(total)), whole + 1)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + 1) - (whole + 1), whole + 1)
        tokens = np.where(piece < whole[row], capacity, total[row] - whole[row] * capacity)
        box = pack(tokens, capacity)
        step = steps(np.bincount(box, tokens))
        g = int(key_[0])
        return pd.DataFrame({"container": box * groups + g, key: pdf[key].to_numpy()[row], "piece": piece.astype(np.int32), "tokens": tokens.astype(np.int32), "step": step[box] * groups + g})

    return dealt.groupBy("_group").applyInPandas(run, f"container bigint, `{key}` {kind}, piece int, tokens int, step bigint")
