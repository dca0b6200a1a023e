"""Ordered operators over the items of a group that stay parallel within one hot group.

A group is cut into blocks of its order column. Each block is folded on its own, what it hands on is small, and
only these summaries meet per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import session

#: Positions of the order column that form a block.
BLOCK = 65_536


def prefix_sums(df: DataFrame, group: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """df with ``start`` and ``end``: sums of ``value`` before and up to each row, in the order of its group."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = cut.groupBy(group, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_base"))
    within = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_base") + F.sum(value).over(within)
    return cut.join(base, [group, "_block"]).withColumn("end", end).withColumn("start", F.col("end") - F.col(value)).drop("_block", "_base")


def _jumps(lengths: np.ndarray, items: int, chars: int) -> np.ndarray:
    """Where the next batch starts if one starts at each item."""
    ends, at = np.r_[0, np.cumsum(lengths)], np.arange(len(lengths))
    fits = np.searchsorted(ends, ends[:-1] + chars, "right") - 1
    return np.maximum(at + 1, np.minimum(np.minimum(fits, at + items), len(lengths)))


def _ways(lengths: np.ndarray, known: int, items: int, chars: int) -> tuple[list[np.ndarray], list[int], list[int]]:
    """For every number of first items that still belong to the batch before: batch numbers of the ``known`` items (-1 for those), items of later blocks the last batch takes, and batches begun.

    lengths goes on behind the known items with those a batch may still take.
    """
    jump = _jumps(lengths, items, chars).tolist()
    began = np.full(known + 1, -1, np.int64)  # by which way a batch has begun at a place
    flags = np.zeros((items, known), bool)
    to = []
    for way in range(items):
        i, own = way, []
        while i < known and began[i] < 0:
            began[i] = way
            own.append(i)
            i = jump[i]
        flags[way, own] = True
        if i < known:  # from here on as the way that was here before
            flags[way, i:] = flags[began[i], i:]
            to.append(to[began[i]])
        else:
            to.append(i - known)
    numbers = np.cumsum(flags, axis=1) - 1
    return list(numbers.astype(np.int32)), to, flags.sum(1).tolist()


def batches(df: DataFrame, group: str, order: str, length: str, items: int, chars: int, lone_first: bool = False, block: int = BLOCK) -> DataFrame:
    """(group, order, batch_no int): greedy batches of at most ``items`` items and ``chars`` characters, numbered from 0.

    An item longer than ``chars`` has a batch of its own; with ``lone_first`` so has the first item of a group. Rows
    without a group have no batch. block: the span of the order column that holds some 65,536 items at most.
    A batch never spans more than ``items`` items, so a block hands on only how many items the next one starts
    with: each block is numbered for every such number, which is written once in the shared folder when this is
    called, and the few numbers that blocks hand on are chained per group.
    """
    kinds = dict(df.dtypes)
    source = df.select(F.col(group).alias("_group"), F.col(order).cast("bigint").alias("_at"), F.col(length).cast("bigint").alias("_len"))
    first = None
    if lone_first:
        least = source.groupBy("_group").agg(F.min("_at").alias("_least"))
        source = source.join(least, "_group")
        first = source.where("_at = _least").select("_group", "_at", F.lit(0).cast("bigint").alias("batch_no"))
        source = source.where("_at > _least").drop("_least")
    blocks = source.groupBy("_group", F.floor(F.col("_at") / block).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_at", "_len"))).alias("_items"))
    later = Window.partitionBy("_group").orderBy("_block").rowsBetween(1, items)
    ahead = F.flatten(F.collect_list(F.slice(F.transform("_items", lambda x: x["_len"]), 1, items)).over(later))
    plain = {"_ats": F.transform("_items", lambda x: x["_at"]), "_lens": F.transform("_items", lambda x: x["_len"]), "_ahead": F.slice(ahead, 1, items)}
    seen = blocks.select("_group", "_block", *(c.alias(n) for n, c in plain.items()))

    def number(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            own, nxt = (b.column(b.schema.get_field_index(c)) for c in ("_lens", "_ahead"))
            made = [_ways(np.concatenate([own[i].values.to_numpy(zero_copy_only=False), nxt[i].values.to_numpy(zero_copy_only=False)]).astype(np.int64), len(own[i]), items, chars) for i in range(b.num_rows)]
            ints = pa.list_(pa.int32())
            columns = [pa.array([m[0] for m in made], pa.list_(ints)), pa.array([m[1] for m in made], ints), pa.array([m[2] for m in made], ints)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("_group", "_block", "_ats")), *columns], ["_group", "_block", "_ats", "_numbers", "_to", "_made"])

    schema = f"_group {kinds[group]}, _block bigint, _ats array<bigint>, _numbers array<array<int>>, _to array<int>, _made array<int>"
    ways = session.written(seen.mapInArrow(number, schema))
    start = F.struct(F.lit(0).alias("entry"), F.lit(1 if lone_first else 0).cast("bigint").alias("number"), F.array().cast("array<struct<_block:bigint,entry:int,number:bigint>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        here = F.struct(b["_block"].alias("_block"), acc["entry"].alias("entry"), acc["number"].alias("number"))
        return F.struct(F.get(b["_to"], acc["entry"]).alias("entry"), (acc["number"] + F.get(b["_made"], acc["entry"])).alias("number"), F.concat(acc["out"], F.array(here)).alias("out"))

    moves = ways.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_block", "_to", "_made"))).alias("_moves"))
    chained = moves.select("_group", F.explode(F.aggregate("_moves", start, step, lambda acc: acc["out"])).alias("_c")).select("_group", "_c._block", "_c.entry", "_c.number")
    rest = ways.join(chained, ["_group", "_block"]).select("_group", "number", F.explode(F.arrays_zip("_ats", F.get("_numbers", "entry").alias("_no"))).alias("_x"))
    placed = rest.select("_group", F.col("_x._ats").alias("_at"), (F.col("number") + F.col("_x._no")).alias("batch_no"))
    both = placed if first is None else first.unionByName(placed)
    return both.select(F.col("_group").alias(group), F.col("_at").cast(kinds[order]).alias(order), F.col("batch_no").cast("int").alias("batch_no"))
