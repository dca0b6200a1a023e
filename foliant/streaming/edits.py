"""The edit log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def saves(log: DataFrame, key: list[str], ts: str, order: str, value: str, quiet: str = "1 second", late: str = "1 hour") -> DataFrame:
    """(key, saved_at, value): the last value of each burst of edits, once the quiet period is over.

    Rows delivered twice are dropped within the watermark; rows later than it are lost, as in any stream.
    """
    stamped = log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([order])
    out = stamped.groupBy(*key, F.session_window("_ts", quiet).alias("w")).agg(F.max_by(value, order).alias(value))
    return out.select(*key, F.col("w.end").alias("saved_at"), value)


def folded(log: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """(key, order, fields): after each batch the last set value of every field of the keys it touched, whatever order rows come in."""
    kinds = dict(log.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"`{order}` bigint", *(f"`{f}` {kinds[f]}" for f in fields)])
    state = ", ".join(f"`at_{f}` bigint, `{f}` {kinds[f]}" for f in fields)

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        values = list(held.get) if held.exists else [-1, None] * len(fields)
        seen = 0
        for pdf in frames:
            seen = max(seen, int(pdf[order].max()))
            for i, f in enumerate(fields):
                own = pdf[pdf[f].notna()]
                if len(own):
                    last = own.loc[own[order].idxmax()]
                    if last[order] > values[2 * i]:
                        values[2 * i], values[2 * i + 1] = int(last[order]), last[f]
        held.update(tuple(values))
        yield pd.DataFrame([[*group, seen, *values[1::2]]], columns=[*key, order, *fields])

    return log.groupBy(*key).applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout)


def transitions(records: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, before, after): changes of a value along the versions of a key (for batches of a polled table)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return records.withColumn("before", F.lag(value).over(w)).where(~F.col("before").eqNullSafe(F.col(value))).select(key, order, "before", F.col(value).alias("after"))
