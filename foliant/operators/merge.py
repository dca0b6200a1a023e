"""Edit logs, translations and segments brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def latest_edits(log: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """(key, fields): of each field the last value that was set, in the order of the log; null where never.

    Rows delivered twice do not matter, and a hot key is reduced by partial aggregates. Text is stripped.
    """
    kinds = dict(log.dtypes)
    value = lambda c: T.strip(F.col(c)) if kinds[c] == "string" else F.col(c)
    return log.groupBy(*key).agg(*(F.max_by(value(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))


def upserted(base: DataFrame, changes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """base with the values of ``changes`` where they are set, and ``changed``: whether any differs from before."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in fields))
    differs = [F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in fields]
    out = base.join(new, key, "left")
    changed = F.lit(False)
    for d in differs:
        changed = changed | d
    return out.withColumn("changed", changed).withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}).drop(*(f"_{c}" for c in fields))


def sessions(log: DataFrame, key: list[str], ts: str, order: str, gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n, last_seq): edits of a key with no quiet period longer than ``gap`` between them."""
    stamped = log.dropDuplicates([order]).withColumn("_ts", F.col(ts).cast("timestamp"))
    w = F.session_window("_ts", gap)
    out = stamped.groupBy(*key, w.alias("w")).agg(F.count("*").alias("n"), F.max(order).alias("last_seq"), F.max("_ts").alias("_last"))
    return out.select(*key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("_last").cast("timestamp_ntz").alias("session_end"), "n", "last_seq")


def zipped(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides by position; ``both`` is false where one side has no row there."""
    a = left.select(*key, F.col(values[0]).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*key, F.col(values[1]).alias("right_value"), F.lit(True).alias("_r"))
    return a.join(b, key, "full").withColumn("both", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")
