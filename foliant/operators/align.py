"""Positions of segments on pages, and lookups in them.

The search for a segment goes on where the one before was found, so it is sequential in a document by its
definition: the keys of a document, which letters and digits alone make up, are aligned in one task, and documents in
parallel. A document is bounded by the upload limit (80 MiB); where a table holds more under one id, that id's
keys must fit one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Lengths of the beginnings searched for, beside the whole key of a short segment.
PROBES, WHOLE, LONG = (128, 64, 32, 16, 8), 300, 200
_SCHEMA = "ordinal bigint, position double, page int, matched boolean"


def _place(keys: list[str], pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in [0, 1] and whether each was found, for segment keys in order.

    The pages are one string with a character between them that no key has, so a search is one find from the cursor.
    """
    size = np.array([max(1, len(p)) for p in pages])
    text = "\n".join(p or " " for p in pages)
    head = np.r_[0, np.cumsum(size + 1)[:-1]]  # where pages begin in the text
    places, cursor = np.full(len(keys), -1, np.int64), 0
    for i, key in enumerate(keys):
        lengths = {len(key) if len(key) <= WHOLE else LONG, *(n for n in PROBES if n < len(key))} - {0}
        for n in sorted(lengths, reverse=True):
            at = text.find(key[:n], cursor)
            if at >= 0:
                page = int(np.searchsorted(head, at, "right")) - 1
                places[i], cursor = at, at + n
                if cursor >= head[page] + size[page]:  # used up: on to the next page, or the last one again
                    cursor = int(head[min(page + 1, len(pages) - 1)])
                break
    found = places >= 0
    page = np.searchsorted(head, places, "right") - 1
    inside = (places - head[page]) / size[page]
    # the others in proportion to the characters gone by
    own = np.array([max(1, len(k)) for k in keys], np.float64)
    ends = np.cumsum(size).astype(np.float64)
    want = np.minimum((np.cumsum(own) - own) / max(1.0, own.sum()) * ends[-1], ends[-1])
    guess = np.minimum(np.searchsorted(ends, want), len(pages) - 1)
    part = np.clip((want - (ends[guess] - size[guess])) / size[guess], 0.0, 1.0)
    raw = np.where(found, page + inside, guess + part) / len(pages)
    return np.maximum.accumulate(np.clip(raw, 0.0, 1.0)), found


def page_map(segments: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, position, page, matched): where each segment (key, ordinal, source) begins on the pages (key, page_no, text)."""
    kind = dict(segments.dtypes)[key]
    s = segments.select(key, F.col("ordinal").cast("bigint").alias("ordinal"), T.match_key(F.coalesce(F.col("source"), F.lit(""))).alias("_key"))
    p = pages.select(key, "page_no", T.match_key(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "ordinal": [], "position": [], "page": [], "matched": []})
        a, b = a.sort_values("ordinal", ignore_index=True), b.sort_values("page_no")
        position, found = _place(list(a["_key"]), list(b["_key"]))
        return pd.DataFrame({key: a[key], "ordinal": a["ordinal"], "position": position, "page": np.minimum(len(b), np.floor(position * len(b)).astype(int) + 1), "matched": found})

    return s.groupBy(key).cogroup(p.groupBy(key)).applyInPandas(run, f"`{key}` {kind}, {_SCHEMA}")


def with_next(mapped: DataFrame, key: str) -> DataFrame:
    """mapped with ``next_position``: the least position of its document that is greater by more than a millionth, else 1."""
    billionths = F.round(F.col("position") * 1e9).cast("bigint")
    w = Window.partitionBy(key).orderBy(billionths).rangeBetween(1001, Window.unboundedFollowing)
    return mapped.withColumn("next_position", F.coalesce(F.min("position").over(w), F.lit(1.0)))


def looked_up(mapped: DataFrame, asked: DataFrame, key: str, ratio: str) -> DataFrame:
    """(key, ratio, ordinal, fraction): the last entry at or before each asked ratio, and how far within it the ratio lies.

    Ratios and entries are merged in one ordered pass per document instead of joined pair by pair.
    """
    entries = with_next(mapped, key).select(key, F.col("position").alias("_at"), F.lit(0).alias("_kind"), F.struct("position", "ordinal", "next_position").alias("_entry"))
    queries = asked.select(key, F.col(ratio).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(entries.dtypes)["_entry"]).alias("_entry"))
    w = Window.partitionBy(key).orderBy("_at", "_kind", F.col("_entry.ordinal")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy(key).orderBy(F.col("_entry.position").asc_nulls_last(), F.col("_entry.ordinal").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = entries.unionByName(queries).withColumn("_hit", F.coalesce(F.last("_entry", True).over(w), F.first("_entry", True).over(first))).where("_kind = 1")
    inside = (F.col("_at") - F.col("_hit.position")) / F.greatest(F.lit(1e-6), F.col("_hit.next_position") - F.col("_hit.position"))
    return both.select(key, F.col("_at").alias(ratio), F.col("_hit.ordinal").alias("ordinal"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)).alias("fraction"))


def by_weight(entries: DataFrame, asked: DataFrame, key: str, ratio: str) -> DataFrame:
    """(key, ratio, ordinal, fraction) where there are no positions: the first entry (key, ordinal, start, end) whose end reaches the ratio of the whole weight, the last one where none does."""
    total = entries.groupBy(key).agg(F.greatest(F.max("end"), F.lit(1.0)).alias("_total"))
    targets = asked.join(total, key).select(key, F.col(ratio).alias("_ratio"), (F.col(ratio) * F.col("_total")).alias("_at"))
    rows = entries.select(key, F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_ratio"), F.struct("ordinal", "start", "end").alias("_entry"))
    wanted = targets.select(key, "_at", F.lit(0).alias("_kind"), "_ratio", F.lit(None).cast(dict(rows.dtypes)["_entry"]).alias("_entry"))
    ahead = Window.partitionBy(key).orderBy("_at", "_kind", F.col("_entry.ordinal")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(key).orderBy(F.col("_entry.ordinal").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hit = F.coalesce(F.first("_entry", True).over(ahead), F.last("_entry", True).over(whole))
    both = rows.unionByName(wanted).withColumn("_hit", hit).where("_kind = 0")
    part = (F.col("_at") - F.col("_hit.start")) / F.greatest(F.col("_hit.end") - F.col("_hit.start"), F.lit(0.001))
    return both.select(key, F.col("_ratio").alias(ratio), F.col("_hit.ordinal").alias("ordinal"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)).alias("fraction"))
