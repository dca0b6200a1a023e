"""The state of segments: who may be written, and what edits, answers and saves make of it.

A segment has translation, status and locked. Everything here is a fold by keys: rows of one hot document or
segment meet in partial aggregates only, and text is shuffled only where it is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

#: States set by hand, states of work under way, and what a finished machine translation is.
BY_HAND, UNDER_WAY, MACHINE = ["edited", "reviewed"], ["queued", "translating"], "machine"


def blank(value: Column) -> Column:
    """Whether there is no text at all; white space counts as text here."""
    return F.coalesce(F.length(value), F.lit(0)) == 0


def free() -> Column:
    """Whether a machine may write: neither locked nor edited or reviewed by hand."""
    return ~F.coalesce(F.col("locked"), F.lit(False)) & ~F.coalesce(F.col("status").isin(BY_HAND), F.lit(False))


def filled(translation: Column, yes: str, no: str = "empty") -> Column:
    return F.when(blank(translation), no).otherwise(yes)


def pending(segments: DataFrame, overwrite: bool | Column = False) -> DataFrame:
    """Segments to be translated: those a machine may write that have no translation, or all of these with ``overwrite``."""
    again = overwrite if isinstance(overwrite, Column) else F.lit(overwrite)
    return segments.where(free() & (F.coalesce(again, F.lit(False)) | blank(F.col("translation"))))


def queued(segments: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """segments in which the chosen ones wait, where a machine may still write them."""
    mark = chosen.select(*key).distinct().withColumn("_chosen", F.lit(True))
    status = F.when(F.col("_chosen") & free(), "queued").otherwise(F.col("status"))
    return segments.join(mark, key, "left").withColumn("status", status).drop("_chosen")


def eligible(planned: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a plan whose segment a machine may still write in the current state."""
    return planned.join(current.where(free()).select(*key), key, "left_semi")


def answered(segments: DataFrame, answers: DataFrame, key: list[str], overwrite: bool | Column = False, one: bool = False) -> DataFrame:
    """segments with the ``text`` of answers as translation and status machine, and ``applied``.

    Locked, edited and reviewed segments are left, and those with a translation unless ``overwrite``. With ``one``,
    for a segment asked for by itself, only the lock counts.
    """
    again = overwrite if isinstance(overwrite, Column) else F.lit(overwrite)
    may = ~F.coalesce(F.col("locked"), F.lit(False)) if one else free() & (F.coalesce(again, F.lit(False)) | blank(F.col("translation")))
    out = segments.join(answers.select(*key, F.col("text").alias("_text")), key, "left").withColumn("applied", F.col("_text").isNotNull() & may)
    new = {"translation": F.when(F.col("applied"), F.col("_text")).otherwise(F.col("translation")), "status": F.when(F.col("applied"), MACHINE).otherwise(F.col("status"))}
    return out.withColumns(new).drop("_text")


def settled(segments: DataFrame) -> DataFrame:
    """segments after a job has ended: what was under way is machine where a translation is visible, else empty."""
    seen = F.length(T.strip(F.coalesce("translation", F.lit("")))) > 0
    return segments.withColumn("status", F.when(F.col("status").isin(UNDER_WAY), F.when(seen, MACHINE).otherwise("empty")).otherwise(F.col("status")))


def edited(segments: DataFrame, log: DataFrame, key: list[str], order: str) -> DataFrame:
    """segments after the edits of a log (source, translation, locked, reviewed; null: not set), in its order.

    A translation that differs from the one before makes a segment edited, or empty; reviewed sets reviewed and
    the lock, its withdrawal edited or empty and no lock. As the last status decides, three aggregates do: the
    last value of each field, the last review, and whether a translation behind it differs from the one it found.
    Rows delivered twice do not matter; neither do edits of unknown segments.
    """
    said = log.select(*key, F.col(order).alias("_at"), T.strip(F.col("source")).alias("_s"), T.strip(F.col("translation")).alias("_t"), "locked", "reviewed")
    shut = F.coalesce("reviewed", "locked")
    last = lambda value, name: F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(name)
    latest = said.groupBy(*key).agg(last(F.col("_s"), "_source"), last(F.col("_t"), "_last"), last(shut, "_shut"), last(F.col("reviewed"), "_review"), F.max(F.when(F.col("reviewed").isNotNull(), F.col("_at"))).alias("_when"))
    texts = said.where("_t is not null").select(*key, "_at", "_t")
    # what each review found, and the least and greatest translation behind it (of all where there was no review)
    points = texts.join(latest.select(*key, F.coalesce("_when", F.lit(-(2**62))).alias("_when")), key)
    behind = F.when(F.col("_at") > F.col("_when"), F.col("_t"))
    change = points.groupBy(*key).agg(F.max_by("_t", F.when(F.col("_at") <= F.col("_when"), F.col("_at"))).alias("_found"), F.min(behind).alias("_lo"), F.max(behind).alias("_hi"))
    out = segments.join(latest, key, "left").join(change, key, "left")
    before = F.coalesce("_found", "translation", F.lit(""))
    translation = F.coalesce("_last", "translation")
    status = (
        F.when((F.col("_lo") != before) | (F.col("_hi") != before), filled(translation, "edited"))
        .when(F.col("_review"), "reviewed")
        .when(~F.col("_review"), filled(before, "edited"))
        .otherwise(F.col("status"))
    )
    new = {"source": F.coalesce("_source", "source"), "status": status, "locked": F.coalesce("_shut", "locked"), "translation": translation}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in segments.columns))


def autosaved(segments: DataFrame, saves: DataFrame, document: str, segment: str, values: str) -> DataFrame:
    """segments after saves (document, map of segment to translation): changed values make a segment edited or empty; ``changed`` says which."""
    each = saves.select(document, F.explode(values).alias(segment, "_value"))
    new = each.groupBy(document, segment).agg(F.max(T.strip(F.col("_value"))).alias("_value"))
    out = segments.join(new, [document, segment], "left").withColumn("changed", F.col("_value").isNotNull() & (F.col("_value") != F.coalesce("translation", F.lit(""))))
    fresh = {"translation": F.when(F.col("changed"), F.col("_value")).otherwise(F.col("translation")), "status": F.when(F.col("changed"), filled(F.col("_value"), "edited")).otherwise(F.col("status"))}
    return out.withColumns(fresh).drop("_value")


def shown(server: DataFrame, dirty: DataFrame, key: list[str]) -> DataFrame:
    """(key, translation, status): what an editor shows: its own unsaved translation where it has one, else the server's."""
    own = dirty.select(*key, F.col("translation").alias("_own"), F.lit(True).alias("_dirty"))
    value = F.when(F.col("_dirty"), F.coalesce("_own", F.lit(""))).otherwise(F.coalesce("translation", F.lit("")))
    return server.join(own, key, "left").select(*key, value.alias("translation"), "status")


def unsaved(dirty: DataFrame, saved: DataFrame, key: list[str]) -> DataFrame:
    """Rows of dirty whose translation is not the one saved for the key: an edit made meanwhile stays."""
    done = saved.select(*key, F.coalesce("translation", F.lit("")).alias("_v")).distinct()
    return dirty.withColumn("_v", F.coalesce("translation", F.lit(""))).join(done, [*key, "_v"], "left_anti").drop("_v")


def latest_with_key(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, translation): the last translation set for each key, null where it never was."""
    return log.groupBy(*key).agg(F.max_by(T.strip(F.col("translation")), F.when(F.col("translation").isNotNull(), F.col(order))).alias("translation"))


def started(requests: DataFrame, records: DataFrame, running: DataFrame, configured: bool = True) -> DataFrame:
    """Requests of a job with ``answer``: 400 for equal languages, 409 without a model, 404 for an unknown document, 202 otherwise, and ``begins``.

    A request for a document that is being translated, and all but the first of several, is answered the same and begins nothing.
    """
    from pyspark.sql import Window

    known = records.select("doc_id", F.lit(True).alias("_known"))
    busy = running.select("doc_id").distinct().withColumn("_busy", F.lit(True))
    code = F.when(F.col("source_language") == F.col("target_language"), 400).when(F.lit(not configured), 409).when(F.col("_busy"), 202).when(F.col("_known"), 202).otherwise(404)
    rows = requests.join(known, "doc_id", "left").join(busy, "doc_id", "left").withColumn("answer", code)
    first = rows.where((F.col("answer") == 202) & F.col("_busy").isNull()).groupBy("doc_id").agg(F.min("request_id").alias("_first"))
    out = rows.join(first, "doc_id", "left").withColumn("begins", F.coalesce((F.col("request_id") == F.col("_first")) & (F.col("answer") == 202), F.lit(False)))
    return out.drop("_known", "_busy", "_first")


def archived(records: DataFrame, ids: DataFrame, stamp: str, taken: DataFrame | None = None) -> DataFrame:
    """records with ``archived_as``: null, or for the ids ``id-stamp``, with a number from 2 where that name is taken."""
    names = ids.select("doc_id").distinct().withColumn("archived_as", F.concat_ws("-", "doc_id", F.lit(stamp)))
    if taken is not None:  # names of the form id-stamp or id-stamp-n
        used = taken.select(F.regexp_extract("archived_as", "^([^-]+-.*?)(?:-([0-9]+))?$", 0).alias("_n"), F.substring_index("archived_as", "-", 1).alias("doc_id"))
        most = used.where(F.col("_n").startswith(F.concat_ws("-", "doc_id", F.lit(stamp)))).groupBy("doc_id").agg(F.max(F.coalesce(F.regexp_extract("_n", f"-{stamp}-([0-9]+)$", 1).try_cast("int"), F.lit(1))).alias("_most"))
        names = names.join(most, "doc_id", "left").withColumn("archived_as", F.when(F.col("_most").isNull(), F.col("archived_as")).otherwise(F.concat_ws("-", "archived_as", (F.col("_most") + 1).cast("string")))).drop("_most")
    return records.join(names, "doc_id", "left")


def live(records: DataFrame) -> DataFrame:
    return records.where("archived_as is null").drop("archived_as")
