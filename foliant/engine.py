"""The engine's entry points: tables in, tables out; nothing is kept between calls.

records: one row a document (readers.RECORD without its segments, keyed by doc_id); segments: (doc_id, ordinal,
segment_id, source, translation, status, locked).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import session
from foliant.config import EngineConfig
from foliant.functions import text as T
from foliant.operators import ordered, state
from foliant.operators import segments as seg
from foliant.plans import requests

#: The form of a document's id.
ID = "^[a-f0-9]{12}$"


def document(records: DataFrame, doc_id: str) -> DataFrame:
    """The record of one document; an id of another form has none."""
    return records.where(F.col("doc_id").rlike(ID) & (F.col("doc_id") == doc_id))


def ingest(files: DataFrame, texts: DataFrame, now: Column | None = None, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, segments, rejects) of new files (doc_id, path, size, source_language, target_language) and what was read of them.

    texts: (doc_id, place, text): the paragraphs of DOC and DOCX files, which are segments as they are, and of PDF files
    the texts of the pages, whose paragraphs are packed. rejects (doc_id, reject): 415 for a type, 413 for a size, 422
    where no text was found.
    """
    checked = seg.split_by_type(files, "path", "size", config.upload_bytes).withColumn("name", T.safe_filename(F.col("path")))
    taken = checked.where("reject is null").select("doc_id", "suffix")
    read = texts.join(taken, "doc_id").where(F.col("text").isNotNull())
    as_is = read.where(F.col("suffix").isin(seg.WHOLE_PARAGRAPHS) & (F.length(T.strip(F.col("text"))) > 0)).select("doc_id", "place", F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("text").alias("source"))
    paged = read.where(~F.col("suffix").isin(seg.WHOLE_PARAGRAPHS)).select("doc_id", "place", F.posexplode(T.paragraphs(F.col("text"))).alias("p", "t"))
    packed = paged.select("doc_id", "place", "p", F.posexplode(T.pack(T.clean(F.col("t")), config.segment_chars)).alias("q", "source"))
    rows = seg.numbered(as_is.unionByName(packed), "doc_id", ["place", "p", "q"])
    made = rows.select("doc_id", "ordinal", seg.segment_id(F.col("ordinal")).alias("segment_id"), "source", F.lit("").alias("translation"), F.lit("empty").alias("status"), F.lit(False).alias("locked"))
    head = rows.where(F.col("ordinal") <= config.sample_segments).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "source"))).alias("h"))
    detected = head.select("doc_id", T.detect_language(F.array_join(F.transform("h", lambda x: x["source"]), "\n")).alias("detected_language"))
    both = checked.join(detected, "doc_id", "left")
    code = F.coalesce("reject", F.when(F.col("detected_language").isNull(), 422))
    stamp = F.current_timestamp() if now is None else now
    way = T.direction(F.col("source_language"), F.col("target_language"), F.col("detected_language"))
    records = both.where(code.isNull()).select(
        "doc_id", "name", F.concat(F.lit("originals/"), "doc_id", F.lit("_"), "name").alias("original_path"), way["source"].alias("source_language"), way["target"].alias("target_language"), "detected_language",
        F.lit("ready").alias("status"), F.lit(0).alias("progress"), F.lit("").alias("error"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    return records, made, both.where(code.isNotNull()).select("doc_id", code.alias("reject"))


def planned(records: DataFrame, segments: DataFrame, overwrite: bool | Column = False, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The parts of all pending segments in their requests: (doc_id, ordinal, segment_id, batch_no, request_no, part_no, part_id, text, languages).

    Segments are taken in batches, the first one alone; the texts of a batch are cut into parts, and these are
    packed into requests. request is the number of both.
    """
    waiting = state.pending(segments, overwrite).withColumn("_len", F.length(F.coalesce("source", F.lit(""))))
    batches = ordered.batches(waiting, "doc_id", "ordinal", "_len", config.batch_items, config.request_chars, lone_first=True)
    batched = waiting.join(batches, ["doc_id", "ordinal"]).withColumn("source", F.coalesce("source", F.lit("")))
    group = F.concat_ws("/", "doc_id", F.format_string("%06d", "batch_no")).alias("_group")
    parts = requests.parts(batched.select("doc_id", "batch_no", group, "ordinal", "segment_id", "source"), ["doc_id", "batch_no", "_group", "ordinal", "segment_id"], "source", config.request_chars)
    numbered = requests.numbered(parts, "_group", "ordinal", config.batch_items, config.request_chars)
    return numbered.join(records.select("doc_id", "source_language", "target_language"), "doc_id")


def prompted(parts: DataFrame, glossary: DataFrame, order: list[str], style: str = "", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(_group, doc_id, batch_no, request_no, n_items, n_chars, payload, prompt): the requests of planned parts with the terms of each."""
    found = requests.matched_terms(parts, parts, "_group", glossary, order, config.term_limit)
    facts = parts.groupBy("_group", "request_no").agg(*(F.first(c).alias(c) for c in ("doc_id", "batch_no", "source_language", "target_language")))
    none = F.array().cast("array<struct<source:string,target:string,domain:string,notes:string>>")
    told = requests.instructions(F.col("source_language"), F.col("target_language"), F.coalesce("terms", none), F.lit(style))
    return requests.payloads(parts, "_group").join(facts, ["_group", "request_no"]).join(found, ["_group", "request_no"], "left").withColumn("prompt", told)


def translate(records: DataFrame, segments: DataFrame, translator: Callable[[str], requests.Reply | str], overwrite: bool | Column = False, config: EngineConfig = EngineConfig(), one: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, segments, calls) after a job over the documents of ``records``.

    calls, the outcome of every request, is written once in the shared folder before anything is made of it, since
    a call cannot be repeated. A document with a failed request is in error; answers of the batches before the
    failed one are kept, as batches go in order. Segments edited or locked meanwhile are left, as
    ``segments`` is read again for the merge.
    """
    mine = segments.join(records.select("doc_id"), "doc_id", "left_semi")
    parts = planned(records, mine, overwrite, config)
    plan = requests.payloads(parts, "_group")
    calls = session.written(requests.called(plan, ["_group", "request_no"], translator, config.max_retries))
    where = calls.withColumn("doc_id", F.substring_index("_group", "/", 1)).withColumn("batch_no", F.substring_index("_group", "/", -1).cast("int"))
    failed = where.where("content is null").groupBy("doc_id").agg(F.min("batch_no").alias("_failed"), F.min_by("error", F.struct("batch_no", "request_no")).alias("_error"))
    kept = where.join(failed, "doc_id", "left").where(F.col("_failed").isNull() | (F.col("batch_no") < F.col("_failed")))
    texts = requests.parsed(kept, ["doc_id"], "content")
    split = F.split("id", requests.PART)
    answers = texts.select("doc_id", F.get(split, F.lit(0)).alias("segment_id"), F.coalesce(F.get(split, F.lit(1)).try_cast("int"), F.lit(1)).alias("part_no"), "text")
    whole = requests.reassembled(answers.join(records.select("doc_id", "target_language"), "doc_id"), ["doc_id", "segment_id"], "text", F.col("target_language"))
    done = state.settled(state.answered(mine, whole, ["doc_id", "segment_id"], overwrite, one))
    counts = seg.coverage(done, "doc_id", "translation").select("doc_id", F.col("progress").alias("_progress"))
    status = {"status": F.when(F.col("_failed").isNull(), "completed").otherwise("error"), "error": F.coalesce("_error", F.lit("")), "progress": F.coalesce("_progress", F.lit(0))}
    after = records.drop("progress", "error").join(counts, "doc_id", "left").join(failed, "doc_id", "left").withColumns(status).drop("_progress", "_failed", "_error")
    return after, done, calls


def translate_one(records: DataFrame, segments: DataFrame, chosen: DataFrame, translator: Callable[[str], requests.Reply | str], config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) after single segments (doc_id, segment_id) were asked for: one that is locked is rejected with 409, a failed call with 502.

    A translation, even an edited one, is replaced; the segments come whole, the chosen ones changed.
    """
    key = ["doc_id", "segment_id"]
    asked = segments.join(chosen.select(*key).distinct(), key, "left_semi")
    open_ = asked.where(~F.coalesce("locked", F.lit(False))).withColumn("status", F.lit("empty"))
    calls = translate(records, open_, translator, True, config, one=True)[2]
    bad = calls.where("content is null").select(F.substring_index("_group", "/", 1).alias("doc_id"), "_group", "request_no")
    lost = planned(records, open_, True, config).join(bad.drop("doc_id"), ["_group", "request_no"]).select(*key).distinct()
    good = requests.parsed(calls.where("content is not null").withColumn("doc_id", F.substring_index("_group", "/", 1)), ["doc_id"], "content")
    split = F.split("id", requests.PART)
    rows = good.select("doc_id", F.get(split, F.lit(0)).alias("segment_id"), F.coalesce(F.get(split, F.lit(1)).try_cast("int"), F.lit(1)).alias("part_no"), "text").join(lost, key, "left_anti")
    whole = requests.reassembled(rows.join(records.select("doc_id", "target_language"), "doc_id"), key, "text", F.col("target_language"))
    rejects = asked.where("locked").select(*key, F.lit(409).alias("reject")).unionByName(lost.select(*key, F.lit(502).alias("reject")))
    return state.answered(segments, whole, key, one=True), rejects


def apply_edits(segments: DataFrame, log: DataFrame) -> DataFrame:
    """segments after an edit log (seq, doc_id, segment_id, source, translation, locked, reviewed)."""
    return state.edited(segments, log, ["doc_id", "segment_id"], "seq")


def apply_autosave(segments: DataFrame, saves: DataFrame) -> DataFrame:
    """segments after saves (doc_id, translations map<string,string>)."""
    return state.autosaved(segments, saves, "doc_id", "segment_id", "translations")


def archive(records: DataFrame, ids: DataFrame, stamp: str) -> DataFrame:
    """records without those of the ids, of which files stay where they are (state.archived has the names)."""
    return state.live(state.archived(records, ids.where(F.col("doc_id").rlike(ID)), stamp))


def recent_documents(records: DataFrame) -> DataFrame:
    """The columns of a listing, with defaults for what a record lacks, the record saved last first."""
    defaults = {"status": "ready", "progress": 0, "source_language": "zh", "target_language": "en", "updated_at": ""}
    kinds = dict(records.dtypes)
    value = lambda c: F.coalesce(F.col(c), F.lit(defaults[c])) if kinds[c] in ("string", "int") else F.col(c)
    return records.where("doc_id is not null and name is not null").select("doc_id", "name", *(value(c).alias(c) for c in defaults)).orderBy(F.desc("updated_at"), "doc_id")
