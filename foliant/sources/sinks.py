"""Sinks: versioned tables and exports."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources import readers

#: What follows the id in the names of exports.
TRANSLATED, BILINGUAL = "译文", "双语对照"


def write_version(df: DataFrame, folder: str, partition: str | None = None) -> str:
    """Writes a table as a new version beside the old ones and returns its path; readers never see half of one."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def publish(records: DataFrame, folder: str, now: Column | None = None) -> str:
    """Writes records with a fresh updated_at as a new version, and then its name as a row of ``_versions``: readers of ``current`` see the old version or the whole new one."""
    spark, stamp = records.sparkSession, F.current_timestamp() if now is None else now
    path = write_version(records.withColumn("updated_at", stamp), folder)
    spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at"), F.lit(path.rsplit("-", 1)[-1]).alias("tie")).coalesce(1).write.mode("append").parquet(f"{folder}/_versions")
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version published last."""
    return spark.read.parquet(spark.read.parquet(f"{folder}/_versions").agg(F.max_by("path", F.struct("at", "tie"))).first()[0])


def output_name(name: Column, doc_id: Column, kind: str = TRANSLATED) -> Column:
    """The file name of an export: the stem of the document's name made safe, its id and the kind."""
    base = T.safe_filename(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    return F.concat(base, F.lit("_"), doc_id, F.lit(f"_{kind}.docx"))


def bilingual(segments: DataFrame) -> DataFrame:
    """(doc_id, ordinal, source, translation): every segment, blanks included."""
    return segments.select("doc_id", "ordinal", "source", F.coalesce("translation", F.lit("")).alias("translation"))


def translated(segments: DataFrame, keep_blanks: bool) -> DataFrame:
    """(doc_id, ordinal, text): translations in order; blank ones kept (paragraph by paragraph) or left out (flowing text)."""
    out = segments.select("doc_id", "ordinal", F.coalesce("translation", F.lit("")).alias("text"))
    return out if keep_blanks else out.where(F.length(T.strip(F.col("text"))) > 0)


def exportable(segments: DataFrame) -> DataFrame:
    """(doc_id): documents with any visible translation."""
    return segments.where(F.length(T.strip(F.coalesce("translation", F.lit("")))) > 0).select("doc_id").distinct()


def backfilled(paragraphs: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, mismatched) of templates: (doc_id, ordinal, text), the stripped translation of each paragraph (blank where there is none), for documents with as many paragraphs as segments; (doc_id, n_paragraphs, n_segments) of the others."""
    sizes = [x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((paragraphs, "n_paragraphs"), (segments, "n_segments"))]
    both = sizes[0].join(sizes[1], "doc_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    same = both.where("n_paragraphs = n_segments").select("doc_id")
    rows = segments.join(same, "doc_id", "left_semi").select("doc_id", "ordinal", T.strip(F.coalesce("translation", F.lit(""))).alias("text"))
    return rows, both.where("n_paragraphs <> n_segments")


def filled_templates(files: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, content, error): DOCX files (doc_id, content) with the translations of their segments in place of their paragraphs."""
    texts = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", T.strip(F.coalesce("translation", F.lit(""))).alias("t")))).alias("x"))
    rows = files.join(texts, "doc_id").select("doc_id", "content", F.transform("x", lambda v: v["t"]).alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, content, own in zip(pdf["doc_id"], pdf["content"], pdf["texts"], strict=True):
                try:
                    out.append((doc_id, readers.docx_filled(bytes(content), list(own)), None))
                except Exception as exc:  # one damaged file stops no other
                    out.append((doc_id, None, str(exc)[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "content", "error"])

    return rows.mapInPandas(run, f"doc_id {dict(files.dtypes)['doc_id']}, content binary, error string")


def finalised(records: DataFrame, segments: DataFrame, paths: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(documents to export, counts (removed, exported)) at the end of work; paths: record files and leftovers, each counted once."""
    out = exportable(segments).join(records.select("doc_id"), "doc_id", "left_semi")
    every = paths[0].select("path")
    for more in paths[1:]:
        every = every.union(more.select("path"))
    removed = every.distinct().agg(F.count("*").alias("removed"))
    return out, removed.crossJoin(out.agg(F.count("*").alias("exported")))  # one row each
