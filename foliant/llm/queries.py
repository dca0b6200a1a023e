"""Queries of this subpackage for the driver: each runs an operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, packing, pairs, quality, sentences, splitting, tokens, unify


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sources that are different strings of one look."""
    edits = unify.same_look(_read(spark, folder, "edits"), "seq", "source", ["doc_id", "segment_id"])
    terms = unify.same_look(_read(spark, folder, "terms"), "term_id", "source", [])
    return edits.select(F.lit("edits").alias("tab_name"), "key_a", "key_b").unionByName(terms.select(F.lit("terms").alias("tab_name"), "key_a", "key_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every source that has more than one spelling, and how many rows it is linked to."""
    edits = unify.look_classes(_read(spark, folder, "edits"), "seq", "source", ["doc_id", "segment_id"]).select(F.lit("edits").alias("tab_name"), "key", "class_id", "n_rows", "n_spellings", "links")
    terms = unify.look_classes(_read(spark, folder, "terms"), "term_id", "source", []).select(F.lit("terms").alias("tab_name"), "key", "class_id", "n_rows", "n_spellings", "links")
    return edits.unionByName(terms)


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The one consistent form of every source; rows repeated with a key count once."""
    edits = unify.unify(_read(spark, folder, "edits").select(F.lit("edits").alias("tab_name"), F.col("seq").alias("key"), "source"), "source")
    terms = unify.unify(_read(spark, folder, "terms").select(F.lit("terms").alias("tab_name"), F.col("term_id").alias("key"), "source"), "source")
    return edits.unionByName(terms).groupBy("tab_name", "key").agg(F.first("unified").alias("unified"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence unit of sources and translations."""
    return sentences.sentence_units(_read(spark, folder, "edits"), "seq", ["source", "translation"])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(_read(spark, folder, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or piece of one, measured in tokens."""
    sizes = tokens.token_ids(_read(spark, folder, "documents"), "doc_id", "text", "tokens", counts_only=True)
    return packing.containers(sizes, "doc_id", "tokens")


def _common_words(spark: SparkSession, folder: str, most: int = 100_000) -> frozenset[str]:
    """The list of frequent words; a fixed table, refused above ``most`` rows as it goes to every task."""
    words = [r[0] for r in _read(spark, folder, "common_words").select(F.lower("word")).where("word <> ''").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(words)


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Quality statistics and the verdict of every document."""
    return quality.statistics(_read(spark, folder, "documents"), "doc_id", "text", _common_words(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not prose."""
    return p8_stats(spark, folder).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p3_unified, p5_found, p6_ids, p7_containers, p8_found, p8_stats)}
#: SQL for DuckDB, where it can express the operator over whole tables.
_STOPS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.,;:!?。，；：！？、…]"
SQL: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT seq, CASE WHEN list_max(list_transform(regexp_split_to_array(source, '{_STOPS}'), lambda x: length(x))) > 1200 THEN 'hard' ELSE 'soft' END AS kind FROM edits WHERE length(source) > 1200",
}


def _model(spark: SparkSession, folder: str) -> langid.Model:
    """The classifier, trained on the table of labelled sentences (at most langid.MOST_SAMPLES rows are used)."""
    rows = _read(spark, folder, "lang_samples").where("lang is not null and text is not null").select("lang", "text").orderBy("sample_id").limit(langid.MOST_SAMPLES).collect()
    return langid.train([tuple(r) for r in rows])


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document, each requested document and each one-language stretch of the edits."""
    model = _model(spark, folder)
    docs = langid.detect(_read(spark, folder, "documents"), ["doc_id"], "text", model)
    docs = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_key"), F.lit(0).alias("stretch"), "lang", "confidence")
    edits = langid.stretches(_read(spark, folder, "edits"), ["seq"], "source", model).select(F.lit("stretch").alias("kind"), F.col("seq").alias("item_key"), "stretch", "lang", "confidence")
    asked = _requested(spark, folder, model).select(F.lit("request").alias("kind"), F.col("request_id").alias("item_key"), F.lit(0).alias("stretch"), "lang", "confidence")
    return docs.unionByName(edits.dropDuplicates(["item_key", "stretch"])).unionByName(asked)


def _requested(spark: SparkSession, folder: str, model: langid.Model) -> DataFrame:
    """(request_id, source_language, lang, confidence): the language of most segments of each requested document."""
    found = langid.detect(_read(spark, folder, "segments"), ["doc_id", "ordinal"], "source", model).where("lang is not null")
    once = found.groupBy("doc_id", "ordinal").agg(F.first("lang").alias("lang"))  # repeated rows count once
    votes = once.groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    most = votes.groupBy("doc_id").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), (F.max("n") / F.sum("n")).alias("confidence"))
    requests = _read(spark, folder, "translation_requests").groupBy("request_id").agg(F.first("doc_id").alias("doc_id"), F.first("source_language").alias("source_language"))
    return requests.join(most, "doc_id").select("request_id", "source_language", "lang", "confidence")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and documents whose label is missing or wrong, and edits in several languages."""
    model = _model(spark, folder)
    wrong = lambda label: langid.label_code(F.col(label)).isNull() | (langid.label_code(F.col(label)) != F.col("lang"))
    asked = _requested(spark, folder, model).where(wrong("source_language"))
    docs = langid.detect(_read(spark, folder, "documents"), ["doc_id", "lang"], "text", model, out="found").where("found is not null")
    docs = docs.withColumnRenamed("lang", "label").withColumnRenamed("found", "lang").where(wrong("label"))
    edits = langid.detect(_read(spark, folder, "edits").where("source is not null"), ["seq"], "source", model).where(F.size("whole") > 1)
    return (
        asked.select(F.lit("request").alias("kind"), F.col("request_id").alias("item_key"), "lang")
        .unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_key"), "lang"))
        .unionByName(edits.select(F.lit("edit").alias("kind"), F.col("seq").alias("item_key"), F.explode("whole").alias("lang")))
        .distinct()
    )


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered pieces of every source, each of repeated rows once."""
    return splitting.split(_read(spark, folder, "edits"), "seq", "source").select("seq", "piece", "start_char", "end_char", "cut").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources above the limit."""
    return splitting.oversized(_read(spark, folder, "edits"), "seq", "source")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs with their defect."""
    return pairs.broken_pairs(_read(spark, folder, "edits"), "seq", "source", "translation", ["doc_id", "segment_id"], _model(spark, folder))


QUERIES |= {f.__name__: f for f in (p4_found, p1_found, p1_pieces, p2_found, p2_languages)}
