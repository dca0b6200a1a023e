"""Glossary terms: normalising, orienting, and matching them in texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Terms (and characters of all of them) up to which one automaton goes to every task; beyond, terms are joined by their first characters.
MOST_TERMS, MOST_CHARS, PREFIX = 100_000, 8_000_000, 4


def normalized(terms: DataFrame) -> DataFrame:
    """Terms with both sides present, fields stripped, language codes in lower case; a missing field is empty."""
    kept = terms.where((F.length("source") > 0) & (F.length("target") > 0))
    plain = {c: T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "target", "domain", "notes")}
    codes = {c: F.lower(T.strip(F.coalesce(F.col(c), F.lit("")))) for c in ("source_lang", "target_lang")}
    return kept.withColumns(plain | codes)


def oriented(terms: DataFrame, source: str, target: str) -> DataFrame:
    """Normalised terms that serve a direction: without a language on one side, in it, or in its reverse, which is turned round."""
    forward = (F.col("source_lang") == source) & (F.col("target_lang") == target)
    reverse = (F.col("source_lang") == target) & (F.col("target_lang") == source)
    kept = terms.where((F.col("source_lang") == "") | (F.col("target_lang") == "") | forward | reverse)
    turned = {a: F.when(reverse, F.col(b)).otherwise(F.col(a)) for a, b in (("source", "target"), ("target", "source"), ("source_lang", "target_lang"), ("target_lang", "source_lang"))}
    return kept.withColumns(turned)


def matches(texts: DataFrame, key: str, text: str, terms: DataFrame, term_key: str, source: str = "source", most_terms: int = MOST_TERMS) -> DataFrame:
    """(key, term_key): terms whose folded source occurs in the folded text, without word boundaries; each pair once.

    The number and size of the terms is checked: within the bounds an Aho-Corasick automaton goes to the tasks
    and texts are scanned once, whatever the number of terms; beyond, terms meet the beginnings of ``PREFIX``
    characters in a text, and are compared with the text then. Sizing the terms is a job that runs when this is called.
    """
    kinds = dict(texts.dtypes) | {term_key: dict(terms.dtypes)[term_key]}
    folded = terms.select(F.col(term_key).alias("_t"), T.casefold(F.col(source)).alias("_s")).where(F.length("_s") > 0)
    size = folded.agg(F.count("*"), F.coalesce(F.sum(F.length("_s")), F.lit(0))).first()
    hay = texts.select(F.col(key).alias("_k"), T.casefold(F.col(text)).alias("_x")).where("_x is not null")
    if size[0] <= most_terms and size[1] <= MOST_CHARS:
        words: dict[str, list] = {}
        for t, s in folded.collect():
            words.setdefault(s, []).append(t)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w, ids in words.items():
                machine.add_word(w, ids)
            if words:
                machine.make_automaton()
            for pdf in frames:
                keys, ids = [], []
                for k, x in zip(pdf["_k"], pdf["_x"], strict=True):
                    found = {t for _, own in machine.iter(x) for t in own} if words else ()
                    keys += [k] * len(found)
                    ids += found
                yield pd.DataFrame({"_k": keys, "_t": ids})

        out = hay.mapInPandas(scan, f"_k {kinds[key]}, _t {kinds[term_key]}")
    else:
        # the beginnings meet without the text, which is attached to the pairs that may match and read again there
        heads = folded.withColumn("_head", F.left("_s", F.lit(PREFIX)))
        each = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("_x")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.substring(F.col("_x"), i, n))))))
        maybe = hay.where(F.length("_x") > 0).select("_k", each.alias("_head")).distinct().join(heads, "_head").select("_k", "_t", "_s")
        asked = maybe.groupBy("_k").agg(F.collect_set(F.struct("_t", "_s")).alias("_asked"))  # of one text, at most the terms whose beginning it has
        out = hay.join(asked, "_k").select("_k", F.explode(F.filter("_asked", lambda w: F.contains(F.col("_x"), w["_s"]))).alias("_w")).select("_k", "_w._t").distinct()
    return out.select(F.col("_k").alias(key), F.col("_t").alias(term_key))


def first_matches(found: DataFrame, terms: DataFrame, key: str, term_key: str, order: list[str], limit: int = 120) -> DataFrame:
    """found with ``rank``: the first ``limit`` terms of each text in the order of the glossary (a top-k per group)."""
    ranked = found.join(terms.select(term_key, *order), term_key).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order, term_key)))
    return ranked.where(F.col("rank") <= limit).select(key, term_key, "rank")
