"""Text functions as Spark columns; Arrow functions only where Spark has no exact Unicode counterpart."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware trimming takes it, ideographs that are counted, and characters joined without a space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
IDEOGRAPH = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
JOINED = r"\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}"
#: Where a sentence ends: behind a full-width or strong terminator, or behind a point before white space and a capital, digit or quote.
SENTENCE = rf"(?<=[。！？!?；;])|(?<=[.!?])(?=[{SPACE}]+[A-Z0-9\"'])"


def strip(text: Column) -> Column:
    """The text without white space of any Unicode kind at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(text: Column) -> Column:
    """No NUL, LF line ends, single spaces for runs of space and tab, no blank lines and no space at line ends."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"\r\n?", "\n")
    single = F.regexp_replace(plain, "[ \\t]+", " ")
    return strip(F.regexp_replace(single, rf"[{SPACE}]*\n[{SPACE}]*", "\n"))


def join_two(a: Column, b: Column) -> Column:
    """Two pieces of text joined: directly between characters of scripts without spaces, else by one space."""
    tight = F.right(a, F.lit(1)).rlike(rf"^[{JOINED}]$") & F.left(b, F.lit(1)).rlike(rf"^[{JOINED}]$")
    return F.when(F.length(b) == 0, a).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one text; empty lines after the first are skipped, an empty list gives the empty text.

    What stands between two lines depends on these alone, so each line is joined to what goes before it at once.
    """
    kept = F.filter(lines, lambda x, i: (F.length(x) > 0) | (i == 0))

    def own(ls: Column) -> Column:
        def gap(before: Column, line: Column) -> Column:
            tight = F.right(before, F.lit(1)).rlike(rf"^[{JOINED}]$") & F.left(line, F.lit(1)).rlike(rf"^[{JOINED}]$")
            return F.when(tight, "").otherwise(" ")

        return F.array_join(F.transform(ls, lambda x, i: F.when(i == 0, x).otherwise(F.concat(gap(F.get(ls, i - 1), x), x))), "")

    return F.element_at(F.transform(F.array(kept), own), 1)


def paragraphs(text: Column) -> Column:
    """array<string>: blank lines separate paragraphs, wrapped lines within one are joined; no empty paragraph."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    blocks = F.split(lines, rf"\n[{SPACE}]*\n", -1)

    def one(block: Column) -> Column:
        return join_lines(F.filter(F.transform(F.split(block, "\n", -1), strip), lambda x: F.length(x) > 0))

    return F.filter(F.transform(blocks, one), lambda x: F.length(x) > 0)


#: Sentences folded one after the other; their pieces are put together as lists of lists, so no list grows one by one.
BLOCK = 64


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def pack(text: Column, most: int) -> Column:
    """array<string>: a clean text cut at sentence ends and packed greedily into pieces of at most ``most`` characters.

    A sentence longer than that is cut hard; the separator counts as one character even where none is written.
    Texts up to the limit stay whole and empty texts give no piece. The fold is over the sentences of one text, in
    blocks, so that its time grows in proportion to the text.
    """
    sentences = F.filter(F.transform(F.split(text, SENTENCE, -1), strip), lambda s: F.length(s) > 0)
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        flushed = F.when(F.length(cur) > 0, F.concat(out, F.array(cur))).otherwise(out)
        hard = F.transform(F.sequence(F.lit(1), F.length(s), F.lit(most)), lambda i: F.substring(s, i, F.lit(most)))
        fits = (F.length(cur) + 1 + F.length(s)) <= most
        return (
            F.when(F.length(s) > most, F.struct(F.lit("").alias("cur"), F.concat(flushed, hard).alias("out")))
            .when(F.length(cur) == 0, F.struct(s.alias("cur"), out.alias("out")))
            .when(fits, F.struct(join_two(cur, s).alias("cur"), out.alias("out")))
            .otherwise(F.struct(s.alias("cur"), flushed.alias("out")))
        )

    def folded(ss: Column) -> Column:
        start = F.struct(F.lit("").alias("cur"), F.array().cast("array<array<string>>").alias("outs"))

        def block(acc: Column, k: Column) -> Column:
            own = F.slice(ss, (k * BLOCK + 1).cast("int"), F.lit(BLOCK))
            done = F.aggregate(own, F.struct(acc["cur"].alias("cur"), none.alias("out")), step)
            return _let(done, lambda d: F.struct(d["cur"].alias("cur"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(ss) - 1) / BLOCK))
        last = lambda acc: F.flatten(F.when(F.length(acc["cur"]) > 0, F.concat(acc["outs"], F.array(F.array(acc["cur"])))).otherwise(acc["outs"]))
        return F.when(F.size(ss) > 0, F.aggregate(blocks, start, block, last)).otherwise(none)

    def packed(ss: Column) -> Column:
        return _let(folded(ss), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))

    return F.when(F.length(text) == 0, none).when(F.length(text) <= most, F.array(text)).otherwise(_let(sentences, packed))


def count_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def detect_language(text: Column) -> Column:
    """zh where ideographs are at least two and 18 % of the Latin letters, or nothing is visible; else en."""
    visible = F.regexp_replace(text, rf"[{SPACE}]+", "")
    cjk, latin = count_of(visible, IDEOGRAPH), count_of(visible, "A-Za-z")
    return F.when((F.length(visible) == 0) | (cjk >= F.greatest(F.lit(2.0), latin * F.lit(0.18))), "zh").otherwise("en")


def direction(source: Column, target: Column, detected: Column) -> Column:
    """struct<source, target>: an explicit zh or en wins over the detected language; the target differs from the source."""
    known = lambda c: F.coalesce(c.isin("zh", "en"), F.lit(False))
    other = lambda c: F.when(c == "zh", "en").otherwise("zh")
    s = F.when(known(source), source).otherwise(detected)
    t = F.when(known(target), target).otherwise(other(s))
    return F.struct(s.alias("source"), F.when(t == s, other(s)).otherwise(t).alias("target"))


def visual_weight(text: Column) -> Column:
    """Lines a text takes up on a page of 42 wide characters: at least its line breaks, at least one."""
    visible = F.regexp_replace(text, r"[\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]", "")
    cjk, latin = count_of(visible, IDEOGRAPH), count_of(visible, "A-Za-z0-9")
    other = F.greatest(F.lit(0), F.length(visible) - cjk - latin)
    lines = F.size(F.split(text, "\r?\n", -1))
    return F.greatest(lines.cast("double"), (cjk + latin * F.lit(0.52) + other * F.lit(0.7)) / 42, F.lit(1.0))


def _nfkc_lower(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def _arrow(f: Callable[[pd.Series], pd.Series], text: Column) -> Column:
    """A function of text as an Arrow UDF, made where a session exists."""
    return F.pandas_udf(f, "string")(text)


def match_key(text: Column) -> Column:
    """Compatibility form in lower case, of which ideographs, a-z and 0-9 are kept; ASCII texts stay in the JVM."""
    keep = lambda c: F.regexp_replace(c, rf"[^{IDEOGRAPH}a-z0-9]", "")
    return keep(F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(_arrow(_nfkc_lower, text)))


def casefold(text: Column) -> Column:
    """Full case folding; ASCII texts stay in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(_arrow(_casefold, text))


def safe_filename(name: Column) -> Column:
    """The last part of a path with characters unfit for names replaced, at most 180 characters, ``document`` if nothing is left."""
    base = F.regexp_replace(strip(F.regexp_extract(name, r"([^/\\]*)$", 1)), r"\x00", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(base, r'[<>:"/\\|?*]', "_"), 1, 180), F.lit("")), F.lit("document"))


#: What states and languages are called.
LANGUAGES = {"zh": "中文", "en": "English"}
DOCUMENT_STATES = {"ready": "待翻译", "translating": "翻译中", "completed": "已完成", "error": "出错"}
SEGMENT_STATES = {"empty": "", "queued": "等待翻译", "translating": "正在翻译…", "machine": "机器译文", "edited": "已编辑", "reviewed": "已审校"}


def label(code: Column, names: dict[str, str], other: Column | None = None) -> Column:
    """What a code is called; ``other``, or else the code, where it has no name."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(known, code), code if other is None else other)


def utc_stamp(moment: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, to the second."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def error_class(code: Column) -> Column:
    """Of a reject or status code: what is to be done about it."""
    again = code.isin(408, 409, 425, 429) | code.between(500, 599)
    return F.when(code.isin(0, 200, 202) | code.isNull(), "none").when(code.isin(413, 415, 422), "extraction").when(again, "retryable").otherwise("permanent")
