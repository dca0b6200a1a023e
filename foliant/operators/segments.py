"""From texts to segments, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

#: File types read, and those whose paragraphs are segments as they are.
SUFFIXES, WHOLE_PARAGRAPHS = ["doc", "docx", "pdf"], ["doc", "docx"]


def segment_id(ordinal: Column) -> Column:
    """s and the ordinal with at least four digits."""
    return F.format_string("s%04d", ordinal)


def paragraph_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal from 1, source): the paragraphs of each text."""
    return df.select(key, F.posexplode(T.paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("_p", "source")).select(key, (F.col("_p") + 1).alias("ordinal"), "source")


def segment_rows(df: DataFrame, key: str, text: str, most: int = 1200) -> DataFrame:
    """(key, ordinal from 1, segment_id, source): each text cleaned and packed into segments of at most ``most`` characters."""
    packed = df.select(key, T.clean(F.coalesce(F.col(text), F.lit(""))).alias("_clean")).select(key, F.posexplode(T.pack(F.col("_clean"), most)).alias("_p", "source"))
    return packed.select(key, (F.col("_p") + 1).alias("ordinal"), segment_id(F.col("_p") + 1).alias("segment_id"), "source")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``ordinal`` from 1 in the order of several columns; a window over one document, whose first column parts it into blocks.

    Blocks of a document (pages, paragraphs) are counted first, so no task holds more than one block.
    """
    counts = rows.groupBy(key, order[0]).agg(F.count("*").alias("_n"))
    before = counts.select(key, order[0], (F.sum("_n").over(Window.partitionBy(key).orderBy(order[0])) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, order[0]).orderBy(*order[1:]))
    return rows.withColumn("_at", inner).join(before, [key, order[0]]).withColumn("ordinal", (F.col("_before") + F.col("_at")).cast("int")).drop("_before", "_at")


def deduplicated(segments: DataFrame, key: list[str], latest: str | None = None) -> DataFrame:
    """One row a key: that with the greatest ``latest`` where given, else any one.

    Rows repeated with a key (and ``latest``) are copies of each other. Each column is an aggregate of its own, so
    columns that are not used later are neither read nor shuffled.
    """
    rest = [c for c in segments.columns if c not in key]
    one = (lambda c: F.max_by(c, latest)) if latest else F.first
    return segments.groupBy(*key).agg(*(one(c).alias(c) for c in rest)).select(*segments.columns)


def coverage(segments: DataFrame, key: str, translation: str) -> DataFrame:
    """(key, total, translated, progress): segments, those with a visible translation, and the half-even rounded percentage."""
    done = F.count_if(F.length(T.strip(F.coalesce(F.col(translation), F.lit("")))) > 0)
    counts = segments.groupBy(key).agg(F.count("*").alias("total"), done.alias("translated"))
    return counts.select(key, "total", "translated", F.bround(F.lit(100.0) * F.col("translated") / F.col("total"), 0).cast("int").alias("progress"))


def split_by_type(df: DataFrame, path: str, size: str | None = None, most: int = 80 * 1024 * 1024) -> DataFrame:
    """df with ``suffix`` and ``reject``: 415 for a type not read, 413 above ``most`` bytes, else null."""
    suffix = suffix_of(F.col(path))
    code = F.when(~suffix.isin(SUFFIXES), 415)
    return df.withColumn("suffix", suffix).withColumn("reject", code.when(F.col(size) > most, 413) if size else code)


def upload_sizes(chunks: DataFrame, key: str, content: str, most: int = 80 * 1024 * 1024) -> DataFrame:
    """(key, size, reject): the bytes of the chunks of each upload, and 413 above ``most``."""
    sizes = chunks.groupBy(key).agg(F.sum(F.coalesce(F.length(content), F.lit(0))).cast("bigint").alias("size"))
    return sizes.withColumn("reject", F.when(F.col("size") > most, 413))


#: Types of images that may be compared with each other.
IMAGES = ["png", "jpg", "jpeg", "webp", "gif", "bmp"]


def compared(files: DataFrame, group: str, order: str, path: str) -> DataFrame:
    """(group, left, right, comparable): the first two files of each group, which may be compared if both are documents or both images."""
    two = F.row_number().over(Window.partitionBy(group).orderBy(order))
    firsts = files.withColumn("_n", two).where("_n <= 2")  # a top-k of each group
    pair = firsts.groupBy(group).agg(*(F.max(F.when(F.col("_n") == n, F.col(path))).alias(side) for n, side in ((1, "left"), (2, "right"))))
    kind = lambda c: F.when(suffix_of(F.col(c)).isin(SUFFIXES), "document").when(suffix_of(F.col(c)).isin(IMAGES), "image")
    return pair.withColumn("comparable", F.coalesce(kind("left") == kind("right"), F.lit(False)))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))
