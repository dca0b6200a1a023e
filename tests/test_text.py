import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("text", "want"), [(" a \t b\r\n\r\n　c \x00 ", "a b\nc"), ("\t\n ", ""), ("a\xa0 b", "a\xa0 b"), ("", ""), (None, None)])
def test_clean(spark, text, want):
    assert one(spark, text, T.clean) == want


@pytest.mark.parametrize(
    ("lines", "want"),
    [(["组合驾驶", "辅助系统"], "组合驾驶辅助系统"), (["senior", "professional"], "senior professional"), (["版本", "v2"], "版本 v2"), (["结束。", "新句"], "结束。新句"), (["他说“", "你好”"], "他说“ 你好”"), (["a", "", "b"], "a b"), ([], "")],
)
def test_join_lines(spark, lines, want):
    assert one(spark, lines, T.join_lines, "array<string>") == want


def test_paragraphs(spark):
    assert one(spark, " a\nb \n \n中\n文\r\n", T.paragraphs) == ["a b", "中文"]
    assert one(spark, "", T.paragraphs) == []


@pytest.mark.parametrize(("text", "want"), [("", "zh"), ("中", "en"), ("中文", "zh"), ("中文" + "a" * 11, "zh"), ("中文" + "a" * 12, "en"), ("123", "en"), ("éà", "en")])
def test_detect_language(spark, text, want):
    assert one(spark, text, T.detect_language) == want


@pytest.mark.parametrize(
    ("text", "most", "want"),
    [
        ("Aa. Bb. Cc. Dd.", 8, ["Aa. Bb.", "Cc. Dd."]),
        ("甲乙。丙丁。戊己。", 6, ["甲乙。", "丙丁。", "戊己。"]),
        ("甲乙。丙丁。戊己。", 7, ["甲乙。丙丁。", "戊己。"]),
        ("abcdefghij. Kl.", 4, ["abcd", "efgh", "ij.", "Kl."]),
        ("v1.2 e.g. this; that", 10, ["v1.2 e.g. ", "this;", "that"]),
        ("", 5, []),
    ],
)
def test_pack(spark, text, most, want):
    assert one(spark, text, lambda c: T.pack(c, most)) == want


@pytest.mark.parametrize(("text", "want"), [("", 1), ("中" * 84, 2.0), ("a" * 200, 2.476190), ("a\nb\nc", 3), ("." * 120, 2.0)])
def test_visual_weight(spark, text, want):
    assert one(spark, text, T.visual_weight) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("text", "want"), [("Ｆｕｌｌ－Ｗｉｄｔｈ １２", "fullwidth12"), ("ﬁne é", "fine"), ("中文，A-1", "中文a1"), ("", ""), (None, None)])
def test_match_key(spark, text, want):
    assert one(spark, text, T.match_key) == want


def test_casefold(spark):
    assert one(spark, "STRAßE", T.casefold) == "strasse" and one(spark, "ABC", T.casefold) == "abc"


@pytest.mark.parametrize(("name", "want"), [("a/b\\c?.txt", "c_.txt"), ("", "document"), (None, "document"), ("x" * 200, "x" * 180)])
def test_safe_filename(spark, name, want):
    assert one(spark, name, T.safe_filename) == want


@pytest.mark.parametrize(("s", "t", "d", "want"), [("zh", "zh", "en", ("zh", "en")), ("auto", None, "en", ("en", "zh")), (None, "en", "en", ("en", "zh")), ("en", "zh", "zh", ("en", "zh"))])
def test_direction(spark, s, t, d, want):
    df = spark.createDataFrame([(s, t, d)], "s string, t string, d string")
    assert tuple(df.select(T.direction(F.col("s"), F.col("t"), F.col("d")).alias("r")).first().r) == want
