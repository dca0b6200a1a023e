import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import charspace as cs
from foliant.llm import langid, pairs

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def samples():
    return duckdb.connect().sql(f"select lang, text from '{DATA}/lang_samples.parquet' order by sample_id").fetchall()


@pytest.fixture(scope="module")
def model(samples):
    return langid.train(samples)


def main_of(model, texts):
    return [x.as_py() for x in langid._summary(cs.flat(pa.array(texts, pa.string())), model, np.array(model.langs))[0]]


def test_held_out_accuracy(samples):
    held = langid.train([s for i, s in enumerate(samples) if i % 4])
    test = [s for i, s in enumerate(samples) if i % 4 == 0]
    got = main_of(held, [t for _, t in test])
    right = np.mean([g == lang for g, (lang, _) in zip(got, test, strict=True)])
    assert right >= 0.97
    sure = np.array(langid._summary(cs.flat(pa.array([t for _, t in test])), held, np.array(held.langs))[1].to_pylist(), float)
    assert abs(np.nanmean(sure) - right) <= 0.05  # confidence is about the share of right answers


def test_unreadable_and_look_alikes(model):
    texts = [None, "", " \n", "AB-123; 4500 V", "<td class=\"c4\"></td><br/><p><div></tr>", "4pj38yAtQVEUNd8SSrcc/4eS7L0QAov", "vmtg cvwbqvr xvslcg hvn", "Тhе ореrаtоr mоvеѕ the рumр оutdооrѕ.", "Ｔｈｅ ｏｐｅｒａｔｏｒ ｍｏｖｅｓ ｔｈｅ ｐｕｍｐ."]
    assert main_of(model, texts) == [None] * 7 + ["en", "en"]


LABELS = [("zh", "zh"), (" ZH ", "zh"), ("zh_Hans", "zh"), ("Chinese", "zh"), ("en-GB", "en"), ("English", "en"), ("es-MX", "es"), ("fr-BE", "fr"), ("Thai", "th"), ("und", None), ("n/a", None), ("auto", None), ("", None), (" ", None), (None, None), ("JA", "ja")]


def test_labels(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LABELS)], "i int, l string")
    got = {r.i: r.c for r in df.select("i", langid.label_code(F.col("l")).alias("c")).collect()}
    assert [got[i] for i in range(len(LABELS))] == [c for _, c in LABELS]


def test_mixed(spark, model):
    mixed = "The operator moves the pump outdoors every day. 操作员在户外检查水泵，温度为 3.5 度。\nGrünfeldt 公司订购 AB-123 型泵。"
    df = spark.createDataFrame([(1, mixed), (2, "操作员在户外检查水泵。Grünfeldt 公司与 Ostrelle 公司适用。"), (3, None)], "seq bigint, source string").selectExpr("*", "1 as whole", "source as lang")
    got = {r.seq: r for r in langid.detect(df, ["seq"], "source", model).collect()}
    assert got[1].whole == ["en", "zh"] and got[2].whole == ["zh"] and got[2].lang == "zh" and got[3].lang is None and 0 <= got[1].confidence <= 1
    runs = sorted((r.seq, r.stretch, r.lang) for r in langid.stretches(df, ["seq"], "source", model).collect())
    assert runs == [(1, 0, "en"), (1, 1, "zh"), (2, 0, "zh")]


def test_defects(spark, model):
    zh = ["操作员在户外检查水泵。", "供应商在码头订购图纸，期限为 12 天。", "财务处每周在泵站测试阀门。", "译员立即更换轴承。", "实验室在现场密封样品。", "仓库管理员在二楼移动电缆。"]
    en = ["The operator checks the pump outdoors.", "The supplier orders the drawing at the quay, within 12 days.", "The finance office tests the valve at the pumping station every week.", "The translator replaces the bearing at once.", "The laboratory seals the sample on site.", "The warehouse keeper moves the cable on the second floor."]
    rows = []
    for k in range(12):  # sound pairs, the same sentence in many segments
        rows += [(len(rows) + i, f"d{k}", f"s{i}", zh[i], en[i]) for i in range(6)]
    bad = [
        (zh[0], "", "empty"), (zh[1], "TBD", "empty"), (zh[2], "（空）", "empty"), (zh[3], "​ \n", "empty"),
        (zh[0], "Sorry, I cannot help with this text.", "refusal"), (zh[2], "Sorry, I cannot help with this text.", "refusal"), (zh[3], "Sorry, please rephrase it.", "refusal"), (zh[4], "Sorry, I cannot help with this text.", "refusal"),
        (zh[1] + zh[2], zh[1] + zh[2], "copy"), (en[1], en[1], "copy"), (zh[0], "Der Bediener prüft die Pumpe im Freien und bewegt die Kiste.", "wrong_language"), (en[0] + " " + en[3], en[2] + " " + en[4], "wrong_language"),
        (zh[0] + zh[1] + zh[2] + zh[3], en[0] + " " + en[1], "truncated"), (zh[1], "The supplier orders the drawing at the", "truncated"),
    ]
    sound = [("AB-1; 4500 V", "AB-1; 4500 V"), (zh[1], en[1][:-1]), (None, "x"), (zh[0], None)]
    first = len(rows)
    rows += [(first + i, f"b{i}", "s", s, t) for i, (s, t, _) in enumerate(bad)] + [(first + 100 + i, f"c{i}", "s", s, t) for i, (s, t) in enumerate(sound)]
    rows.append(rows[first])
    df = spark.createDataFrame(rows, "seq bigint, doc_id string, segment_id string, source string, translation string").selectExpr("*", "1 as lang", "'x' as clause")
    out = [tuple(r) for r in pairs.broken_pairs(df, "seq", "source", "translation", ["doc_id", "segment_id"], model).collect()]
    assert len(out) == len({q for q, _ in out})
    assert dict(out) == {first + i: d for i, (_, _, d) in enumerate(bad)}


def test_breaks_off_without_terminator_in_the_prompt(model):
    """Thai has no terminators and other prompts may lack theirs: their broken-off responses are found, complete ones, headings and codes are not."""
    thai = "บริษัท Sørvalen อนุมัติคู่มือการใช้งานทุกวันโดยคลาดเคลื่อนไม่เกิน 34.96 มิลลิเมตร"
    cases = [
        (thai, "Sørval", True), (thai, "Sørvalen 公司每天批准操作手册，误差不超过 34.96 毫米。", False), ("2. ตู้ควบคุม", "2. 电子联轴器", False),
        ("Ardenfjord orders the invoice by the end of the year, at a pressure of 31.6 bar", "Ardenfj", True), ("Three-phase guarantee", "三相保函", False),
        ("安装工首次使用时检查焊缝，型号为 KR-8704。\n#19-4", "The fitter checks the weld seam at first use, model KR-8704.\n#19-4", False),
    ]
    made = pairs._facts(*(cs.flat(pa.array(list(x), pa.string())) for x in list(zip(*cases, strict=True))[:2]), model)
    assert made[4].to_pylist() == [c[2] for c in cases]


def templates_of(spark, rows):
    """The templates among (clause, lang, prompt) of pairs in segments of their own."""
    flat = [(*r, "d", str(i), False, False) for i, r in enumerate(rows)]
    df = spark.createDataFrame(flat, "clause string, lang string, prompt string, doc_id string, segment_id string, empty boolean, copy boolean")
    return {r.clause for r in pairs.refusal_templates(df, ["doc_id", "segment_id"]).collect()}


def test_refusals_of_a_skewed_table(spark):
    """One prompt opening holds a third of the pairs, of the refusals as well."""
    openings = ["".join(chr(0x4E00 + 7 * (97 * k + j)) for j in range(9)) for k in range(31)]
    said = ["".join(chr(97 + (k * 7 + j * (k % 5 + 1)) % 26) for j in range(25)) for k in range(31)]
    prompts = [openings[0]] * 30 + openings[1:] * 2
    sound = [(said[openings.index(p)], "zh", p) for p in prompts * 9]
    assert templates_of(spark, sound + [("icannothelpwiththis", "zh", p) for p in prompts]) == {"icannothelpwiththis"}


def test_variants_of_a_refusal_count_together(spark):
    """Variants that occur once each are one template; variants of a sound response come from variants of a prompt."""
    openings = ["".join(chr(0x4E00 + 7 * (97 * k + j)) for j in range(9)) for k in range(20)]
    refusals = [f"iamsorrybuticannothelpyouwiththetranslationofthistextdear{x}" for x in "abcdefgh"]
    sound = [f"thefittermovesthepumpfromthemainhalltothefarendofthestation{x}" for x in "abcdefgh"]
    rows = [(c, "zh", p) for c, p in zip(refusals, openings, strict=False)]
    rows += [(c, "zh", "安装工把水泵从主车间移到车站" + x) for c, x in zip(sound, "甲乙丙丁戊己庚辛", strict=True)]
    rows += [(f"{chr(97 + k)}{chr(100 + k)}xq" * 4, "zh", p) for k, p in enumerate(openings) for _ in range(3)]
    assert templates_of(spark, rows) == set(refusals)


def test_wrong_language_of_ideographs_alone(model):
    """Whether Japanese or Chinese, a prompt of ideographs is answered in English or Chinese."""
    cases = [
        ("契約書", "Der Vertrag wird von dem Lieferanten unterschrieben und geprüft.", True), ("圧力計", "Манометр", True), ("変圧器", "หม้อแปลงไฟฟ้า", True), ("契約書", "ケーブルをけんさする。", True),
        ("契約書", "The contract is signed and checked by the supplier.", False), ("契約書", "Agreement", False), ("圧力計", "压力表", False), ("変圧器", "變壓器", False), ("契約書", "AB-12", False),
    ]
    sides = [cs.flat(pa.array(list(x), pa.string())) for x in list(zip(*cases, strict=True))[:2]]
    assert set(main_of(model, sides[0].to_pylist())) == {"ja"}
    assert pairs._facts(*sides, model)[3].to_pylist() == [c[2] for c in cases]


def test_links_of_the_bands(samples):
    """Links of MinHash bands against all pairs of similar clauses."""
    rows = duckdb.connect().sql(f"select distinct translation from '{DATA}/edits.parquet' where length(translation) > 0 order by 1").fetchall()
    clauses = sorted({pairs.opening(t, k) for (t,) in rows for k in (0, 1)} - {""})
    clauses += [c[:-1] for c in clauses if len(c) > 24]
    h = pairs._signatures(cs.flat(pa.array(clauses)))
    true = banded = 0
    for q in range(0, len(clauses), 20):
        for i, c in enumerate(clauses):
            if i != q and 0.7 < len(c) / len(clauses[q]) < 1.5 and pairs.jaccard(c, clauses[q]) >= pairs.SIMILAR:
                true, banded = true + 1, banded + bool((h[q] == h[i]).any())
    assert true > 50 and banded >= 0.9 * true


def test_whole_texts_are_read():
    """Neither a heading nor a clause is looked for in a prefix only."""
    heading = "\n".join(["Heading of some length without any mark"] * 40) + "\n"
    assert pairs.opening(heading + "I am sorry, not possible. More") == "iamsorry" and pairs.opening(heading + "I am sorry, not possible. More", 1) == "notpossible"
    assert pairs.opening("x" * 300 + ". Y") == "x" * 300 and pairs.opening("") == "" and pairs.opening("one line") == "oneline"
    assert pairs._broken_off("Ab 12. " + "x" * 200 + " 34 y.", "12 and 34 " + "z" * 300, False) is False and pairs._broken_off("At 34 bar " + "x" * 200 + ".", "z" * 300, False)
