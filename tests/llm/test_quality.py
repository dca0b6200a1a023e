import random
import re

import pyarrow as pa
import pytest

from foliant.llm import charspace as cs
from foliant.llm import quality

COMMON = frozenset("the of and in 的 在 から ที่ และ".split())
PROSE = "The pump in the hall is checked by the fitter every day. It runs without noise.\n"
CASES = {
    "prose": [PROSE * 3, "操作员在户外检查水泵。供应商订购图纸。", "A heading\n" + PROSE * 4 + "- one item\n", "Type PVC or XPS with DN, see the RFC of the BMWK, and the hall is dry.", "THE PUMP RUNS. THE FITTER CHECKS IT AND THE CREW MOVES ON.", "The pump in the hall is\nchecked by the fitter every\nday. It runs without noise\nand the crew moves on."],
    "list": ["- pump\n- valve x 3\n- crate\n- fan", "Heading\n1. pump\n2. valve\n3. crate (5)\n4. fan;", "水泵\n阀门 x 4\n图纸\n电缆", "☐ pump\n  ☐ valve\n☐ crate"],
    "table": ["a | b | c\n1 | 2 | 3\n4 | 5 | 6", "a,b,c,d\npump,,3,2025-01-01\nvalve,2,4,2025-01-02", "pump\t3\t4.5%\nvalve\t6\t7%", "pump     crate     12\nvalve    fan       13\nfilter   lamp      14", "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |"],
    "junk": ["\n".join(["4pj38yAtQVEUNd8SSrcc/4eS7L0QAovDDFCT3N8JsPqW"] * 1 + ["GhNhAlmB55F8OIykfu3T56kMeopcUhxvKdtvjGomDRd0"]), "00000000  7a 82 4b a5 41 b7 52 a9 31 cc\n00000010  8d 0f ed ad 9e fe 4e 74 b8 aa", '<td class="c4"></td><br/><p style="w">\n<div></tr><tr>&nbsp;</td>', "�■?░5·…□◇▒6 ◆?■·░□ ▒�◇■", PROSE * 40, "pump valve " * 60, "lm|qpzp bm' r.cl q!mtp| cgv` 'j hqc; xlzs1ln .sldg!s l tl| qkrdml gw.rx.g gm 'n !l|w qwn sgftkwz", "å®�è£�å·¥å¤©ä¿�ç®¡é�"],
    "blank": ["", " \n\t", None, "​"],
}


def run(spark, texts, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as kind", "2 as words", "3 as _n")
    return {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", COMMON, **k).collect()}


def test_verdicts(spark):
    flat = [(kind, t) for kind, texts in CASES.items() for t in texts]
    got = run(spark, [t for _, t in flat])
    assert [(kind, t) for i, (kind, t) in enumerate(flat) if got[i].kind != kind] == []


def test_counts(spark):
    text = "The pump, in the hall.\nit's 3.5 的水泵 x"
    r = run(spark, [text])[0]
    words = re.findall(r"[A-Za-z0-9]+|[一-鿿]", text)
    assert r.words == len(words) and r.mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    assert r.common_share == pytest.approx(sum(w.lower() in COMMON for w in words) / len(words)) and r.lines == 2 and r.end_share == 0.5
    blank = run(spark, [None])[0]
    assert blank.words == 0 and blank.mean_word_length is None and blank.kind == "blank"


def test_chunks_do_not_matter(spark):
    rng = random.Random(5)
    pool = ["word ", "longerword", "\n", "。", "的", "から", "และ", "ช่าง", " | ", "12", ".", "- item\n", "​", "  ", "Ab", "the ", ",", "\t"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 120))) for _ in range(40)] + ["x" * 100, "\n" * 50, "a b\n" * 30, ""]
    whole = run(spark, texts)
    for chunk in (7, 33):
        assert run(spark, texts, chunk=chunk) == whole


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.statistics(df, "doc_id", "text", COMMON).count() == 0


def test_length_is_no_repetition(spark):
    """Long documents of different lines or words are no junk; lines and words repeated over many chunks are."""
    rng = random.Random(8)
    table = "".join(f"{k}|{k * 7}|x{k}\n" for k in range(40_000))
    prose = "".join(chr(0x4E00 + rng.randrange(2_000)) + ("。\n" if k % 40 == 39 else "") for k in range(1_200_000))
    page = "".join(f"The fitter of hall {k} checks pump {k * 3} and the crew moves on.\n" for k in range(400))
    got = run(spark, [table, prose, page * 6, "pump valve " * 20_000])
    assert [got[k].kind for k in range(4)] == ["table", "prose", "junk", "junk"]


def test_cut_by_bytes():
    """Chunks of any texts, empty ones included, are those of slicing by characters."""
    rng = random.Random(4)
    for chunk in (1, 3, 50):
        texts = [rng.choice(["", "a", "é中𠮷" * rng.randrange(40), "x" * rng.randrange(200), "", "​​"]) for _ in range(60)]
        pieces, row, number, count = quality._cut(cs.flat(pa.array(texts)), chunk)
        want = [(r, n, t[i : i + chunk]) for r, t in enumerate(texts) for n, i in enumerate(range(0, max(len(t), 1), chunk))]
        assert list(zip(row.tolist(), number.tolist(), pieces.to_pylist(), strict=True)) == want
        assert all(count[i] == -(-max(len(texts[r]), 1) // chunk) for i, (r, _, _) in enumerate(want))


def test_hidden_characters_between_chunks(spark):
    """Words go on behind any number of hidden characters and in chunks of one character."""
    long = frozenset({"การเปลี่ยนแปลงอย่างต่อเนื่อง", "the"})
    texts = ["ก" + "​" * 300 + "ารเปลี่ยนแปลงอย่างต่อเนื่อง", "การเปลี่ยนแปลงอย่างต่อเนื่อง th" + "​" * 90 + "e end\n1" + "​" * 70 + "2. item", "​" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sorted(map(tuple, quality.statistics(df, "doc_id", "text", long).collect()))
    assert [r[5] for r in whole] == [pytest.approx(x) if x is not None else None for x in (whole[0][5], whole[1][5], None)]
    for chunk in (1, 4, 64):
        assert sorted(map(tuple, quality.statistics(df, "doc_id", "text", long, chunk=chunk).collect())) == whole


def test_many_different_lines_in_many_runs(spark):
    text = "".join(f"The fitter of hall {k} checks pump {k * 3} and the crew of {k % 97} moves on.\n" for k in range(400_000))
    got = run(spark, [text, None, "pump"])
    assert got[0].lines == 400_000 and got[0].kind == "prose" and got[0].words == text.count(" ") + 400_000 and got[1].kind == "blank" and got[2].words == 1
