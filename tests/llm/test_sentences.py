import pytest

from foliant.llm import sentences

CASES = [
    ("The pump. The valve!", 2), ("Dr. J. Q. Olmira et al. tested 6 units, i.e. half of the lot.", 1), ("See Fig. 5 and Sec. 2 of doc. AB-1 for details. Also: next.", 2),
    ("We met at 9 a.m. The lamp is on.", 2), ("The value is .3 mm, v1.2.3 at docs.example.test now.", 1), ("He said: \"Wait! Not yet,\" and left.", 1),
    ('The label reads "Keep dry. Do not stack." and must stay visible.', 1), ('He asked: "Who closed it? Who opened it?" The fitter left.', 2), ("(The lid stays closed.) The pump runs.", 2),
    ("Put bolts, nuts, etc. into box No. 20. We apologise.", 2), ("Does it blink?! Yes.", 2), ("The value drifts ... and then settles.", 1), ("Nobody answered... The pump runs.", 2),
    ("with 3 mm.The next one.", 2), ("12. Flameproof valve", 1), ("6.2 Valve\nThe pump runs.", 2), ("settles at 28.20 V. The pump runs.", 2),
    ("Die Teile, z. B. Nr. 30, kommen am 3. Mai an. Ca. 5 Stück fehlen.", 2), ("Dr. Côtelle rief: „Halt! Sofort aus!“ Das Labor misst.", 2), ("Siehe Abschn. 4.11, Abs. 2, bzw. Anl. 85.", 1),
    ("Voir la fig. 88, p. 6, du dossier. M. Olmira a noté p. ex. 3,4 V à 20 h. Fin.", 3), ("« Attention ! Ne pas ouvrir. » est écrit sur la porte 4.", 1),
    ("La Sra. Olmira revisó el art. 90, párr. 2. ¿Está lista la pág. 3? Sí.", 3), ("El rótulo dice: «¡Alto! No abrir.» La bomba va.", 2),
    ("См. рис. 91 и стр. 11 отчёта. Груз весит 3 кг, т. е. половину.", 2), ("Цех работает с 8.30 до 17.00. Насос стоит.", 2),
    ("Le filtre est prêt. « Attention ! Ne pas ouvrir. » est écrit. Fin.", 3), ("sur place.M. Olmira part.", 2), ("Он ушёл. См. риc. 5 и стр. 1.", 2), ("Der Termin ist der ４． Ｊｕｎｉ um drei.", 1),
    ("水泵。阀门！停？！好。", 4), ("标签上的“保持干燥。请勿堆放。”字样必须可见。", 1), ("安装工写道：“已破损。”操作员检查。", 2), ("“等等！还没好，”安装工喊道。", 1), ("数值先漂移……随后稳定。", 1),
    ("无人回答……操作员检查。", 2), ("（盖子关闭。）操作员检查。", 2), ("变压器.客户代表检查.", 2), ("温度为 3.5 度；完成。", 1),
    ("「待て！まだだ。」と叫んだ。次へ。", 2), ("画面に「停止。再起動。」と表示される。", 1),
    ("ช่างวัดวาล์ว ผู้แปลวัดปั๊ม", 2), ("ช่างวัดปั๊ม AB-1 หนึ่งตัว", 1), ("ไม่เกิน 32.78 มิลลิเมตร ช่างวัด", 2),
    ("a\n\nb\r\nc", 3), ("", 0), (" ​\n", 0), ("-", 1), ("no end", 1), ("📦 The box. 🔧 The tool.", 2), ("Ｔｈｅ ｂｏｘ. Ｔｈｅ tool.", 2), ("Tes​t. ​Nex­t.", 2), ("Мr. Olmira left.", 1),
]


def test_counts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "seq bigint, source string")
    got = {r.seq: r.n for r in df.selectExpr("seq", "source").withColumn("n", sentences.spans(df.source)).selectExpr("seq", "size(n) as n").collect()}
    wrong = [(t, n, got[i]) for i, (t, n) in enumerate(CASES) if got[i] != n]
    assert not wrong


def test_positions(spark):
    text = " 📦 One.  Two 𠮷!\n 三。"
    rows = [(1, text, None), (1, text, None), (2, None, ""), (3, "x" * 40_000 + ". Y", "b")]
    df = spark.createDataFrame(rows, "seq bigint, source string, translation string").selectExpr("*", "1 as field", "2 as units")
    got = sorted(map(tuple, sentences.sentence_units(df, "seq", ["source", "translation"]).collect()))
    assert [(f, text[a:b]) for s, f, a, b in got if s == 1] == [("source", "📦 One."), ("source", "Two 𠮷!"), ("source", "三。")]
    assert [x[1:] for x in got if x[0] == 3] == [("source", 0, 40001), ("source", 40002, 40003), ("translation", 0, 1)]
    assert not [x for x in got if x[0] == 2]
    assert sentences.with_sentences(df.where("seq = 1").limit(1), "source").first().sentences == ["📦 One.", "Two 𠮷!", "三。"]


@pytest.mark.parametrize("n", [3000])
def test_many_sentences(spark, n):
    df = spark.createDataFrame([(1, "Ab c. " * n)], "seq bigint, source string")
    assert sentences.sentence_units(df, "seq", ["source"]).count() == n


def test_long_quotations(spark):
    """A quotation of any length within a sentence is not cut, nor are the terminators in it lost behind it."""
    long = "The pump runs. The fitter waits. " * 12 + "It stops."
    texts = [f"He said “{long}” and left. She stayed.", f"Er sagte „{long}“ und ging. Sie blieb.", f"他说：“{'水泵运行。' * 60}”她离开了。"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.sentences for r in sentences.with_sentences(df, "t").select("k", "sentences").collect()}
    assert [len(got[k]) for k in range(3)] == [2, 2, 2] and [got[k][1] for k in range(3)] == ["She stayed.", "Sie blieb.", "她离开了。"]


def test_placeholders_in_the_input(spark):
    """The private characters used as markers end nothing in the input and move no position."""
    text = "Ab c\ue002d e. Next \ue000one.\ue001\ue003 Last \ue002 one."
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert sentences.with_sentences(df, "t").first().sentences == ["Ab c\ue002d e.", "Next \ue000one.\ue001\ue003 Last \ue002 one."]


def test_headings_of_any_depth(spark):
    texts = ["1.2.3.4. Title", "   " * 5 + "1.2.3.4.5.6.7.8. Title of it", "12345678. Title", "Intro\n1.2.3.4. Title\nThe pump. It runs."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: len(r.sentences) for r in sentences.with_sentences(df, "t").select("k", "sentences").collect()}
    assert [got[k] for k in range(4)] == [1, 1, 1, 4]


def test_long_runs_of_hidden_characters(spark):
    h = "\u200b"
    plain = "D{0}r. Olmira left the hall.{0} The pump, No{0}. 20, runs.{0}\n{0}At 9{0} h. It stops{0}"
    texts = [plain.format(h * n) for n in (0, 1, 2, 3, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.sentences for r in sentences.with_sentences(df, "t").select("k", "sentences").collect()}
    want = ["Dr. Olmira left the hall.", "The pump, No. 20, runs.", "At 9 h.", "It stops"]
    assert all([x.replace(h, "").strip() for x in got[k]] == want for k in range(5))
    assert all(got[k] == [x.replace(h, h * n) for x in got[1]] for k, n in ((2, 2), (3, 3), (4, 40)))


def test_positions_of_many_units(spark):
    """Sums over blocks of blocks are right at any number of units."""
    for n in (1, 31, 32, 33, 1024, 1025, 40_000):
        df = spark.createDataFrame([(1, "Ab c. " * n)], "seq bigint, source string")
        got = sorted((r.start_char, r.end_char) for r in sentences.sentence_units(df, "seq", ["source"]).collect())
        assert got == [(6 * i, 6 * i + 5) for i in range(n)]
