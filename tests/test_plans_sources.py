import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant import engine
from foliant.config import EngineConfig
from foliant.plans import requests
from foliant.sources import readers, sinks
from foliant.streaming import edits as stream


def test_config_clamps():
    c = EngineConfig(batch_items=99, request_chars=1, max_retries=-2).checked()
    assert (c.batch_items, c.request_chars, c.max_retries) == (10, 500, 0)


def test_parts_and_requests(spark):
    long = "Aa. " * 400
    df = spark.createDataFrame([("d", 1, "s0001", "x"), ("d", 2, "s0002", long), ("d", 3, "s0003", " "), ("d", 4, "s0004", None)], "d string, o int, s string, t string")
    parts = requests.parts(df, ["d", "o", "s"], "t", 600)
    rows = {r.part_id: r.text for r in parts.collect()}
    assert list(sorted(rows)) == ["s0001", "s0002__part0001", "s0002__part0002", "s0002__part0003", "s0003"]
    assert all(len(x) <= 600 for x in rows.values()) and rows["s0003"] == " "
    made = requests.requests(parts, "d", "o", 3, 600).orderBy("request_no").collect()
    sent = [[x["id"] for x in json.loads(r.payload)["segments"]] for r in made]
    assert sum(sent, []) == sorted(rows) and all(r.n_items <= 3 for r in made)


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('```JSON {"translations":[{"id":"s1","text":" a "}]} ```', {"s1": "a"}),
        ('{"translations":[{"id":2,"text":"b"},{"id":"x"},{"id":"y","text":"1"},{"id":"y","text":"2"}]}', {"2": "b", "y": "2"}),
        ('{"other":1}', {}),
        ("[1]", {}),
        ("not json", {}),
        (None, {}),
    ],
)
def test_parsed(spark, content, want):
    df = spark.createDataFrame([("d", content)], "d string, c string")
    assert {r.id: r.text for r in requests.parsed(df, ["d"], "c").collect()} == want


def test_retry(spark):
    df = spark.createDataFrame([(1, None), (3, None), (5, None), (6, None), (1, 50.0), (1, 500.0)], "n int, w double")
    assert [r.d for r in df.select(requests.delay(F.col("n"), F.col("w")).alias("d")).collect()] == [2, 8, 30, 30, 50, 120]
    codes = spark.createDataFrame([(c,) for c in (408, 409, 425, 429, 500, 503, 599, 400, 401, 403, 404, 422, 600)], "c int")
    assert [r.c for r in codes.where(requests.retryable(F.col("c"))).collect()] == [408, 409, 425, 429, 500, 503, 599]
    waits = spark.createDataFrame([("5",), ("900",), ("-1",), ("soon",), (None,)], "h string")
    assert [r.w for r in waits.select(requests.wait_of(F.col("h")).alias("w")).collect()] == [5, 120, 0, None, None]


def test_called_retries(spark):
    def shaky(payload):
        kind = json.loads(payload)["kind"]
        if kind == "bad":
            raise OSError("HTTP 503")
        return "{}" if kind == "ok" else "no json"

    df = spark.createDataFrame([(i, json.dumps({"segments": [], "kind": k})) for i, k in ((1, "ok"), (2, "bad"), (3, "x"))], "k int, payload string")
    got = {r.k: (r.attempt, r.content, r.error is None) for r in requests.called(df, ["k"], shaky, retries=2).collect()}
    assert got[1] == (1, "{}", True) and got[2][0] == 3 and got[2][1:] == (None, False) and got[3][0] == 3 and not got[3][2]


def test_called_by_status_and_missing_ids(spark):
    def gateway(payload):
        ids = [x["id"] for x in json.loads(payload)["segments"]]
        kind = ids[0].rstrip("0123456789")
        if kind == "refused":
            return requests.Reply(400, "bad key")
        if kind == "busy":
            return requests.Reply(503, "later", 50.0)
        answer = {"translations": [{"id": i, "text": "x"} for i in (ids[:-1] if kind == "lacking" else ids)]}
        return requests.Reply(200, json.dumps([answer] if kind == "listed" else answer))

    rows = [(k, json.dumps({"segments": [{"id": f"{k}1", "text": "t"}, {"id": f"{k}2", "text": "t"}]})) for k in ("fine", "refused", "busy", "lacking", "listed")]
    calls = requests.called(spark.createDataFrame(rows, "k string, payload string"), ["k"], gateway, retries=2)
    got = {r.k: r for r in calls.collect()}
    assert {k: (r.attempt, r.content is not None, r.permanent) for k, r in got.items()} == {"fine": (1, True, False), "refused": (1, False, True), "busy": (3, False, False), "lacking": (3, False, False), "listed": (1, False, True)}
    assert [n.delay_seconds for n in got["busy"].notices] == [50.0, 50.0] and [n.delay_seconds for n in got["lacking"].notices] == [2.0, 4.0] and "lacking2" in got["lacking"].error
    items = spark.createDataFrame([("busy", "s2__part0001"), ("busy", "s2__part0002"), ("busy", "s1")], "k string, part_id string")
    log = requests.retry_log(calls, items, ["k"]).where("k = 'busy'").orderBy("retry_number").collect()
    assert [(r.retry_number, r.max_retries, r.segment_ids) for r in log] == [(1, 2, ["s1", "s2"]), (2, 2, ["s1", "s2"])]


def test_instructions_and_bodies(spark):
    kind = "a string, b string, t array<struct<source:string,target:string,domain:string,notes:string>>, payload string"
    df = spark.createDataFrame([("zh", "en", [("术语", "term", "law", ""), ("a", "b", "", ""), ("c", "d", "x", "y")], "{}"), ("en", "de", [], "{}")], kind)
    made = df.withColumn("prompt", requests.instructions(F.col("a"), F.col("b"), F.col("t"), F.lit("")))
    one, two = (r.prompt for r in made.collect())
    assert "Simplified Chinese to English" in one and "- 术语 => term (law)\n- a => b\n- c => d (x; y)" in one and requests.ANSWER in one
    assert "English to de" in two and "none apply" in two and "formal and plain" in two
    body = json.loads(requests.bodies(made, "openai", "m").first().body)
    assert body["model"] == "m" and body["temperature"] == 0.2 and [x["role"] for x in body["messages"]] == ["system", "user"] and body["messages"][0]["content"] == one
    body = json.loads(requests.bodies(made, "anthropic", "m").first().body)
    assert body["max_tokens"] == 8192 and body["system"] == one and body["messages"] == [{"role": "user", "content": "{}"}]


@pytest.mark.parametrize(("base", "protocol", "want"), [("http://h/v1/", "openai", "http://h/v1/chat/completions"), ("http://h", "openai", "http://h/v1/chat/completions"), ("http://h/CHAT/completions", "openai", "http://h/CHAT/completions"), (" http://h/v1", "anthropic", "http://h/v1/messages"), ("http://h", "anthropic", "http://h/v1/messages")])
def test_endpoint(base, protocol, want):
    assert requests.endpoint(base, protocol) == want


def test_response_text(spark):
    openai = [('{"choices":[{"message":{"content":"a\\nb"}}]}', "a\nb"), ('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"text":"b"}]}}]}', "a\nb"), ('{"choices":[]}', None), ("oops", None)]
    df = spark.createDataFrame([(x,) for x, _ in openai], "r string")
    assert [r.t for r in df.select(requests.response_text(F.col("r"), "openai").alias("t")).collect()] == [w for _, w in openai]
    other = [('{"content":[{"type":"text","text":"a"},{"type":"image","text":"no"},{"type":"text","text":"b"}]}', "a\nb"), ('{"content":"a"}', None), ("{}", None)]
    df = spark.createDataFrame([(x,) for x, _ in other], "r string")
    assert [r.t for r in df.select(requests.response_text(F.col("r"), "anthropic").alias("t")).collect()] == [w for _, w in other]


def test_dates_to_wait_for(spark):
    now = F.expr("timestamp '2025-01-01 00:00:00 UTC'")
    heads = [("Wed, 01 Jan 2025 00:00:30 GMT", 30.0), ("Wed, 01 Jan 2025 00:00:30", 30.0), ("Wed, 01 Jan 2025 02:00:30 +0200", 30.0), ("Wed, 01 Jan 2025 09:00:00 GMT", 120.0), ("Tue, 31 Dec 2024 00:00:00 GMT", 0.0), (" 5.5 ", 5.5), ("Wed, 41 Jan 2025 00:00:30 GMT", None), ("soon", None), (None, None)]
    df = spark.createDataFrame([(h,) for h, _ in heads], "h string")
    assert [r.w for r in df.select(requests.wait_of(F.col("h"), now).alias("w")).collect()] == [w for _, w in heads]


def job_tables(spark):
    records = spark.createDataFrame([("a", "zh", "en", "ready", 0, ""), ("b", "en", "zh", "ready", 0, ""), ("c", "zh", "en", "ready", 0, "")], "doc_id string, source_language string, target_language string, status string, progress int, error string")
    rows = [("a", i, f"s{i:04d}", f"甲{i}。", "", "empty", False) for i in range(1, 9)] + [("a", 9, "s0009", "乙", "old", "edited", False), ("a", 10, "s0010", "丙", "", "empty", True)]
    rows += [("b", 1, "s0001", "Aa. " * 300, "", "empty", None), ("b", 2, "s0002", " ", None, "queued", None), ("c", 1, "s0001", "x", "t", "machine", False)]
    return records, spark.createDataFrame(rows, "doc_id string, ordinal int, segment_id string, source string, translation string, status string, locked boolean")


def test_job(spark):
    """Batches go in order: what came before a failed one is kept, the document is in error."""

    def translator(payload):
        own = json.loads(payload)["segments"]
        if any("甲5" in x["text"] for x in own):
            raise OSError("down")
        return json.dumps({"translations": [{"id": x["id"], "text": f"<{len(x['text'])}>"} for x in own]})

    records, segments = job_tables(spark)
    config = EngineConfig(batch_items=3, request_chars=500, max_retries=1)
    after, done, calls = engine.translate(records, segments, translator, config=config)
    got = {(r.doc_id, r.ordinal): (r.translation, r.status) for r in done.collect()}
    assert [got["a", i][1] for i in range(1, 11)] == ["machine"] * 4 + ["empty"] * 4 + ["edited", "empty"]  # batches 1, 2-4, 5-7 (fails), 8
    assert got["b", 1] == ("<499><499><199>", "machine") and got["c", 1] == ("t", "machine") and got["b", 2] == ("<1>", "machine")
    state_of = {r.doc_id: (r.status, r.progress, r.error) for r in after.collect()}
    assert state_of == {"a": ("error", 50, "down"), "b": ("completed", 100, ""), "c": ("completed", 100, "")}
    assert max(r.attempt for r in calls.collect()) == 2


def test_one_segment(spark):
    records, segments = job_tables(spark)
    chosen = spark.createDataFrame([("a", "s0009"), ("a", "s0010"), ("a", "s0001")], "doc_id string, segment_id string")

    def translator(payload):
        if "甲1" in payload:
            raise OSError("down")
        return json.dumps({"translations": [{"id": x["id"], "text": "new"} for x in json.loads(payload)["segments"]]})

    after, rejects = engine.translate_one(records, segments, chosen, translator, EngineConfig(max_retries=0, batch_items=1))
    got = {(r.doc_id, r.ordinal): (r.translation, r.status) for r in after.collect()}
    assert got["a", 9] == ("new", "machine") and got["a", 10] == ("", "empty") and got["a", 1] == ("", "empty") and len(got) == segments.count()
    assert sorted(map(tuple, rejects.collect())) == [("a", "s0001", 502), ("a", "s0010", 409)]


def test_ingest(spark):
    files = spark.createDataFrame([("a", "x/一.docx", 10, "auto", "auto"), ("b", "b.pdf", 10, "zh", "zh"), ("c", "c.txt", 1, None, None), ("d", "d.pdf", 10**9, None, None), ("e", "e.pdf", 5, None, None)], "doc_id string, path string, size bigint, source_language string, target_language string")
    texts = spark.createDataFrame([("a", 1, "First  one"), ("a", 2, " "), ("a", 3, "第二"), ("b", 2, "more\nlines\n\nThird"), ("b", 1, "Aa."), ("c", 1, "x"), ("e", 1, None)], "doc_id string, place int, text string")
    records, rows, rejects = engine.ingest(files, texts, F.lit("2025-01-01"))
    assert [(r.doc_id, r.ordinal, r.segment_id, r.source) for r in rows.orderBy("doc_id", "ordinal").collect()] == [("a", 1, "s0001", "First  one"), ("a", 2, "s0002", "第二"), ("b", 1, "s0001", "Aa."), ("b", 2, "s0002", "more lines"), ("b", 3, "s0003", "Third")]
    assert sorted(map(tuple, rejects.collect())) == [("c", 415), ("d", 413), ("e", 422)]
    got = {r.doc_id: r for r in records.collect()}
    assert (got["a"].detected_language, got["a"].source_language, got["a"].target_language, got["a"].original_path) == ("zh", "zh", "en", "originals/a_一.docx")
    assert (got["b"].detected_language, got["b"].source_language, got["b"].target_language) == ("en", "zh", "en")


def test_settings_file():
    c = EngineConfig.read("# x\nTRANSLATION_BASE_URL=\"http://h/v1/\"\nTRANSLATION_MODEL='m'\nTRANSLATION_PROTOCOL=OpenAI\nTRANSLATION_BATCH_SIZE=99\nTRANSLATION_MAX_RETRIES=soon\nOTHER=1\n")
    assert (c.base_url, c.model, c.protocol, c.batch_items, c.max_retries, c.configured) == ("http://h/v1", "m", "openai", 10, 5, True) and not EngineConfig().configured


def test_reassembled(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, " x")], "k string, part_no int, t string")
    assert requests.reassembled(df, ["k"], "t", "en").first().text == "x y" and requests.reassembled(df, ["k"], "t", "zh").first().text == "xy"


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿source,target,source_lang\n\"x, y\",z,zh\nshort\n", "utf-8")
    (tmp_path / "b.tsv").write_text("source\ttarget\np\tq\n", "utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"terms": [{"source": "m", "target": "n"}, 5]}), "utf-8")
    (tmp_path / "d.json").write_text('{"terms": null}', "utf-8")
    (tmp_path / "e.json").write_text("{broken", "utf-8")
    (tmp_path / "f.json").write_text('[{"source": "u", "target": 7}]', "utf-8")
    (tmp_path / ".hidden.csv").write_text("source,target\nh,h\n", "utf-8")
    rows = sorted((r.file, r.row_no, r.source, r.target) for r in readers.glossary(spark, str(tmp_path)).collect())
    assert rows == [("a.csv", 1, "x, y", "z"), ("a.csv", 2, "short", None), ("b.tsv", 1, "p", "q"), ("c.json", 1, "m", "n"), ("f.json", 1, "u", "7")]


def _docx(body):
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx_text_boxes_and_filling(spark):
    w = lambda *t: "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t)
    box = "<w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r>"
    body = f"<w:p>{w('one', ' two')}{box}<w:hyperlink>{w(' link')}</w:hyperlink></w:p><w:p>{box}</w:p><w:p>{w('last')}</w:p>"
    file = _docx(body)
    assert readers.docx_paragraphs(file) == ["one two link", "last"]
    filled = readers.docx_filled(file, ["eins", ""])
    assert readers.docx_paragraphs(filled) == ["eins"]
    with zipfile.ZipFile(io.BytesIO(filled)) as z:
        assert z.read("word/document.xml").count(b"boxed") == 2
    files = spark.createDataFrame([("a", file), ("b", file), ("c", b"no")], "doc_id string, content binary")
    seg = spark.createDataFrame([(d, o, t) for d, rows in (("a", ["x", " y "]), ("b", ["x"]), ("c", ["x"])) for o, t in enumerate(rows, 1)], "doc_id string, ordinal int, translation string")
    got = {r.doc_id: r for r in sinks.filled_templates(files, seg).collect()}
    assert readers.docx_paragraphs(bytes(got["a"].content)) == ["x", "y"] and got["b"].error == "2 paragraphs and 1 texts" and got["c"].content is None


def test_published_versions(spark, tmp_path):
    one = spark.createDataFrame([("a", "old")], "doc_id string, updated_at string")
    sinks.publish(one, str(tmp_path / "r"), F.lit("now"))
    sinks.publish(one.union(one), str(tmp_path / "r"), F.lit("later"))
    assert [tuple(r) for r in sinks.current(spark, str(tmp_path / "r")).collect()] == [("a", "later")] * 2
    assert readers.style_guide(spark, str(tmp_path / "none.md")).first().style == ""


def test_originals_stay_below_the_root(spark, tmp_path):
    (tmp_path / "root" / "originals").mkdir(parents=True)
    (tmp_path / "root" / "originals" / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    df = spark.createDataFrame([("1", "originals/a.txt"), ("2", "../b.txt"), ("3", "originals/../../b.txt"), ("4", "/etc/passwd"), ("5", None), ("6", "C:\\x"), ("7", "a/../b/./c")], "doc_id string, original_path string")
    assert [r.ok for r in df.select(readers.inside(F.col("original_path")).alias("ok")).collect()] == [True, False, False, False, False, False, True]
    assert [(r.doc_id, bytes(r.content)) for r in readers.originals(spark, df, str(tmp_path / "root")).collect()] == [("1", b"a")]


def test_docx(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, merge="": f"<w:tc><w:tcPr>{merge}</w:tcPr>{p(t)}</w:tc>"
    body = p("first") + f"<w:tbl><w:tr>{cell('c1')}{cell('m', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('c2')}{cell('m', '<w:vMerge/>')}</w:tr></w:tbl>" + p(" ") + p("last")
    (tmp_path / "ok.docx").write_bytes(_docx(body))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "blank.docx").write_bytes(_docx(p("")))
    rows = readers.docx(spark, str(tmp_path)).collect()
    assert [r.source for r in sorted((r for r in rows if r.error is None), key=lambda r: r.ordinal)] == ["first", "last", "c1", "m", "c2"]
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["no text", "unreadable"]


def test_records_style_and_versions(spark, tmp_path):
    for name, data in (("a", {"id": "0" * 12, "name": "n", "segments": [{"id": "s0001", "source": "x"}]}), ("b", {"name": "no id"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "document.json").write_text(json.dumps(data), "utf-8")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "document.json").write_text("{oops", "utf-8")
    saved = readers.records(spark, f"{tmp_path}/*/document.json")
    assert [(r.doc_id, r.ordinal, r.source) for r in readers.record_segments(saved).collect()] == [("0" * 12, 1, "x")]
    (tmp_path / "style.md").write_text("  tone\n" + "x" * 20_000, "utf-8")
    assert len(readers.style_guide(spark, str(tmp_path / "style.md")).first().style) == 12_000 - 2
    one = sinks.write_version(spark.range(3), str(tmp_path / "out"))
    two = sinks.write_version(spark.range(4), str(tmp_path / "out"))
    assert one != two and spark.read.parquet(one).count() == 3 and spark.read.parquet(two).count() == 4


def test_exports(spark):
    df = spark.createDataFrame([("d", 1, "a", "x"), ("d", 2, "b", None), ("e", 1, "c", " ")], "doc_id string, ordinal int, source string, translation string")
    assert sinks.bilingual(df).count() == 3 and [r.text for r in sinks.translated(df, False).collect()] == ["x"] and sinks.translated(df, True).count() == 3
    assert [r.doc_id for r in sinks.exportable(df).collect()] == ["d"]


def test_stream_of_edits(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00.0", "k", "a", None), (2, "2025-01-01 00:00:00.3", "k", "ab", None), (2, "2025-01-01 00:00:00.3", "k", "ab", None), (3, "2025-01-01 00:00:05", "k", None, True), (4, "2025-01-02 00:00:00", "z", "q", None)]
    schema = "seq bigint, ts timestamp_ntz, k string, v string, locked boolean"
    src = spark.createDataFrame(rows, "seq bigint, ts string, k string, v string, locked boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src.coalesce(1).write.parquet(str(tmp_path / "log"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    for name, df, mode in (("saves_t", stream.saves(read().where("v is not null"), ["k"], "ts", "seq", "v"), "append"), ("folded_t", stream.folded(read(), ["k"], "seq", ["v", "locked"]), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r.v for r in spark.table("saves_t").where("k = 'k'").collect()] == ["ab"]
    assert {r.k: (r.v, r.locked) for r in spark.table("folded_t").collect()} == {"k": ("ab", True), "z": ("q", None)}
