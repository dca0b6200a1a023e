"""Queries of the core operators for the driver, and the SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import engine
from foliant.functions import text as T
from foliant.operators import align, merge, ordered, segments, state, terms
from foliant.plans import requests
from foliant.session import written
from foliant.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.deduplicated(_read(spark, folder, "segments"), ["doc_id", "ordinal"])


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return segments.deduplicated(_read(spark, folder, "doc_records"), ["doc_id"], "updated_at")


# Pieces of SQL used by several queries.
_W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CJK, _JOIN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}", T.JOINED


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _clean(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return _strip(rf"regexp_replace({plain}, '[{_W}]*\n[{_W}]*', chr(10), 'g')")


def _join(a: str, b: str) -> str:
    return f"CASE WHEN length({b}) = 0 THEN {a} WHEN regexp_matches(right({a}, 1), '^[{_JOIN}]$') AND regexp_matches(left({b}, 1), '^[{_JOIN}]$') THEN {a} || {b} ELSE {a} || ' ' || {b} END"


def _count(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"


def _detect(x: str) -> str:
    visible = f"regexp_replace({x}, '[{_W}]+', '', 'g')"
    return f"CASE WHEN length({visible}) = 0 OR {_count(x, _CJK)} >= greatest(2.0, {_count(x, 'A-Za-z')} * 0.18) THEN 'zh' ELSE 'en' END"


_SEGMENTS = "s AS MATERIALIZED (SELECT doc_id, ordinal, segment_id, source, translation, status, locked FROM segments QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY source DESC NULLS LAST, translation DESC NULLS LAST, locked DESC NULLS LAST) = 1)"
_RECORDS = "r AS (SELECT DISTINCT * FROM doc_records QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) = 1)"


@_query(f"SELECT doc_id, {_clean('text')} AS clean FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """P01."""
    return _read(spark, folder, "documents").where("text is not null").select("doc_id", T.clean(F.col("text")).alias("clean"))


@_query(f"SELECT doc_id, {_detect('text')} AS detected FROM documents WHERE text IS NOT NULL")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    """P06."""
    return _read(spark, folder, "documents").where("text is not null").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@_query(f"""WITH {_SEGMENTS}, {_RECORDS}, h AS (SELECT doc_id, string_agg(coalesce(source, ''), chr(10) ORDER BY ordinal) AS head FROM s WHERE ordinal <= 30 GROUP BY doc_id),
d AS (SELECT r.doc_id, source_language, target_language, {_detect("coalesce(head, '')")} AS detected FROM r LEFT JOIN h USING (doc_id)),
e AS (SELECT *, CASE WHEN source_language IN ('zh', 'en') THEN source_language ELSE detected END AS src FROM d),
f AS (SELECT *, CASE WHEN target_language IN ('zh', 'en') THEN target_language WHEN src = 'zh' THEN 'en' ELSE 'zh' END AS tgt FROM e)
SELECT doc_id, detected, src AS source, CASE WHEN tgt <> src THEN tgt WHEN src = 'zh' THEN 'en' ELSE 'zh' END AS target FROM f""")
def resolve_direction(spark: SparkSession, folder: str) -> DataFrame:
    """The first 30 segments decide the detected language, explicit labels win."""
    head = _segments(spark, folder).where("ordinal <= 30").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("source", F.lit("")).alias("t")))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: x["t"]), "\n")
    docs = _records(spark, folder).join(head, "doc_id", "left").withColumn("detected", T.detect_language(F.coalesce(text, F.lit(""))))
    return docs.withColumn("d", T.direction(F.col("source_language"), F.col("target_language"), F.col("detected"))).select("doc_id", "detected", "d.source", "d.target")


_PARAGRAPHS = rf"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n[{_W}]*\n')) AS block, generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n[{_W}]*\n'), 1) AS n FROM documents),
l AS (SELECT doc_id, n, list_filter(list_transform(string_split(block, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS lines FROM b),
j AS (SELECT doc_id, n, list_reduce(lines, lambda a, x: {_join('a', 'x')}) AS source FROM l WHERE len(lines) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS ordinal, source FROM j"""


@_query(_PARAGRAPHS)
def line_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """P02, P03, W01."""
    return segments.paragraph_rows(_read(spark, folder, "documents"), "doc_id", "text")


def _packed(texts: str = "SELECT doc_id, text AS own FROM documents", most: int = 1200) -> str:
    """Tables t (doc_id, txt: the clean text) and p (doc_id, source, ordinal): the packed pieces of texts (doc_id, own)."""
    return rf"""t AS (SELECT doc_id, {_clean("coalesce(own, '')")} AS txt FROM ({texts})),
u AS (SELECT doc_id, txt, list_filter(list_transform(string_split(regexp_replace(regexp_replace(txt, '([。！？!?；;])', '\1' || chr(1), 'g'), '([.])([{_W}]+[A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS sent FROM t WHERE length(txt) > 0),
w AS (SELECT doc_id, [txt] AS pieces FROM u WHERE length(txt) <= {most}
UNION ALL SELECT doc_id, CASE WHEN len(acc.res) + CAST(acc.cur <> '' AS INT) = 0 THEN [txt] WHEN acc.cur <> '' THEN list_append(acc.res, acc.cur) ELSE acc.res END
FROM (SELECT doc_id, txt, list_reduce(list_transform(sent, lambda s: {{'cur': s, 'res': CAST([] AS VARCHAR[])}}), lambda a, e:
 CASE WHEN length(e.cur) > {most} THEN {{'cur': '', 'res': list_concat(CASE WHEN a.cur <> '' THEN list_append(a.res, a.cur) ELSE a.res END, list_transform(range(0, CAST(ceil(length(e.cur) / {most}.0) AS BIGINT)), lambda i: substring(e.cur, 1 + i * {most}, {most})))}}
 WHEN a.cur = '' THEN {{'cur': e.cur, 'res': a.res}}
 WHEN length(a.cur) + 1 + length(e.cur) <= {most} THEN {{'cur': {_join('a.cur', 'e.cur')}, 'res': a.res}}
 ELSE {{'cur': e.cur, 'res': list_append(a.res, a.cur)}} END, {{'cur': '', 'res': CAST([] AS VARCHAR[])}}) AS acc FROM u WHERE length(txt) > {most})),
p AS (SELECT doc_id, unnest(pieces) AS source, generate_subscripts(pieces, 1) AS ordinal FROM w)"""


_PACKED = _packed()


@_query(f"WITH {_PACKED} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, printf('s%04d', ordinal) AS segment_id, source FROM p")
def segment_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of at most 1,200 characters."""
    return segments.segment_rows(_read(spark, folder, "documents"), "doc_id", "text")


@_query(f"WITH {_PACKED} SELECT doc_id, count(*) AS n_segments, CAST(sum(greatest(length(source), 1)) AS BIGINT) AS n_chars, max(length(source)) AS longest FROM p GROUP BY doc_id")
def segment_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A03, A04."""
    rows = segment_pack(spark, folder)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.greatest(F.length("source"), F.lit(1))).alias("n_chars"), F.max(F.length("source")).cast("bigint").alias("longest"))


@_query(f"""WITH {_SEGMENTS}, c AS (SELECT doc_id, count(*) AS total, count_if(length({_strip("coalesce(translation, '')")}) > 0) AS translated FROM s GROUP BY doc_id)
SELECT doc_id, total, CAST(translated AS BIGINT) AS translated, CAST(round_even(100.0 * translated / total, 0) AS INTEGER) AS progress FROM c""")
def progress(spark: SparkSession, folder: str) -> DataFrame:
    """A01, A02, A05."""
    return segments.coverage(_segments(spark, folder), "doc_id", "translation")


def _greedy(rows: str, lone: str = "1", items: int = 3, chars: int = 600) -> str:
    """Recursive tables x and g: batch_no of rows (doc_id, ordinal, len) in order; lone: items the first one counts as."""
    full = f"g.items >= {items} OR g.chars + x.len > {chars}"
    return f"""x AS (SELECT doc_id, ordinal, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM ({rows})),
g AS (SELECT doc_id, ordinal, n, 0 AS batch_no, CAST({lone} AS BIGINT) AS items, len AS chars FROM x WHERE n = 1
UNION ALL SELECT x.doc_id, x.ordinal, x.n, CASE WHEN {full} THEN g.batch_no + 1 ELSE g.batch_no END, CASE WHEN {full} THEN 1 ELSE g.items + 1 END, CASE WHEN {full} THEN x.len ELSE g.chars + x.len END
FROM g JOIN x ON x.doc_id = g.doc_id AND x.n = g.n + 1)"""


def _batch_sql(lone: str) -> str:
    rows = "SELECT doc_id, ordinal, length(coalesce(source, '')) AS len FROM s"
    return f"WITH RECURSIVE {_SEGMENTS}, {_greedy(rows, lone)} SELECT doc_id, ordinal, CAST(batch_no AS INTEGER) AS batch_no FROM g"


@_query(_batch_sql("1"))
def bounded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """At most 3 items and 600 characters, so that both limits bind."""
    rows = _segments(spark, folder).withColumn("len", F.length(F.coalesce("source", F.lit(""))))
    return ordered.batches(rows, "doc_id", "ordinal", "len", 3, 600)


@_query(_batch_sql("99"))
def progressive_batches(spark: SparkSession, folder: str) -> DataFrame:
    """As W04, the first item alone."""
    rows = _segments(spark, folder).withColumn("len", F.length(F.coalesce("source", F.lit(""))))
    return ordered.batches(rows, "doc_id", "ordinal", "len", 3, 600, lone_first=True)


@_query("SELECT DISTINCT term_id, source, target, source_lang, target_lang FROM (" + f"""
SELECT term_id, CASE WHEN rev THEN t ELSE s END AS source, CASE WHEN rev THEN s ELSE t END AS target, CASE WHEN rev THEN tl ELSE sl END AS source_lang, CASE WHEN rev THEN sl ELSE tl END AS target_lang FROM (
SELECT *, sl = 'en' AND tl = 'zh' AS rev FROM (SELECT term_id, {_strip('source')} AS s, {_strip('target')} AS t, lower({_strip("coalesce(source_lang, '')")}) AS sl, lower({_strip("coalesce(target_lang, '')")}) AS tl FROM terms WHERE length(source) > 0 AND length(target) > 0)
WHERE sl = '' OR tl = '' OR (sl = 'zh' AND tl = 'en') OR (sl = 'en' AND tl = 'zh')))""")
def orient_terms(spark: SparkSession, folder: str) -> DataFrame:
    """P12, P13, P14, F06 for Chinese to English."""
    return terms.oriented(terms.normalized(_read(spark, folder, "terms")), "zh", "en").select("term_id", "source", "target", "source_lang", "target_lang").distinct()


_MATCH = f"t AS (SELECT term_id, file, row_no, lower({_strip('source')}) AS s FROM terms WHERE length(source) > 0 AND length(target) > 0), m AS (SELECT doc_id, term_id, file, row_no FROM documents JOIN t ON length(s) > 0 AND contains(lower(text), s))"


@_query(f"WITH {_MATCH} SELECT doc_id, term_id FROM m")
def term_match(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms in documents (request_terms has those of each request)."""
    return terms.matches(_read(spark, folder, "documents"), "doc_id", "text", terms.normalized(_read(spark, folder, "terms")), "term_id")


@_query(f"WITH {_MATCH} SELECT doc_id, term_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY file, row_no, term_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 120")
def term_match_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The first 120 terms of each document in glossary order."""
    glossary = terms.normalized(_read(spark, folder, "terms"))
    found = terms.matches(_read(spark, folder, "documents"), "doc_id", "text", glossary, "term_id")
    return terms.first_matches(found, glossary, "doc_id", "term_id", ["file", "row_no"])


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").where("length(text) > 0").select(F.col("doc_id").alias("doc"), F.lit(1).alias("ordinal"), F.lit("s0001").alias("segment_id"), "text")
    return requests.parts(docs, ["doc", "ordinal", "segment_id"], "text", 1200)


_PART_SQL = "q AS (SELECT doc_id, CASE WHEN max(ordinal) OVER (PARTITION BY doc_id) = 1 THEN 's0001' ELSE printf('s0001__part%04d', ordinal) END AS part_id, CAST(ordinal AS INTEGER) AS part_no, source FROM p UNION ALL SELECT doc_id, 's0001', 1, text FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM p))"


@_query(f"WITH {_PACKED}, {_PART_SQL} SELECT doc_id AS doc, part_id, part_no, source AS text FROM q")
def request_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut into parts for requests."""
    return _parts(spark, folder).select("doc", "part_id", "part_no", "text")


@_query(f"WITH {_PACKED}, {_PART_SQL} SELECT doc_id AS doc, {_strip("string_agg('[' || source || ']', ' ' ORDER BY part_no)")} AS text FROM q GROUP BY doc_id")
def parts_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    """Parts, put in brackets by way of translation, joined in order."""
    done = _parts(spark, folder).withColumn("t", F.concat(F.lit("["), "text", F.lit("]")))
    return requests.reassembled(done, ["doc"], "t", "en")


_PART_ROWS = """y AS (SELECT doc_id, split_part(doc_id, '|', 1) AS doc, CAST(split_part(doc_id, '|', 2) AS BIGINT) AS o, split_part(doc_id, '|', 3) AS sid, ordinal AS part_no, max(ordinal) OVER (PARTITION BY doc_id) AS parts, source FROM p
UNION ALL SELECT k, doc_id, ordinal, segment_id, 1, 1, source FROM own WHERE length(source) > 0 AND k NOT IN (SELECT doc_id FROM p)),
z AS (SELECT doc AS doc_id, o, sid AS segment_id, part_no, CASE WHEN parts = 1 THEN sid ELSE sid || '__part' || printf('%04d', part_no) END AS part_id, source AS text, o * 100000 + part_no AS pos FROM y)"""
_OWN = "own AS (SELECT doc_id || '|' || ordinal || '|' || segment_id AS k, doc_id, ordinal, segment_id, source FROM s WHERE length(source) > 0)"
_REQUEST_SQL = f"""WITH RECURSIVE {_SEGMENTS}, {_OWN}, {_packed("SELECT k AS doc_id, source AS own FROM own", 6000)}, {_PART_ROWS}, {_greedy("SELECT doc_id, pos AS ordinal, length(text) AS len FROM z", chars=6000)}
SELECT z.doc_id, CAST(batch_no AS INTEGER) AS request_no, count(*) AS n_items, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(to_json({{'segments': list({{'id': part_id, 'text': text}} ORDER BY pos)}}) AS VARCHAR) AS payload
FROM z JOIN g ON g.doc_id = z.doc_id AND g.ordinal = z.pos GROUP BY z.doc_id, batch_no"""


@_query(_REQUEST_SQL)
def request_json(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded requests of the segments of each document, their segments as JSON."""
    rows = requests.parts(_segments(spark, folder).where("length(source) > 0"), ["doc_id", "ordinal", "segment_id"], "source")
    return requests.requests(rows, "doc_id", "ordinal")


_FREE = "NOT coalesce(locked, false) AND NOT coalesce(status IN ('edited', 'reviewed'), false)"


@_query(f"WITH {_SEGMENTS} SELECT doc_id, ordinal, segment_id, status FROM s WHERE {_FREE} AND length(coalesce(translation, '')) = 0")
def pending_segments(spark: SparkSession, folder: str) -> DataFrame:
    """segments a translation job takes up."""
    return state.pending(_segments(spark, folder)).select("doc_id", "ordinal", "segment_id", "status")


@_query(f"WITH {_SEGMENTS} SELECT doc_id, ordinal, CASE WHEN {_FREE} AND length(coalesce(translation, '')) = 0 THEN 'queued' ELSE status END AS status FROM s")
def queued_segments(spark: SparkSession, folder: str) -> DataFrame:
    """the state of segments once a job has begun."""
    rows = _segments(spark, folder)
    return state.queued(rows, state.pending(rows), ["doc_id", "ordinal"]).select("doc_id", "ordinal", "status")


_EDITED = f"""l AS (SELECT DISTINCT seq, doc_id, segment_id, {_strip('source')} AS src, {_strip('translation')} AS tr, locked AS lk, reviewed AS rv FROM edits),
i AS (SELECT doc_id, segment_id, -1 AS seq, coalesce(translation, '') AS tr, CAST(NULL AS BOOLEAN) AS rv FROM s UNION ALL SELECT doc_id, segment_id, seq, tr, rv FROM l),
c AS (SELECT *, last_value(tr IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS cur, last_value(tr IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM i WINDOW w AS (PARTITION BY doc_id, segment_id ORDER BY seq)),
m AS (SELECT doc_id, segment_id, seq, CASE WHEN seq = -1 THEN NULL WHEN rv THEN 'reviewed' WHEN NOT rv THEN CASE WHEN cur <> '' THEN 'edited' ELSE 'empty' END WHEN tr IS NOT NULL AND tr <> prev THEN CASE WHEN tr <> '' THEN 'edited' ELSE 'empty' END END AS st FROM c),
f AS (SELECT doc_id, segment_id, arg_max(st, seq) FILTER (st IS NOT NULL) AS st FROM m GROUP BY doc_id, segment_id),
h AS (SELECT doc_id, segment_id, arg_max(src, seq) FILTER (src IS NOT NULL) AS src, arg_max(tr, seq) FILTER (tr IS NOT NULL) AS tr, arg_max(coalesce(rv, lk), seq) FILTER (coalesce(rv, lk) IS NOT NULL) AS lk FROM l GROUP BY doc_id, segment_id)"""


@_query(f"WITH {_SEGMENTS}, {_EDITED} SELECT s.doc_id, s.ordinal, coalesce(h.src, s.source) AS source, coalesce(h.tr, s.translation) AS translation, coalesce(f.st, s.status) AS status, coalesce(h.lk, s.locked) AS locked FROM s LEFT JOIN h USING (doc_id, segment_id) LEFT JOIN f USING (doc_id, segment_id)")
def edit_state(spark: SparkSession, folder: str) -> DataFrame:
    """The segments after the whole edit log."""
    return engine.apply_edits(_segments(spark, folder), _read(spark, folder, "edits")).select("doc_id", "ordinal", "source", "translation", "status", "locked")


@_query(f"""WITH {_SEGMENTS}, n AS (SELECT doc_id, segment_id, arg_max({_strip('translation')}, seq) AS text FROM edits WHERE translation IS NOT NULL GROUP BY doc_id, segment_id),
a AS (SELECT s.*, n.text, n.text IS NOT NULL AND {_FREE} AND length(coalesce(translation, '')) = 0 AS applied FROM s LEFT JOIN n USING (doc_id, segment_id))
SELECT doc_id, ordinal, CASE WHEN applied THEN text ELSE translation END AS translation, CASE WHEN applied THEN 'machine' ELSE status END AS status, applied FROM a""")
def machine_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Answers, here the last translations of the log, merged under the guard."""
    answers = state.latest_with_key(_read(spark, folder, "edits"), ["doc_id", "segment_id"], "seq").where("translation is not null").withColumnRenamed("translation", "text")
    return state.answered(_segments(spark, folder), answers, ["doc_id", "segment_id"]).select("doc_id", "ordinal", "translation", "status", "applied")


@_query(f"""WITH {_SEGMENTS}, n AS (SELECT doc_id, segment_id, {_strip("arg_max(translation, seq) FILTER (translation IS NOT NULL)")} AS v FROM edits GROUP BY doc_id, segment_id),
a AS (SELECT s.*, v, v IS NOT NULL AND v <> coalesce(translation, '') AS changed FROM s LEFT JOIN n USING (doc_id, segment_id))
SELECT doc_id, ordinal, CASE WHEN changed THEN v ELSE translation END AS translation, CASE WHEN NOT changed THEN status WHEN v = '' THEN 'empty' ELSE 'edited' END AS status, changed FROM a""")
def autosave_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of translations, here the last ones of the log, saved into the segments."""
    last = state.latest_with_key(_read(spark, folder, "edits"), ["doc_id", "segment_id"], "seq").where("translation is not null")
    saves = last.select("doc_id", F.create_map("segment_id", "translation").alias("translations"))  # a map holds what one save sends
    return engine.apply_autosave(_segments(spark, folder), saves).select("doc_id", "ordinal", "translation", "status", "changed")


_SAVED, _DIRTY = "SELECT doc_id, segment_id, arg_max({0}, seq) AS v FROM edits WHERE translation IS NOT NULL{1} GROUP BY doc_id, segment_id", _strip("translation")


@_query(f"WITH {_SEGMENTS}, d AS ({_SAVED.format(_DIRTY, '')}) SELECT s.doc_id, s.segment_id, coalesce(d.v, s.translation, '') AS translation, s.status FROM s LEFT JOIN d USING (doc_id, segment_id)")
def row_merge(spark: SparkSession, folder: str) -> DataFrame:
    """What an editor shows: its unsaved translations win over the server's."""
    dirty = state.latest_with_key(_read(spark, folder, "edits"), ["doc_id", "segment_id"], "seq").where("translation is not null")
    return state.shown(_segments(spark, folder), dirty, ["doc_id", "segment_id"])


@_query(f"WITH d AS ({_SAVED.format(_DIRTY, '')}), v AS ({_SAVED.format(_DIRTY, ' AND source IS NULL')}) SELECT d.doc_id, count(*) AS unsaved FROM d LEFT JOIN v ON v.doc_id = d.doc_id AND v.segment_id = d.segment_id AND v.v = d.v WHERE v.v IS NULL GROUP BY d.doc_id")
def dirty_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with translations that differ from what was saved (here: by edits of the translation alone)."""
    log = _read(spark, folder, "edits")
    key = ["doc_id", "segment_id"]
    dirty, saved = (state.latest_with_key(x, key, "seq").where("translation is not null") for x in (log, log.where("source is null")))
    return state.unsaved(dirty, saved, key).groupBy("doc_id").agg(F.count("*").alias("unsaved"))


@_query(f"""WITH {_RECORDS}, q AS (SELECT DISTINCT request_id, doc_id, source_language, target_language FROM translation_requests),
a AS (SELECT q.*, CASE WHEN q.source_language = q.target_language THEN 400 WHEN r.status = 'translating' THEN 202 WHEN r.doc_id IS NOT NULL THEN 202 ELSE 404 END AS answer, coalesce(r.status = 'translating', false) AS busy FROM q LEFT JOIN r USING (doc_id))
SELECT request_id, answer, answer = 202 AND NOT busy AND request_id = coalesce(min(CASE WHEN answer = 202 AND NOT busy THEN request_id END) OVER (PARTITION BY doc_id), -1) AS begins FROM a""")
def started_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Which requests begin a job."""
    records = _records(spark, folder)
    asked = _read(spark, folder, "translation_requests").dropDuplicates(["request_id"])
    return state.started(asked, records, records.where("status = 'translating'")).select("request_id", "answer", "begins")


def _stand_in(payload: str) -> str:
    import json

    return json.dumps({"translations": [{"id": x["id"], "text": f"[{x['text']}]"} for x in json.loads(payload)["segments"]]}, ensure_ascii=False)


_PENDING = f"own AS (SELECT doc_id || '|' || ordinal || '|' || segment_id AS k, doc_id, ordinal, segment_id, coalesce(source, '') AS source FROM s JOIN r USING (doc_id) WHERE {_FREE.replace('status', 's.status')} AND length(coalesce(translation, '')) = 0)"
_ANSWERS = f"""{_packed("SELECT k AS doc_id, source AS own FROM own", 6000)}, {_PART_ROWS.replace("WHERE length(source) > 0 AND k NOT", "WHERE k NOT")},
v AS (SELECT z.doc_id, segment_id, {_strip("CASE WHEN any_value(target_language) = 'zh' THEN string_agg('[' || text || ']', '' ORDER BY part_no) ELSE string_agg('[' || text || ']', ' ' ORDER BY part_no) END")} AS answer FROM z JOIN r USING (doc_id) GROUP BY z.doc_id, segment_id)"""


@_query(f"""WITH {_SEGMENTS}, {_RECORDS}, {_PENDING}, {_ANSWERS}
SELECT s.doc_id, s.ordinal, coalesce(v.answer, s.translation) AS translation, CASE WHEN v.answer IS NOT NULL THEN 'machine' WHEN s.status IN ('queued', 'translating') THEN CASE WHEN length({_strip("coalesce(s.translation, '')")}) > 0 THEN 'machine' ELSE 'empty' END ELSE s.status END AS status
FROM s JOIN r USING (doc_id) LEFT JOIN v USING (doc_id, segment_id)""")
def translate_job(spark: SparkSession, folder: str) -> DataFrame:
    """A job over all documents with a stand-in translator that puts texts in brackets."""
    return engine.translate(_records(spark, folder), _segments(spark, folder), _stand_in)[1].select("doc_id", "ordinal", "translation", "status")


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of all segments in requests, whatever their state."""
    rows = requests.parts(_segments(spark, folder).where("length(source) > 0"), ["doc_id", "ordinal", "segment_id"], "source")
    way = _records(spark, folder).select("doc_id", F.when(F.col("source_language") == "en", "en").otherwise("zh").alias("source_language"))
    numbered = requests.numbered(rows, "doc_id", "ordinal")
    return numbered.join(way, "doc_id").withColumn("target_language", F.when(F.col("source_language") == "en", "zh").otherwise("en"))


_TERMS_OF = f"""nt AS (SELECT term_id, file, row_no, {_strip('source')} AS s0, {_strip('target')} AS t0, {_strip("coalesce(domain, '')")} AS domain, {_strip("coalesce(notes, '')")} AS notes, lower({_strip("coalesce(source_lang, '')")}) AS sl, lower({_strip("coalesce(target_lang, '')")}) AS tl FROM terms WHERE length(source) > 0 AND length(target) > 0),
d AS (SELECT 'zh' AS a, 'en' AS b UNION ALL SELECT 'en', 'zh'),
o AS (SELECT a, b, term_id, file, row_no, CASE WHEN sl = b AND tl = a THEN t0 ELSE s0 END AS src, CASE WHEN sl = b AND tl = a THEN s0 ELSE t0 END AS tgt, domain, notes FROM nt, d WHERE sl = '' OR tl = '' OR (sl = a AND tl = b) OR (sl = b AND tl = a)),
zz AS (SELECT z.doc_id, g.batch_no AS request_no, z.text, CASE WHEN r.source_language = 'en' THEN 'en' ELSE 'zh' END AS a FROM z JOIN g ON g.doc_id = z.doc_id AND g.ordinal = z.pos JOIN r ON r.doc_id = z.doc_id),
hit AS (SELECT DISTINCT doc_id, request_no, o.* FROM zz JOIN o ON zz.a = o.a AND length(src) > 0 AND contains(lower(text), lower(src))),
top AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, request_no ORDER BY file, row_no, term_id) <= 120)"""


@_query(f"""{_REQUEST_SQL[: _REQUEST_SQL.index("SELECT z.doc_id, CAST(batch_no")].rstrip()}, {_RECORDS}, {_TERMS_OF}
SELECT doc_id, CAST(request_no AS INTEGER) AS request_no, count(*) AS n_terms, string_agg(src || ' => ' || tgt || CASE WHEN domain <> '' AND notes <> '' THEN ' (' || domain || '; ' || notes || ')' WHEN domain || notes <> '' THEN ' (' || domain || notes || ')' ELSE '' END, chr(10) ORDER BY file, row_no, term_id) AS lines FROM top GROUP BY doc_id, request_no""")
def request_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary terms of each request, oriented, as lines."""
    parts = _planned(spark, folder)
    found = requests.matched_terms(parts, parts, "doc_id", terms.normalized(_read(spark, folder, "terms")), ["file", "row_no"])
    return found.select("doc_id", "request_no", F.size("terms").cast("bigint").alias("n_terms"), F.array_join(F.transform("terms", requests.term_line), "\n").alias("lines"))


_TERM_LINES = "string_agg(src || ' => ' || tgt || CASE WHEN domain <> '' AND notes <> '' THEN ' (' || domain || '; ' || notes || ')' WHEN domain || notes <> '' THEN ' (' || domain || notes || ')' ELSE '' END, chr(10) || '- ' ORDER BY file, row_no, term_id)"


@_query(f"""{_REQUEST_SQL[: _REQUEST_SQL.index("SELECT z.doc_id, CAST(batch_no")].rstrip()}, {_RECORDS}, {_TERMS_OF},
ln AS (SELECT doc_id, request_no, '- ' || {_TERM_LINES} AS lines FROM top GROUP BY doc_id, request_no),
pay AS (SELECT z.doc_id, batch_no AS request_no, CAST(to_json({{'segments': list({{'id': part_id, 'text': text}} ORDER BY pos)}}) AS VARCHAR) AS payload FROM z JOIN g ON g.doc_id = z.doc_id AND g.ordinal = z.pos GROUP BY z.doc_id, batch_no),
told AS (SELECT pay.*, 'Translate every segment from ' || CASE WHEN source_language = 'en' THEN 'English to Simplified Chinese' ELSE 'Simplified Chinese to English' END || '{requests.MANNER}' || chr(10) || chr(10) || 'Answer with this JSON object alone: {requests.ANSWER}' || chr(10) || chr(10) || 'Terms to use:' || chr(10) || coalesce(lines, 'none apply') || chr(10) || chr(10) || 'Style:' || chr(10) || 'formal and plain' AS prompt
 FROM pay JOIN r USING (doc_id) LEFT JOIN ln ON ln.doc_id = pay.doc_id AND ln.request_no = pay.request_no)
SELECT doc_id, CAST(request_no AS INTEGER) AS request_no, CAST(to_json({{'model': 'any', 'temperature': 0.2::DOUBLE, 'messages': [{{'role': 'system', 'content': prompt}}, {{'role': 'user', 'content': payload}}]}}) AS VARCHAR) AS body FROM told""")
def request_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of the requests of all documents, with their instructions."""
    parts = _planned(spark, folder).withColumn("batch_no", F.lit(0)).withColumn("_group", F.col("doc_id"))
    plan = engine.prompted(parts, terms.normalized(_read(spark, folder, "terms")), ["file", "row_no"])
    return requests.bodies(plan, "openai", "any").select("doc_id", "request_no", "body")


@_query(f"""WITH {_RECORDS}, n AS (SELECT doc_id, retry.retry_number AS retry_number, coalesce(TRY_CAST(regexp_extract(retry.reason, '(\\d+)', 1) AS INTEGER), 0) AS status FROM r WHERE retry IS NOT NULL)
SELECT doc_id, retry_number, status, coalesce(status IN (408, 409, 425, 429) OR status BETWEEN 500 AND 599, false) AS retryable, CAST(least(120.0, least(30.0, 2.0 * pow(2.0, greatest(0, retry_number - 1)))) AS DOUBLE) AS delay FROM n""")
def retry_policy(spark: SparkSession, folder: str) -> DataFrame:
    """P20, P22 (without jitter)."""
    rows = _records(spark, folder).where("retry is not null").select("doc_id", "retry.retry_number", F.coalesce(F.regexp_extract("retry.reason", r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("status"))
    return rows.select("doc_id", "retry_number", "status", F.coalesce(requests.retryable(F.col("status")), F.lit(False)).alias("retryable"), requests.delay(F.col("retry_number")).alias("delay"))


_LATEST = f"e AS (SELECT doc_id, segment_id, arg_max({_strip('source')}, seq) FILTER (source IS NOT NULL) AS source, arg_max({_strip('translation')}, seq) FILTER (translation IS NOT NULL) AS translation, arg_max(locked, seq) FILTER (locked IS NOT NULL) AS locked, arg_max(reviewed, seq) FILTER (reviewed IS NOT NULL) AS reviewed FROM edits GROUP BY doc_id, segment_id)"


@_query(f"WITH {_LATEST} SELECT * FROM e")
def edit_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last value of each field of every segment, as the log has it (edit_state has what becomes of the segments)."""
    return merge.latest_edits(_read(spark, folder, "edits"), ["doc_id", "segment_id"], "seq", ["source", "translation", "locked", "reviewed"])


@_query(f"""WITH {_SEGMENTS}, {_LATEST} SELECT s.doc_id, s.ordinal, coalesce(e.source, s.source) AS source, coalesce(e.translation, s.translation) AS translation,
(e.source IS NOT NULL AND e.source IS DISTINCT FROM s.source) OR (e.translation IS NOT NULL AND e.translation IS DISTINCT FROM s.translation) AS changed FROM s LEFT JOIN e USING (doc_id, segment_id)""")
def edit_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of the edits merged into the segments."""
    return merge.upserted(_segments(spark, folder), edit_latest(spark, folder), ["doc_id", "segment_id"], ["source", "translation"]).select("doc_id", "ordinal", "source", "translation", "changed")


@_query("""WITH d AS (SELECT DISTINCT seq, ts, doc_id, segment_id FROM edits), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY doc_id, segment_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, segment_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT doc_id, segment_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, max(seq) AS last_seq FROM n GROUP BY doc_id, segment_id, no""")
def edit_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of edits, a quiet period of 30 minutes apart."""
    return merge.sessions(_read(spark, folder, "edits"), ["doc_id", "segment_id"], "ts", "seq")


@_query(f"WITH {_SEGMENTS} SELECT doc_id, ordinal, segment_id FROM s WHERE NOT EXISTS (SELECT 1 FROM edits WHERE edits.doc_id = s.doc_id AND edits.segment_id = s.segment_id)")
def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without an edit."""
    return requests.missing(_segments(spark, folder), _read(spark, folder, "edits"), ["doc_id", "segment_id"]).select("doc_id", "ordinal", "segment_id")


_VISIBLE = r"regexp_replace(coalesce(source, ''), '[\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]', '', 'g')"
_WEIGHT = f"greatest(CAST(len(regexp_split_to_array(coalesce(source, ''), '\\r?\\n')) AS DOUBLE), ({_count(_VISIBLE, _CJK)} + {_count(_VISIBLE, 'A-Za-z0-9')} * 0.52::DOUBLE + greatest(0, length({_VISIBLE}) - {_count(_VISIBLE, _CJK)} - {_count(_VISIBLE, 'A-Za-z0-9')}) * 0.7::DOUBLE) / 42, 1.0)"


@_query(f"""WITH {_SEGMENTS}, v AS (SELECT doc_id, ordinal, {_WEIGHT} AS weight FROM s)
SELECT doc_id, ordinal, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 4) AS end_at FROM v""")
def prefix_weights(spark: SparkSession, folder: str) -> DataFrame:
    """P23, W02."""
    rows = _segments(spark, folder).withColumn("weight", T.visual_weight(F.coalesce("source", F.lit(""))))
    return ordered.prefix_sums(rows, "doc_id", "ordinal", "weight").select("doc_id", "ordinal", F.round("weight", 6).alias("weight"), F.round("end", 4).alias("end_at"))


def _compatible() -> str:
    """A DuckDB map from characters to their compatibility decompositions, made from the interpreter's Unicode data."""
    import unicodedata

    pairs = {c: d for c in map(chr, [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1F300), *range(0x2F800, 0x2FA20)]) if (d := unicodedata.normalize("NFKD", c)) != c}
    text = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    return f"MAP([{text(pairs)}], [{text(pairs.values())}])"


_KEYS = f"mp AS MATERIALIZED (SELECT {_compatible()} AS m)"


def _key(x: str) -> str:
    plain = f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: coalesce(m[c], c)), '')"
    return f"regexp_replace(lower(nfc_normalize({plain})), '[^{_CJK}a-z0-9]', '', 'g')"


@_query(f"WITH {_SEGMENTS}, {_KEYS} SELECT doc_id, ordinal, {_key("coalesce(source, '')")} AS key FROM s, mp")
def match_key(spark: SparkSession, folder: str) -> DataFrame:
    """P24."""
    return _segments(spark, folder).select("doc_id", "ordinal", T.match_key(F.coalesce("source", F.lit(""))).alias("key"))


def _map(spark: SparkSession, folder: str) -> DataFrame:
    rows = _segments(spark, folder)
    pages = rows.groupBy("doc_id", F.floor((F.col("ordinal") - 1) / 5).cast("int").alias("page_no")).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("source", F.lit("")).alias("t")))).alias("x"))
    return align.page_map(rows, pages.select("doc_id", "page_no", F.array_join(F.transform("x", lambda v: v["t"]), " ").alias("text")), "doc_id")


_MAP_SQL = f"""{_SEGMENTS}, {_KEYS},
k AS MATERIALIZED (SELECT doc_id, ordinal, {_key("coalesce(source, '')")} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM s, mp),
pg AS (SELECT doc_id, (ordinal - 1) // 5 AS page_no, string_agg(coalesce(source, ''), ' ' ORDER BY ordinal) AS t FROM s GROUP BY ALL),
pk AS (SELECT doc_id, page_no, {_key('t')} AS key FROM pg, mp),
d AS MATERIALIZED (SELECT doc_id, string_agg(CASE WHEN key = '' THEN ' ' ELSE key END, chr(10) ORDER BY page_no) AS txt, list(greatest(1, length(key)) ORDER BY page_no) AS sizes FROM pk GROUP BY doc_id),
h AS MATERIALIZED (SELECT *, list_transform(range(1, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i-1]), 0)::BIGINT + i - 1) AS heads FROM d),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cursor, CAST(NULL AS BIGINT) AS place FROM h
UNION ALL SELECT doc_id, n, CASE WHEN place IS NULL THEN cursor WHEN after >= heads[p] + sizes[p] THEN heads[least(p + 1, len(sizes))] ELSE after END, place FROM (
 SELECT *, place + hit.n AS after, len(list_filter(heads, lambda x: x <= place)) AS p FROM (
 SELECT *, CASE WHEN hit IS NULL THEN NULL ELSE cursor + hit.at - 1 END AS place FROM (
 SELECT f.doc_id, k.n, f.cursor, h.heads, h.sizes, list_filter(list_transform(list_reverse_sort(list_distinct(list_transform([CASE WHEN length(k.key) <= 300 THEN length(k.key) ELSE 200 END, 128, 64, 32, 16, 8], lambda x: least(x, length(k.key))))), lambda x: {{'n': x, 'at': CASE WHEN x > 0 THEN strpos(substring(h.txt, f.cursor + 1), left(k.key, x)) ELSE 0 END}}), lambda y: y.at > 0)[1] AS hit
 FROM f JOIN k ON k.doc_id = f.doc_id AND k.n = f.n + 1 JOIN h ON h.doc_id = f.doc_id)))),
g AS (SELECT f.doc_id, k.ordinal, place, heads, sizes, len(sizes) AS pages, list_sum(sizes) AS whole, sum(greatest(1, length(k.key))) OVER (PARTITION BY f.doc_id) AS total, sum(greatest(1, length(k.key))) OVER (PARTITION BY f.doc_id ORDER BY f.n) - greatest(1, length(k.key)) AS gone
 FROM f JOIN k ON k.doc_id = f.doc_id AND k.n = f.n JOIN h ON h.doc_id = f.doc_id),
q AS (SELECT *, least(gone / total::DOUBLE * whole, whole) AS want, len(list_filter(heads, lambda x: x <= place)) AS p FROM g),
w AS (SELECT *, 1 + len(list_filter(range(1, pages), lambda i: list_sum(sizes[1:i]) < want)) AS e FROM q),
o AS (SELECT doc_id, ordinal, place IS NOT NULL AS matched, pages, CASE WHEN place IS NOT NULL THEN (p - 1 + (place - heads[p]) / sizes[p]::DOUBLE) / pages ELSE (e - 1 + greatest(0, least(1, (want - (list_sum(sizes[1:e]) - sizes[e])) / sizes[e]::DOUBLE))) / pages END AS raw FROM w),
mapped AS (SELECT doc_id, ordinal, pages, matched, max(raw) OVER (PARTITION BY doc_id ORDER BY ordinal) AS position FROM o)"""


@_query(f"WITH RECURSIVE {_MAP_SQL} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, round(position, 9) AS position, CAST(least(pages, floor(position * pages) + 1) AS INTEGER) AS page, matched FROM mapped")
def page_map(spark: SparkSession, folder: str) -> DataFrame:
    """Segments placed on pages of five segments each."""
    return _map(spark, folder).withColumn("position", F.round("position", 9))


@_query(f"""WITH RECURSIVE {_MAP_SQL}, {_RECORDS}, a AS (SELECT doc_id, i / 10.0::DOUBLE AS ratio FROM r, range(11) t(i) WHERE doc_id IN (SELECT doc_id FROM s)),
j AS (SELECT a.doc_id, ratio, coalesce(max({{'p': position, 'o': ordinal}}) FILTER (position <= ratio), min({{'p': position, 'o': ordinal}})) AS hit FROM a JOIN mapped USING (doc_id) GROUP BY a.doc_id, ratio),
z AS (SELECT j.doc_id, ratio, hit, coalesce(min(position) FILTER (position > hit.p + 1e-6), 1.0) AS nxt FROM j JOIN mapped USING (doc_id) GROUP BY j.doc_id, ratio, hit)
SELECT doc_id, ratio, CAST(hit.o AS BIGINT) AS ordinal, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ratio - hit.p) / greatest(1e-6, nxt - hit.p))), 6) AS fraction FROM z""")
def position_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """As-of lookup of every tenth of each document."""
    asked = _records(spark, folder).select("doc_id", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("ratio"))
    known = _read(spark, folder, "segments").select("doc_id").distinct()
    return align.looked_up(_map(spark, folder), asked.join(known, "doc_id"), "doc_id", "ratio").withColumn("fraction", F.round("fraction", 6))


@_query(f"WITH {_RECORDS} SELECT doc_id, name, status, progress, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, doc_id) AS INTEGER) AS place FROM r QUALIFY place <= 50")
def recent_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents saved last, as its SQL has it; listed_documents has all of them."""
    top = _records(spark, folder).orderBy(F.desc("updated_at"), "doc_id").limit(50)
    return top.select("doc_id", "name", "status", "progress", "updated_at", F.row_number().over(Window.orderBy(F.desc("updated_at"), "doc_id")).alias("place"))


@_query(f"WITH {_RECORDS} SELECT doc_id, name, status, progress, updated_at, row_number() OVER (ORDER BY updated_at DESC, doc_id) AS place FROM r")
def listed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, the one saved last first, with their place.

    The rows are sorted by ranges and written once; a place is the place in the range and the counts of the ranges before.
    """
    rows = _records(spark, folder).select("doc_id", "name", "status", "progress", "updated_at")
    ranges = written(rows.orderBy(F.desc("updated_at"), "doc_id").withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("updated_at"), "doc_id"))
    return ranges.withColumn("_at", inner).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).alias("place"))


@_query(f"WITH {_SEGMENTS} SELECT doc_id, ordinal, source, coalesce(translation, '') AS translation FROM s")
def bilingual_export(spark: SparkSession, folder: str) -> DataFrame:
    """K02."""
    return sinks.bilingual(_segments(spark, folder))


@_query(f"WITH {_SEGMENTS} SELECT doc_id, ordinal, coalesce(translation, '') AS text FROM s WHERE length({_strip("coalesce(translation, '')")}) > 0")
def translated_export(spark: SparkSession, folder: str) -> DataFrame:
    """K03 for flowing text: blank translations are left out."""
    return sinks.translated(_segments(spark, folder), keep_blanks=False)


@_query(f"WITH {_SEGMENTS} SELECT DISTINCT doc_id FROM s WHERE length({_strip("coalesce(translation, '')")}) > 0")
def exportable_documents(spark: SparkSession, folder: str) -> DataFrame:
    """K07, A05."""
    return sinks.exportable(_segments(spark, folder))


@_query(f"""WITH {_PACKED}, k AS (SELECT doc_id, unnest(range(1, 1 + len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(txt, chr(10)) AS l FROM t WHERE length(txt) > 0))
SELECT coalesce(p.doc_id, k.doc_id) AS doc_id, CAST(coalesce(p.ordinal, k.n) AS INTEGER) AS ordinal, line AS left_value, source AS right_value, p.doc_id IS NOT NULL AND k.doc_id IS NOT NULL AS both FROM p FULL JOIN k ON p.doc_id = k.doc_id AND p.ordinal = k.n""")
def positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and segments of the documents by position."""
    lines = _read(spark, folder, "documents").select("doc_id", T.clean(F.coalesce("text", F.lit(""))).alias("c")).where(F.length("c") > 0)
    left = lines.select("doc_id", F.posexplode(F.split("c", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("ordinal"), "line")
    return merge.zipped(left, segment_pack(spark, folder), ["doc_id", "ordinal"], ["line", "source"])


@_query(r"""WITH f AS (SELECT doc_id, file_name, n_chars, lower(regexp_extract(coalesce(file_name, ''), '\.([^./\\]+)$', 1)) AS suffix FROM documents)
SELECT doc_id, suffix, CASE WHEN suffix NOT IN ('doc', 'docx', 'pdf') THEN 415 WHEN n_chars > 20000 THEN 413 ELSE 0 END AS reject FROM f""")
def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Types and sizes (here characters above 20,000) refused at ingest (0: accepted)."""
    return segments.split_by_type(_read(spark, folder, "documents"), "file_name", "n_chars", 20_000).select("doc_id", "suffix", F.coalesce("reject", F.lit(0)).alias("reject"))


@_query(rf"""SELECT doc_id, coalesce(nullif(substring(regexp_replace({_strip("regexp_extract(file_name, '([^/\\\\]*)$', 1)")}, '[<>:"/\\|?*]', '_', 'g'), 1, 180), ''), 'document') AS safe FROM documents""")
def safe_filename(spark: SparkSession, folder: str) -> DataFrame:
    """P10."""
    return _read(spark, folder, "documents").select("doc_id", T.safe_filename(F.col("file_name")).alias("safe"))


@_query(f"""WITH d AS (SELECT DISTINCT doc_id, updated_at, status FROM doc_records), g AS (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY updated_at, status) AS prev FROM d)
SELECT doc_id, updated_at, prev AS "before", status AS "after" FROM g WHERE prev IS DISTINCT FROM status""")
def status_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Changes along the saved versions of a record."""
    from foliant.streaming import edits as stream

    versions = _read(spark, folder, "doc_records").select("doc_id", "updated_at", "status").distinct().withColumn("_o", F.struct("updated_at", "status"))
    return stream.transitions(versions, "doc_id", "_o", "status").select("doc_id", "_o.updated_at", "before", "after")


@_query(f"""WITH {_RECORDS} SELECT doc_id, regexp_matches(doc_id, '^[a-f0-9]{{12}}$') AS valid_id,
coalesce(CASE status WHEN 'ready' THEN '待翻译' WHEN 'translating' THEN '翻译中' WHEN 'completed' THEN '已完成' WHEN 'error' THEN '出错' ELSE status END, status) AS status_name,
CASE WHEN source_language = 'zh' THEN '中文' ELSE 'English' END AS language_name,
strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp,
coalesce(nullif(substring(regexp_replace({_strip(r"regexp_replace(regexp_extract(name, '([^/\\\\]*)$', 1), '^(.+)\.[^.]*$', '\1')")}, '[<>:"/\\|?*]', '_', 'g'), 1, 180), ''), 'document') || '_' || doc_id || '_译文.docx' AS output FROM r""")
def record_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What is derived from a record."""
    r = _records(spark, folder)
    moment = F.col("updated_at").cast("timestamp")
    return r.select(
        "doc_id", F.col("doc_id").rlike(engine.ID).alias("valid_id"), T.label(F.col("status"), T.DOCUMENT_STATES).alias("status_name"),
        F.when(F.col("source_language") == "zh", T.LANGUAGES["zh"]).otherwise(T.LANGUAGES["en"]).alias("language_name"), T.utc_stamp(moment).alias("stamp"), sinks.output_name(F.col("name"), F.col("doc_id")).alias("output"),
    )


@_query(r"""WITH f AS (SELECT source, file_name, doc_id, lower(regexp_extract(coalesce(file_name, ''), '\.([^./\\]+)$', 1)) AS suffix FROM documents WHERE source IS NOT NULL),
k AS (SELECT *, CASE WHEN suffix IN ('doc', 'docx', 'pdf') THEN 'document' WHEN suffix IN ('png', 'jpg', 'jpeg', 'webp', 'gif', 'bmp') THEN 'image' END AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM f)
SELECT source, max(file_name) FILTER (n = 1) AS "left", max(file_name) FILTER (n = 2) AS "right", coalesce(max(kind) FILTER (n = 1) = max(kind) FILTER (n = 2), false) AS comparable FROM k WHERE n <= 2 GROUP BY source""")
def compared_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first two files of each source, and whether they may be compared."""
    return segments.compared(_read(spark, folder, "documents").where("source is not null"), "source", "doc_id", "file_name")


@_query(f"""WITH {_SEGMENTS}, v AS (SELECT doc_id, ordinal, {_WEIGHT} AS weight FROM s),
e AS (SELECT *, sum(weight) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS over FROM v),
q AS (SELECT doc_id, i / 10.0::DOUBLE AS ratio, greatest(max(over), 1.0) * (i / 10.0::DOUBLE) AS want, max(ordinal) AS latest FROM e, range(11) t(i) GROUP BY doc_id, i)
SELECT q.doc_id, q.ratio, coalesce(min(e.ordinal) FILTER (e.over >= q.want - 1e-9), any_value(q.latest)) AS ordinal FROM q JOIN e ON e.doc_id = q.doc_id GROUP BY q.doc_id, q.ratio""")
def weight_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """J06 where no positions are known: lookup by weights of every tenth of each document."""
    rows = _segments(spark, folder).withColumn("weight", T.visual_weight(F.coalesce("source", F.lit(""))))
    entries = ordered.prefix_sums(rows, "doc_id", "ordinal", "weight").select("doc_id", "ordinal", "start", (F.col("end") + 1e-9).alias("end"))  # sums of blocks differ in the last digits
    asked = entries.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("ratio"))
    return align.by_weight(entries, asked, "doc_id", "ratio").select("doc_id", "ratio", "ordinal")


@_query(f"""WITH {_SEGMENTS}, a AS (SELECT doc_id, count(*) FILTER (length({_strip("coalesce(source, '')")}) > 0) AS n_paragraphs, count(*) AS n_segments FROM s GROUP BY doc_id)
SELECT s.doc_id, ordinal, {_strip("coalesce(translation, '')")} AS text FROM s JOIN a ON a.doc_id = s.doc_id AND n_paragraphs = n_segments""")
def template_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Translations for the paragraphs of templates, here the visible sources; documents of other counts have none."""
    rows = _segments(spark, folder)
    return sinks.backfilled(rows.where(F.length(T.strip(F.coalesce("source", F.lit("")))) > 0), rows)[0]


@_query(f"""WITH {_SEGMENTS}, {_RECORDS}, o AS (SELECT DISTINCT s.doc_id FROM s JOIN r USING (doc_id) WHERE length({_strip("coalesce(translation, '')")}) > 0)
SELECT (SELECT count(DISTINCT original_path) + CAST(bool_or(original_path IS NULL) AS INT) FROM doc_records) AS removed, (SELECT count(*) FROM o) AS exported""")
def finalised_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many record files go and how many documents are exported."""
    paths = _read(spark, folder, "doc_records").select(F.col("original_path").alias("path"))
    return sinks.finalised(_records(spark, folder), _segments(spark, folder), [paths, paths])[1]


@_query("WITH c AS (SELECT seq % 97 AS upload, octet_length(encode(coalesce(source, ''))) AS n FROM edits) SELECT upload, CAST(sum(n) AS BIGINT) AS size, CASE WHEN sum(n) > 5000 THEN 413 END AS reject FROM c GROUP BY upload")
def upload_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of uploads that come in chunks (here: all sources, dealt to 97 uploads), refused above 5,000."""
    chunks = _read(spark, folder, "edits").select((F.col("seq") % 97).alias("upload"), F.encode(F.coalesce("source", F.lit("")), "UTF-8").alias("content"))
    return segments.upload_sizes(chunks, "upload", "content", 5000)


@_query(r"""WITH p AS (SELECT doc_id, file_name AS path FROM documents UNION ALL SELECT -doc_id, '../' || file_name FROM documents)
SELECT doc_id, coalesce(path <> '' AND NOT regexp_matches(path, '^([/\\]|[A-Za-z]:)') AND doc_id >= 0, false) AS allowed FROM p""")
def path_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that stay below their root."""
    docs = _read(spark, folder, "documents")
    both = docs.select("doc_id", F.col("file_name").alias("path")).unionByName(docs.select((-F.col("doc_id")).alias("doc_id"), F.concat(F.lit("../"), "file_name").alias("path")))
    return both.select("doc_id", readers.inside(F.col("path")).alias("allowed"))
