import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliant import engine
from foliant.operators import align, merge, ordered, segments, state, terms


def greedy(lengths, items, chars, lone):
    out, no, n, size = [], -1, 0, 0
    for i, x in enumerate(lengths):
        if i == 0 or (lone and i == 1) or n >= items or size + x > chars:
            no, n, size = no + 1, 0, 0
        out.append(no)
        n, size = n + 1, size + x
    return out


@pytest.mark.parametrize("lone", [False, True])
@pytest.mark.parametrize(
    ("lengths", "bounded", "progressive"),
    [([10] * 5, [[0, 1, 2], [3, 4]], [[0], [1, 2, 3], [4]]), ([5000, 100, 100, 7000, 10, 5990, 5], [[0, 1, 2], [3], [4, 5], [6]], [[0], [1, 2], [3], [4, 5], [6]]), ([7000, 7000], [[0], [1]], [[0], [1]])],
)
def test_batches_literal(spark, lengths, bounded, progressive, lone):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lengths)], "d string, o int, n int")
    rows = ordered.batches(df, "d", "o", "n", 3, 6000, lone_first=lone).collect()
    got = {}
    for r in rows:
        got.setdefault(r.batch_no, []).append(r.o)
    assert [sorted(got[k]) for k in sorted(got)] == (progressive if lone else bounded)


@pytest.mark.parametrize("lone", [False, True])
@pytest.mark.parametrize("block", [3, 7, 65_536])
def test_batches_in_blocks_equal_one_pass(spark, block, lone):
    rng = random.Random(block)
    rows = [(d, i * rng.choice([1, 1, 5]) + i * 10, rng.choice([0, 5, 50, 300, 700])) for d in ("hot", "b", "c") for i in range({"hot": 120, "b": 1, "c": 9}[d])]
    rows = list({(d, o): (d, o, n) for d, o, n in rows}.values())
    df = spark.createDataFrame(rows, "d string, o int, n int")
    got = {(r.d, r.o): r.batch_no for r in ordered.batches(df, "d", "o", "n", 4, 600, lone, block).collect()}
    for d in ("hot", "b", "c"):
        own = sorted((o, n) for g, o, n in rows if g == d)
        assert [got[d, o] for o, _ in own] == greedy([n for _, n in own], 4, 600, lone)


def test_batches_empty(spark):
    assert ordered.batches(spark.createDataFrame([], "d string, o int, n int"), "d", "o", "n", 3, 10).count() == 0


def test_prefix_sums_in_blocks(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 41)] + [("b", 3, 2.0)], "d string, o int, w double")
    got = {(r.d, r.o): (r.start, r.end) for r in ordered.prefix_sums(df, "d", "o", "w", block=7).collect()}
    assert got["b", 3] == (0.0, 2.0)
    assert all(got["a", i] == (i * (i - 1) / 2, i * (i + 1) / 2) for i in range(1, 41))


TERMS = "term_id bigint, file string, row_no int, source string, target string, source_lang string, target_lang string, domain string, notes string"


def test_orientation(spark):
    rows = [(1, "f", 1, "术语表", "glossary", "zh", "en", None, None), (2, "f", 2, " 审校 ", "review", "", "", "", ""), (3, "f", 3, "A", "B", "en", "fr", "", ""), (4, "f", 4, "x", "", "zh", "en", "", ""), (5, "f", 5, "x", "y", None, None, "", "")]
    df = terms.normalized(spark.createDataFrame(rows, TERMS))
    ahead = {r.term_id: (r.source, r.target) for r in terms.oriented(df, "zh", "en").collect()}
    back = {r.term_id: (r.source, r.target) for r in terms.oriented(df, "en", "zh").collect()}
    assert ahead == {1: ("术语表", "glossary"), 2: ("审校", "review"), 5: ("x", "y")}
    assert back == {1: ("glossary", "术语表"), 2: ("审校", "review"), 5: ("x", "y")}


@pytest.mark.parametrize("most", [100_000, 0])
def test_term_matches_both_ways(spark, most):
    rows = [(1, "review"), (2, "STRASSE"), (3, "ab"), (4, "审校"), (5, "review"), (6, None), (7, "")]
    texts = [(1, "a Preview"), (2, "Straße x"), (3, None), (4, ""), (5, "审校ab")]
    want = {(t, k) for t, x in texts if x for k, s in rows if s and s.casefold() in x.casefold()}
    found = terms.matches(spark.createDataFrame(texts, "id int, x string"), "id", "x", spark.createDataFrame(rows, "k bigint, source string"), "k", most_terms=most)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_first_matches(spark):
    found = spark.createDataFrame([(1, k) for k in range(130)], "id int, k int")
    order = spark.createDataFrame([(k, 130 - k) for k in range(130)], "k int, o int")
    got = terms.first_matches(found, order, "id", "k", ["o"]).collect()
    assert len(got) == 120 and min(r.k for r in got) == 10 and {r.rank for r in got if r.k == 129} == {1}


@pytest.mark.parametrize(("done", "total", "want"), [(1, 8, 12), (3, 8, 38), (1, 200, 0), (199, 200, 100), (1, 40, 2)])
def test_coverage_rounds_half_even(spark, done, total, want):
    df = spark.createDataFrame([("d", "x" if i < done else [None, "", " 　"][i % 3]) for i in range(total)], "d string, t string")
    assert tuple(segments.coverage(df, "d", "t").first()) == ("d", total, done, want)


def test_latest_edits_and_merge(spark):
    log = spark.createDataFrame([(2, "s", None, "b"), (1, "s", " n ", "a"), (2, "s", None, "b"), (3, "s", None, None), (9, "t", None, None)], "seq bigint, k string, source string, translation string")
    last = merge.latest_edits(log, ["k"], "seq", ["source", "translation"])
    assert sorted(map(tuple, last.collect())) == [("s", "n", "b"), ("t", None, None)]
    base = spark.createDataFrame([("s", "n", "x"), ("t", None, "y"), ("u", "q", "z")], "k string, source string, translation string")
    got = {r.k: (r.source, r.translation, r.changed) for r in merge.upserted(base, last, ["k"], ["source", "translation"]).collect()}
    assert got == {"s": ("n", "b", True), "t": (None, "y", False), "u": ("q", "z", False)}


def test_sessions(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=m), "d") for i, m in enumerate([0, 10, 41, 71, 72])] + [(0, t, "d")]
    got = merge.sessions(spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, k string"), ["k"], "ts", "seq").orderBy("session_start").collect()
    assert [(r.n, r.last_seq) for r in got] == [(2, 1), (3, 4)]  # a pause of exactly the gap does not part them


def test_page_map_literals(spark):
    seg = [("d", i, s) for i, s in enumerate(["Alpha beta", "Gamma delta", "zzz none", "Epsilon"], 1)] + [("e", i, s) for i, s in enumerate(["one", "two", "one"], 1)] + [("n", 1, None)]
    pages = [("d", 1, "alpha beta gamma"), ("d", 2, "delta epsilon"), ("e", 1, "one two"), ("e", 2, "one three"), ("n", 1, "")]
    got = align.page_map(spark.createDataFrame(seg, "d string, ordinal int, source string"), spark.createDataFrame(pages, "d string, page_no int, text string"), "d")
    rows = {(r.d, r.ordinal): (round(r.position, 6), r.page, r.matched) for r in got.collect()}
    assert [rows["d", i][:2] for i in range(1, 5)] == [(0, 1), (0.253247, 1), (0.540404, 2), (0.708333, 2)]
    assert sum(rows["d", i][2] for i in range(1, 5)) == 2
    assert [rows["e", i] for i in range(1, 4)] == [(0, 1, True), (0.25, 1, True), (0.5, 2, True)]


def test_next_and_lookup(spark):
    mapped = spark.createDataFrame([("d", i, p) for i, p in enumerate([0.0, 0.25, 0.25, 0.5], 1)], "d string, ordinal bigint, position double")
    assert [r.next_position for r in align.with_next(mapped, "d").orderBy("ordinal").collect()] == [0.25, 0.5, 0.5, 1.0]
    asked = spark.createDataFrame([("d", 0.3), ("d", 0.0), ("d", 1.0)], "d string, r double")
    got = {r.r: (r.ordinal, round(r.fraction, 6)) for r in align.looked_up(mapped, asked, "d", "r").collect()}
    assert got == {0.3: (3, 0.2), 0.0: (1, 0.0), 1.0: (4, 1.0)}


def test_zip_and_ids(spark):
    a = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "d string, o int, t string")
    b = spark.createDataFrame([("d", 1, "q")], "d string, o int, u string")
    assert sorted((r.o, r.both) for r in merge.zipped(a, b, ["d", "o"], ["t", "u"]).collect()) == [(1, True), (2, False)]
    ids = spark.createDataFrame([(1,), (12345,)], "o int").select(segments.segment_id(F.col("o")).alias("s"))
    assert [r.s for r in ids.collect()] == ["s0001", "s12345"]


def brute_map(keys, pages):
    """Position, page and hit of each key, from the list of all places of all pages."""
    sizes = [max(1, len(p)) for p in pages]
    places = [(p, o) for p, size in enumerate(sizes) for o in range(size)]
    total, used, cursor, high, out = sum(max(1, len(k)) for k in keys), 0, (0, 0), 0.0, []
    for key in keys:
        probes = sorted({key[:n] for n in (len(key) if len(key) <= 300 else 200, 128, 64, 32, 16, 8)} - {""}, key=len, reverse=True)
        hits = [(*place, len(probe)) for probe in probes for place in places if place >= cursor and pages[place[0]].startswith(probe, place[1])]
        if hits:
            p, o, n = next(h for h in hits if h[2] == hits[0][2])
            raw = (p + o / sizes[p]) / len(pages)
            cursor = (p, o + n) if o + n < sizes[p] else (min(p + 1, len(pages) - 1), 0)
        else:
            gone = used / max(1, total) * sum(sizes)
            p = next(i for i in range(len(pages)) if sum(sizes[: i + 1]) >= gone)
            raw = (p + (gone - sum(sizes[:p])) / sizes[p]) / len(pages)
        high = max(high, raw)
        out.append((round(high, 9), min(len(pages), int(high * len(pages)) + 1), bool(hits)))
        used += max(1, len(key))
    return out


def test_page_map_against_brute_force(spark):
    rng = random.Random(6)
    seg, pages, want = [], [], {}
    for d in range(25):
        words = ["".join(rng.choice("ab1中") for _ in range(rng.choice([0, 3, 9, 20, 350]))) for _ in range(rng.randrange(1, 15))]
        keys = [w if rng.random() < 0.8 else w[:9] + "zz" for w in words]
        own = ["".join(words[i : i + 3]) for i in range(0, len(words), 3)]
        seg += [(d, i, k) for i, k in enumerate(keys)]
        pages += [(d, i, x) for i, x in enumerate(own)]
        want[d] = brute_map(keys, own)
    got = {}
    for r in align.page_map(spark.createDataFrame(seg, "d int, ordinal int, source string"), spark.createDataFrame(pages, "d int, page_no int, text string"), "d").orderBy("d", "ordinal").collect():
        got.setdefault(r.d, []).append((round(r.position, 9), r.page, r.matched))
    assert got == want


def fold(row, log):
    """The state of one segment after its edits, one by one."""
    row = dict(row)
    for e in sorted({x["seq"]: x for x in log}.values(), key=lambda x: x["seq"]):
        if e["source"] is not None:
            row["source"] = e["source"].strip()
        if e["translation"] is not None:
            t = e["translation"].strip()
            if t != (row["translation"] or ""):
                row["status"] = "edited" if t else "empty"
            row["translation"] = t
        if e["locked"] is not None:
            row["locked"] = e["locked"]
        if e["reviewed"] is not None:
            row["status"] = "reviewed" if e["reviewed"] else "edited" if row["translation"] else "empty"
            row["locked"] = e["reviewed"]
    return row


PATCHES = [
    ({"translation": " x "}, ("x", "machine", False)), ({"translation": "y"}, ("y", "edited", False)), ({"translation": ""}, ("", "empty", False)), ({"locked": True}, ("x", "machine", True)),
    ({"reviewed": True}, ("x", "reviewed", True)), ({"reviewed": False}, ("x", "edited", False)), ({"locked": True, "reviewed": False}, ("x", "edited", False)), ({"source": " n "}, ("x", "machine", False)),
]
LOG = "seq bigint, k string, source string, translation string, locked boolean, reviewed boolean"
SEGMENT = "k string, source string, translation string, status string, locked boolean"


def test_edits_literal_and_against_a_fold(spark):
    rng = random.Random(9)
    base = [(f"p{i}", "s", "x", "machine", False) for i in range(len(PATCHES))] + [(f"r{i}", "s", rng.choice(["x", "", None]), rng.choice(["machine", "empty", "edited"]), rng.choice([True, False, None])) for i in range(150)]
    log = [(i, f"p{i}", p.get("source"), p.get("translation"), p.get("locked"), p.get("reviewed")) for i, (p, _) in enumerate(PATCHES)]
    for n in range(900):
        pick = lambda *v: rng.choice([None, None, *v])
        row = (100 + n, f"r{rng.randrange(160)}", pick(" s2"), pick("x", "y ", "", " "), pick(True, False), pick(None, True, False))
        log += [row] * rng.choice([1, 1, 2])
    rng.shuffle(log)
    names = [x.split(" ")[0] for x in LOG.split(", ")]
    got = {r.k: r.asDict() for r in state.edited(spark.createDataFrame(base, SEGMENT), spark.createDataFrame(log, LOG), ["k"], "seq").collect()}
    for row in base:
        own = dict(zip([x.split(" ")[0] for x in SEGMENT.split(", ")], row, strict=True))
        assert got[row[0]] == fold(own, [dict(zip(names, x, strict=True)) for x in log if x[1] == row[0]]), row[0]
    assert [(got[f"p{i}"]["translation"], got[f"p{i}"]["status"], got[f"p{i}"]["locked"]) for i in range(len(PATCHES))] == [w for _, w in PATCHES]
    assert got["p7"]["source"] == "n" and state.edited(spark.createDataFrame([], SEGMENT), spark.createDataFrame(log, LOG), ["k"], "seq").count() == 0


GUARDS = [("a", "", "empty", False), ("b", "t", "machine", False), ("c", "", "edited", False), ("d", "t", "reviewed", True), ("e", "", "empty", True), ("f", " ", "machine", False), ("g", "t", "edited", None), ("h", None, None, None)]


def test_guards(spark):
    df = spark.createDataFrame(GUARDS, "k string, translation string, status string, locked boolean")
    assert sorted(r.k for r in state.pending(df).collect()) == ["a", "h"] and sorted(r.k for r in state.pending(df, True).collect()) == ["a", "b", "f", "h"]
    assert {r.k for r in state.queued(df, df, ["k"]).where("status = 'queued'").collect()} == {"a", "b", "f", "h"}
    assert {r.k for r in state.eligible(df.select("k"), df, ["k"]).collect()} == {"a", "b", "f", "h"}
    new = df.select("k", F.lit("n").alias("text"))
    for overwrite, one, want in ((False, False, "ah"), (True, False, "abfh"), (False, True, "abcfgh")):
        rows = state.answered(df, new, ["k"], overwrite, one).collect()
        assert "".join(sorted(r.k for r in rows if r.applied)) == want and all((r.translation, r.status) == ("n", "machine") for r in rows if r.applied)
    under = spark.createDataFrame([("a", " ", "queued"), ("b", "t", "translating"), ("c", "t", "edited")], "k string, translation string, status string")
    assert {r.k: r.status for r in state.settled(under).collect()} == {"a": "empty", "b": "machine", "c": "edited"}


def test_saves_and_rows_shown(spark):
    df = spark.createDataFrame([("d", "a", "x", "machine"), ("d", "b", "y", "machine"), ("d", "c", None, "empty")], "doc_id string, segment_id string, translation string, status string")
    saves = spark.createDataFrame([("d", {"a": " x ", "b": "", "c": "", "z": "q"})], "doc_id string, translations map<string,string>")
    got = {r.segment_id: (r.translation, r.status, r.changed) for r in engine.apply_autosave(df, saves).collect()}
    assert got == {"a": ("x", "machine", False), "b": ("", "empty", True), "c": (None, "empty", False)}
    dirty = spark.createDataFrame([("d", "a", "mine"), ("d", "b", None)], "doc_id string, segment_id string, translation string")
    key = ["doc_id", "segment_id"]
    assert {r.segment_id: r.translation for r in state.shown(df, dirty, key).collect()} == {"a": "mine", "b": "", "c": ""}
    sent = spark.createDataFrame([("d", "a", "older"), ("d", "b", "")], "doc_id string, segment_id string, translation string")
    assert [r.segment_id for r in state.unsaved(dirty, sent, key).collect()] == ["a"]


def test_archive_and_start(spark):
    records = spark.createDataFrame([("0" * 12, "n"), ("1" * 12, "m")], "doc_id string, name string")
    ids = spark.createDataFrame([("0" * 12,), ("bad",)], "doc_id string")
    assert [r.doc_id for r in engine.archive(records, ids, "20250101-000000").collect()] == ["1" * 12]
    taken = spark.createDataFrame([("0" * 12 + "-20250101-000000",), ("0" * 12 + "-20250101-000000-2",)], "archived_as string")
    assert {r.archived_as for r in state.archived(records, ids, "20250101-000000", taken).collect()} == {None, "0" * 12 + "-20250101-000000-3"}
    assert engine.document(records, "1" * 12).count() == 1 and engine.document(records, "1").count() == 0
    asked = spark.createDataFrame([(1, "0" * 12, "zh", "en"), (2, "0" * 12, "zh", "en"), (3, "1" * 12, "zh", "en"), (4, "1" * 12, "zh", "zh"), (5, "x", "zh", "en")], "request_id int, doc_id string, source_language string, target_language string")
    running = records.where(f"doc_id = '{'1' * 12}'")
    assert {r.request_id: (r.answer, r.begins) for r in state.started(asked, records, running).collect()} == {1: (202, True), 2: (202, False), 3: (202, False), 4: (400, False), 5: (404, False)}
