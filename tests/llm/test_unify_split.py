import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import charspace as cs
from foliant.llm import splitting, unify


def fold(*texts):
    return unify.fold_array(pa.array(list(texts), pa.string())).to_pylist()


def test_codepoints_round_trip():
    texts = ["", "a", "é中", "𠮷📦x", None, "\n"]
    a = cs.flat(pa.array(texts))
    cps, off = cs.codepoints(a)
    assert list(np.diff(off)) == [len(x or "") for x in texts] and cs.strings(cps, off).to_pylist() == [x or "" for x in texts]
    assert cs.codepoints(cs.flat(pa.array(texts)).slice(2, 2))[0].tolist() == [ord(c) for c in "é中𠮷📦x"]
    assert list(cs.slices(cs.flat(pa.array(["ab", "cdefgh", "i", "j"])), 3)) == [(0, 1), (1, 2), (2, 4)]
    assert list(cs.slices(cs.flat(pa.array([], pa.string())))) == []


@pytest.mark.parametrize(
    "same",
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ １２，ok", "Full width 12,ok"), ("Ñandoval", "Ñandoval"), ("q̣́", "q̣́"), ("a­b​c‍﻿", "abc"),
        ("a b c　d", "a b c d"), ("раypаl", "paypal"), ("Οne", "One"), ("更量⼯", "更量工"), ("ﬁeld ﬃ", "field ffi"), ("DP‐7‑x", "DP-7-x"),
        ("каталог", "кaтaлoг"), ("ё", "ё"), ("ｶﾞ", "ガ"), ("한", "한"),
    ],
)
def test_same_look(same):
    a, b = fold(*same)
    assert a == b


@pytest.mark.parametrize("other", [("a", "A"), ("2", "²"), ("2", "②"), ("。", "."), ("—", "-"), ("…", "..."), ("a b", "a  b"), ("a\nb", "a b"), ("жa", "xa"), ("é", "e"), ("长", "長")])
def test_visible_differences_stay(other):
    a, b = fold(*other)
    assert a != b


def test_fold_properties():
    rng = random.Random(1)
    pool = "aаoοéẹ́ñ中⼯ａ１  ​Жжß한ᄒ𠮷\n²②ﬁ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    once = fold(*texts)
    assert fold(*once) == once  # a fixed point
    assert once == [fold(x)[0] for x in texts]  # batches do not matter
    assert once[-2] is None and once[-1] == ""
    assert [fold(unicodedata.normalize("NFD", x))[0] for x in texts[:300]] == once[:300]
    assert fold("Груз жёлтый Sørvalen") == ["Груз жёлтый Sørvalen"]


def test_same_look_pairs(spark):
    rows = [(1, "d", "s", "abc"), (2, "d", "s", "ａbc"), (3, "d", "s", "abc"), (3, "d", "s", "abc"), (4, "d", "t", "ａbc"), (5, "d", "s", None), (6, None, "s", "abc"), (7, "d", "s", "ab​c"), (8, "d", "s", "abd")]
    df = spark.createDataFrame(rows, "seq bigint, doc_id string, segment_id string, source string")
    got = sorted(map(tuple, unify.same_look(df, "seq", "source", ["doc_id", "segment_id"]).collect()))
    assert got == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7)]
    assert unify.same_look(df.where("seq < 0"), "seq", "source", []).count() == 0
    classes = unify.look_classes(df, "seq", "source", ["doc_id", "segment_id"]).collect()
    assert {r.key: (r.n_rows, r.n_spellings, r.links) for r in classes} == {1: (4, 3, 2), 2: (4, 3, 3), 3: (4, 3, 2), 7: (4, 3, 3)} and len({r.class_id for r in classes}) == 1
    assert unify.look_classes(df.where("seq < 0"), "seq", "source", []).count() == 0
    clash = df.withColumn("unified", df.source)
    assert unify.unify(clash, "source").columns == ["seq", "doc_id", "segment_id", "source", "unified"]


def test_pairs_of_a_hot_look_against_brute_force(spark):
    """One look holds most rows, in three spellings and all parts; the links of the classes are those of the pairs."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["abc", "ａbc", "ab​c", f"x{i % 9}", f"ｘ{i % 9}"] if i % 3 else ["abc"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, source string")
    look = dict(zip([i for i, _ in rows], fold(*[t for _, t in rows]), strict=True))
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and look[a] == look[b]}
    assert {tuple(r) for r in unify.same_look(df, "seq", "source", []).collect()} == want
    links = {r.key: r.links for r in unify.look_classes(df, "seq", "source", []).collect()}
    assert links == {i: n for i, _ in rows if (n := sum(i in p for p in want))}


def _cuts(text, **k):
    low = np.minimum(np.array([ord(c) for c in text], np.uint32), 0xFFFF)
    (ends, kinds) = splitting.cuts(low, **k)
    return (ends, kinds), splitting.runs_at(low, ends)


def test_splitting_properties():
    rng = random.Random(3)
    for _ in range(60):
        parts = [rng.choice(["word ", "Satz. ", "句子。", "a,b ", "x" * rng.randrange(1, 400), "\n", "…", "3.14 "]) for _ in range(rng.randrange(40, 200))]
        text = "".join(parts)
        limit, overlap = rng.choice([(120, 10), (300, 50), (1200, 100)])
        if len(text) <= limit:
            continue
        (ends, kinds), runs = _cuts(text, limit=limit, overlap=overlap)
        starts = np.r_[0, ends[:-1] - overlap]
        assert ends[-1] == len(text) and (np.diff(ends) > 0).all() and (ends - starts).max() <= limit and (starts >= 0).all()
        run = max(map(len, re.split(r"[\s.,;:!?。，；：！？、…]", text)))
        assert (run > limit) == (max([0, *runs[kinds == 5]]) > limit)
        for e, k in zip(ends[:-1], kinds[:-1], strict=True):
            before = text[e - 1]
            assert {0: before.isspace(), 1: before in ".!?。！？…" or before.isspace(), 2: True, 3: before.isspace(), 4: before in ".,;:!?", 5: True}[int(k)]
        if run < limit - 2 * overlap - 2:
            assert 5 not in kinds


def test_splitting_prefers_lines_and_sentences():
    (ends, kinds), _ = _cuts(("Ein Satz mit Wort, hier. " * 3 + "\n") * 40, limit=200, overlap=20)
    assert set(kinds) <= {0, 6}
    (ends, kinds), _ = _cuts("x" * 5000)
    assert set(kinds) == {5, 6}


@pytest.mark.parametrize("limit", [120, 150, 200, 400, 1200, 5000])
def test_no_cut_inside_words(limit):
    """At any limit: where spaces or marks are within reach, none is cut elsewhere."""
    overlap = limit // 12
    sentence = "word " * 38 + "then. "
    for text in (sentence * 120, "word " * 4000, "a/b.c,d:e" * 2000, ("x" * 90 + " ") * 200):
        (ends, kinds), _ = _cuts(text, limit=limit, overlap=overlap)
        starts = np.r_[0, ends[:-1] - overlap]
        assert ends[-1] == len(text) and (ends - starts).max() <= limit and (np.diff(starts) > 0).all()
        assert 5 not in kinds


def test_split_rows(spark):
    rows = [(1, "x" * 1300), (2, "short"), (3, ""), (4, None), (5, "ab " * 700), (5, "ab " * 700), (6, "𠮷" * 1200)]
    df = spark.createDataFrame(rows, "seq bigint, source string").selectExpr("*", "seq as piece", "source as text")
    out = splitting.split(df, "seq", "source").collect()
    text = dict(rows)
    for r in out:
        assert r.text == text[r.seq][r.start_char : r.end_char] and len(r.text) <= 1200
    assert {r.seq for r in out} == {1, 2, 5, 6}
    assert sorted(map(tuple, splitting.oversized(df, "seq", "source").collect())) == [(1, "hard"), (5, "soft")]
    edge = spark.createDataFrame([(1, "x" * 1200 + " y"), (2, "x" * 1201 + " y"), (3, "a " * 700 + "x" * 1150 + " b"), (4, "u.v/" * 400)], "seq bigint, source string")
    assert sorted(map(tuple, splitting.oversized(edge, "seq", "source").collect())) == [(1, "soft"), (2, "hard"), (3, "soft"), (4, "soft")]
    assert splitting.split(df.where("false"), "seq", "source").count() == 0
