"""Missing or wrong document language labels (problem 2).

A multinomial naive Bayes classifier over hashed character n-grams (script block, one, two and three
characters) is trained on labelled sample sentences; its log-probability matrix is broadcast, and texts are scored in numpy: n-gram hashes of a whole batch index the matrix, and the rows are summed
over each sentence-like unit. Units give the language of stretches, of texts and of groups of texts.

Texts are folded first (see unify), so look-alike letters, width forms and invisible characters do not matter;
letters are compared in lower case; codes and numbers are left out.

Edge cases: null, empty and blank texts, codes, markup and garbled text have no unit with a language, hence no
language; ties go to the language first in the alphabet of codes; length is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import charspace as cs
from foliant.llm import unify

#: Buckets of each order of n-grams, additive smoothing, and the most labelled rows used for training.
BUCKETS, ALPHA, MOST_SAMPLES = 1 << 14, 0.05, 20_000
#: The class of text in no language.
NONE = ""
#: English names and ISO 639-2 codes of the languages labels may name.
NAMES = {
    "zh": "chinese mandarin zho chi cn", "en": "english eng", "de": "german deutsch deu ger", "fr": "french français francais fra fre",
    "es": "spanish español espanol castilian spa", "ru": "russian rus", "ja": "japanese jpn jp", "th": "thai tha",
}
#: Labels that name no language.
NO_LANGUAGE = ["und", "auto", "n/a", "na", "none", "null", "unknown", "mul", "zxx", "xx", "-", "?"]
#: A Thai unit, which has no terminator, is a sentence from so many letters on.
THAI_SENTENCE = 25
ENDS = [ord(c) for c in "。！？!?…"]


def label_code(label: Column) -> Column:
    """The two-letter code a label names: a code or an English name in any case, with spaces, a region or a script; else null."""
    plain = F.regexp_replace(F.lower(label), r"[\s\x{a0}\x{3000}\x{200b}-\x{200d}\x{feff}]+", "")
    base = F.regexp_extract(plain, r"^([\p{L}]+)", 1)
    code = F.when(F.length(plain) == 0, None).when(plain.isin(NO_LANGUAGE) | base.isin(NO_LANGUAGE), None)
    for lang, names in NAMES.items():
        code = code.when(base.isin([lang, *names.split(" ")]), lang)
    return code.when(base.rlike("^[a-z]{2,3}$"), base)


@dataclass(frozen=True)
class Model:
    """langs in the order of the columns; logs: four matrices (BUCKETS, languages) of log probabilities."""

    langs: tuple[str, ...]
    logs: tuple[np.ndarray, ...]


def _letters() -> np.ndarray:
    """0 no letter, 1 letters of scripts with words, 2 ideographs and kana, 3 Thai."""
    import unicodedata as ucd

    t = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = ucd.category(chr(cp)) if not 0x3400 <= cp <= 0x9FFF and not 0xAC00 <= cp <= 0xD7A3 and not 0xD800 <= cp <= 0xF8FF else "Lo"
        t[cp] = c[0] in "LM" and not 0xD800 <= cp <= 0xF8FF
    t[0x2E80:0x2FE0] = t[0x3041:0x3097] = t[0x30A1:0x30FB] = t[0x30FC:0x30FF] = t[0x3400:0xA000] = t[0xF900:0xFB00] = t[0x3005:0x3008] = 2
    t[0xE01:0xE5C] = 3
    return t


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        from foliant.llm import quality

        _TABLES["letter"] = _letters()
        _TABLES["lower"] = np.minimum(quality._chars()["lower"], 0xFFFF).astype(np.uint16)
        space = np.zeros(0x10000, np.uint8)
        from foliant.llm.splitting import LINES, SPACES

        space[SPACES], space[LINES] = 1, 2
        _TABLES["space"] = space
        end = np.zeros(0x10000, bool)
        end[ENDS] = True
        _TABLES["end"] = end
    return _TABLES


@dataclass
class Units:
    """Sentence-like units of a batch: row, letters (ideographs count ``wide``), and whether the unit ends like a sentence."""

    row: np.ndarray
    letters: np.ndarray
    wide: np.ndarray
    whole: np.ndarray
    features: tuple[np.ndarray, ...]
    starts: np.ndarray


def units(cps: np.ndarray, off: np.ndarray) -> Units:
    """Folds a batch, cuts it into units and hashes the n-grams of their letters."""
    t = _tables()
    cps, off = unify.fold(cps, off)
    own = np.minimum(cps, 0xFFFF).astype(np.uint16)
    low = t["lower"][own]
    letter, space, n = t["letter"][low], t["space"][low], len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return Units(none, none, none, none.astype(bool), (none,) * 4, none)
    row = cs.row_of(off)
    nxt_space, nxt_letter = np.r_[space[1:], 2], np.r_[letter[1:], 0]
    prev_letter = np.r_[0, letter[:-1]]
    ends = off[1:][np.diff(off) > 0] - 1  # no look beyond a row
    nxt_space[ends], nxt_letter[ends] = 2, 0
    prev_letter[off[:-1][off[:-1] < n]] = 0
    # a full stop ends a unit before white space, but not before a small letter nor behind one or two letters with a capital
    small = (letter == 1) & (own == low)
    ahead = np.r_[small[2:], False, False][:n]
    capital = (letter == 1) & (own != low)
    other = np.r_[True, letter[:-1] != 1]
    brief = np.r_[False, (capital & other)[:-1]] | np.r_[False, False, (capital & other)[:-2]][:n] & (prev_letter == 1)
    point = low == 46
    shut = np.isin(low, [34, 41, 93, 0xBB, 0x201C, 0x201D])
    behind = np.r_[np.where(shut, nxt_space, 0)[1:], 0]  # white space behind a closing mark
    stop = t["end"][low] | (point & (behind > 0)) | (point & (nxt_space > 0) & ((nxt_space == 2) | ~ahead) & ~brief) | (point & ((prev_letter == 2) | (nxt_letter == 2)))
    thai_gap = (space == 1) & (prev_letter == 3) & (nxt_letter == 3)
    edge = stop | (space == 2) | thai_gap
    begin = np.r_[True, edge[:-1]]
    begin[off[:-1][off[:-1] < n]] = True
    unit = np.cumsum(begin) - 1
    total = int(unit[-1]) + 1
    # letters of codes (AB-123, v2) are no text
    digit = (low >= 48) & (low <= 57)
    word = (letter == 1) | digit
    head = word & (np.r_[True, ~word[:-1]] | begin)
    number = np.cumsum(head) - 1
    runs = int(number[-1]) + 1 if word.any() else 0
    text = letter.copy()
    if runs:
        where = np.where(word, number, runs)
        size = np.bincount(where, minlength=runs + 1)
        coded = np.bincount(where, digit, runs + 1) > 0
        last = np.flatnonzero(word & np.r_[~word[1:] | begin[1:], True])
        dash = (low[np.minimum(last + 1, n - 1)] == 45) & digit[np.minimum(last + 2, n - 1)]
        coded[:runs] |= dash & (size[:runs] <= 4)
        coded[runs] = False
        text[coded[where]] = 0
    # in a unit of ideographs, names in Latin letters make no language
    han, latin = np.bincount(unit, text == 2, total), np.bincount(unit, text == 1, total)
    text[((han >= 3) & (latin < 8 * han))[unit] & (text == 1)] = 0
    # n-grams over letters, a separator standing for any run of other characters
    keep = (text > 0) | ((np.r_[0, text[:-1]] > 0) & (text == 0)) | begin
    ch = np.where(text > 0, low, 32)[keep].astype(np.uint32)
    starts = np.flatnonzero(begin[keep])
    a = np.r_[np.uint32(32), ch[:-1]]
    a[starts] = 32
    b = np.r_[np.uint32(32), a[:-1]]
    b[starts] = 32
    mix = lambda x, m: ((x * np.uint32(m)) >> np.uint32(18)).astype(np.int64)
    features = (mix(ch >> np.uint32(6), 0x9E3779B1), mix(ch, 0x85EBCA6B), mix(ch * np.uint32(0x01000193) ^ a, 0xC2B2AE35), mix((ch * np.uint32(0x01000193) ^ a) * np.uint32(0x01000193) ^ b, 0x27D4EB2F))
    narrow = np.bincount(unit, (text == 1) | (text == 3), total).astype(np.int64)
    wide = np.bincount(unit, text == 2, total).astype(np.int64)
    last_of = np.r_[np.flatnonzero(begin)[1:], n] - 1
    thai = np.bincount(unit, text == 3, total) >= THAI_SENTENCE
    return Units(row[np.flatnonzero(begin)], narrow, wide, stop[last_of] | thai_gap[last_of] | thai, features, starts)


def unreadable(samples: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Made-up rows of text in no language: random letters, base64, hexadecimal, and texts decoded wrongly."""
    import base64

    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    consonants = np.array(list("bcdfghjklmnpqrstvwxz"))
    words = lambda of, n: " ".join("".join(rng.choice(of, rng.integers(1, 9))) for _ in range(n))
    rows = [words(letters, 12) for _ in range(100)] + [words(consonants, 12) for _ in range(150)]
    rows += [base64.b64encode(rng.bytes(48)).decode() for _ in range(200)]
    rows += [" ".join(x for x in rng.bytes(24).hex(" ").split(" ") if not x.isdigit()) for _ in range(100)]
    wrong = [text.encode().decode("latin-1") for lang, text in samples if not text.isascii()]
    return [(NONE, x) for x in rows + wrong[:300]]


def train(samples: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows, of which at most MOST_SAMPLES are used, and rows in no language."""
    samples = samples[:MOST_SAMPLES]
    samples = samples + unreadable(samples)
    langs = tuple(sorted({lang for lang, _ in samples}))
    counts = [np.full((BUCKETS, len(langs)), ALPHA, np.float64) for _ in range(4)]
    for j, lang in enumerate(langs):
        array = pa.array([text for own, text in samples if own == lang])
        for order, h in enumerate(units(*cs.codepoints(cs.flat(array))).features):
            counts[order][:, j] += np.bincount(h, minlength=BUCKETS)
    return Model(langs, tuple(np.log(c / c.sum(0)).astype(np.float32) for c in counts))


def scores(u: Units, model: Model) -> np.ndarray:
    """Log probability of each unit (rows) in each language (columns)."""
    if not len(u.starts):
        return np.zeros((0, len(model.langs)), np.float32)
    each = model.logs[0][u.features[0]]
    for log, h in zip(model.logs[1:], u.features[1:], strict=True):
        each += log[h]
    return np.add.reduceat(each, u.starts, axis=0)


def classify(u: Units, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number of each unit (-1 where there is too little to tell), the confidence in [0, 1], and the log-odds against the next."""
    s = scores(u, model)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    grams = np.diff(np.r_[u.starts, len(u.features[0])])
    per = s / np.maximum(grams, 1)[:, None] * np.minimum(grams, 30)[:, None] / 2  # n-grams are not independent
    p = np.exp(per - per.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = s.argmax(1)
    known = (u.letters >= 4) | (u.wide >= 2)
    top = np.partition(s, -2, axis=1)[:, -2:]
    return np.where(known, best, -1), np.where(known, p.max(1), 0.0), top[:, 1] - top[:, 0]


SCHEMA = "string, confidence double, share double, whole array<string>"


def detect(df: DataFrame, key: list[str], text: str, model: Model, out: str = "lang") -> DataFrame:
    """(*key, lang, confidence, share, whole): the main language of each text, in a column named ``out``.

    lang is the language of most of the text (an ideograph weighs as two letters), null where nothing is readable;
    share is the part of the weight in that language; whole has the languages in which the text holds a whole
    sentence. One row in, one row out.
    """
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size, some 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = cs.flat(b.column(len(key)))
            for i, j in cs.slices(texts):
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(key))), *_summary(texts.slice(i, j - i), own, np.array(own.langs))], [*key, out, "confidence", "share", "whole"])

    return df.select(*key, text).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"`{out}` {SCHEMA}"]))


def _summary(texts: pa.Array, model: Model, langs: np.ndarray) -> list[pa.Array]:
    n, k = len(texts), len(langs)
    u = units(*cs.codepoints(texts))
    best, sure, margin = classify(u, model)
    ok = best >= 0
    weight = (u.letters + 2 * u.wide)[ok].astype(np.float64)
    cell = u.row[ok] * k + best[ok]
    mass = np.bincount(cell, weight, n * k).reshape(n, k)
    trust = np.bincount(cell, weight * sure[ok], n * k).reshape(n, k)
    if NONE in model.langs:
        none = model.langs.index(NONE)
        garbled = 2 * mass[:, none] >= mass.sum(1)
        mass[:, none] = 0
        mass[garbled | _marked_up(texts)] = 0
        ok &= best != none
    main, total = mass.argmax(1), mass.sum(1)
    got = total > 0
    pick = np.arange(n), main
    whole = ok & u.whole & (sure >= SURE) & (((u.letters >= WHOLE_LETTERS) & (margin >= MARGIN)) | (u.wide >= WHOLE_WIDE))
    has = np.zeros((n, k), bool)
    has[u.row[whole], best[whole]] = True
    rows, cols = np.nonzero(has)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has.sum(1))].astype(np.int32)), pa.array(langs[cols], pa.string()))
    with np.errstate(invalid="ignore", divide="ignore"):
        return [pa.array(np.where(got, langs[main], None), pa.string()), pa.array(np.where(got, trust[pick] / total, np.nan), from_pandas=True), pa.array(np.where(got, mass[pick] / total, np.nan), from_pandas=True), lists]


def _marked_up(texts: pa.Array) -> np.ndarray:
    """Texts of which tags and entities are a large part."""
    size = np.maximum(pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    return sum(pa.compute.count_substring(texts, x).to_numpy(zero_copy_only=False) for x in "<&") > 0.02 * size


#: A whole sentence has at least so many letters, told apart by these log-odds, or so many ideographs, and this confidence.
WHOLE_LETTERS, MARGIN, WHOLE_WIDE, SURE = 13, 25.0, 4, 0.8


def stretches(df: DataFrame, key: list[str], text: str, model: Model) -> DataFrame:
    """(*key, stretch int, lang, confidence, letters bigint): one row for each run of units in one language, in order."""
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = np.array(own.langs)
        for b in batches:
            texts = cs.flat(b.column(len(key)))
            for i, j in cs.slices(texts):
                u = units(*cs.codepoints(texts.slice(i, j - i)))
                best, sure, _ = classify(u, own)
                ok = np.flatnonzero((best >= 0) & (langs[best] != NONE))
                row, lang, weight = u.row[ok], best[ok], u.letters[ok] + u.wide[ok]
                new = np.r_[True, (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])][: len(ok)]
                at = np.flatnonzero(new)
                run_no = np.cumsum(new) - 1
                mass = np.bincount(run_no, weight, len(at))
                trust = np.bincount(run_no, weight * sure[ok], len(at)) / np.maximum(mass, 1)
                first = np.searchsorted(row[at], row[at])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i).take(pa.array(row[at])) for k in range(len(key))), pa.array((np.arange(len(at)) - first).astype(np.int32)), pa.array(langs[lang[at]], pa.string()), pa.array(trust), pa.array(mass.astype(np.int64))], [*key, "stretch", "lang", "confidence", "letters"])

    return df.select(*key, text).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "stretch int, lang string, confidence double, letters bigint"]))
