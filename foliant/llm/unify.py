"""Visually identical text with different characters (problem 3).

``unify`` brings text to one form that is equal exactly for strings that look the same: width forms, composed
or separate accents, invisible characters, kinds of spaces and look-alike characters (letters of other
scripts, radicals and compatibility ideographs, ligatures, hyphens) are folded. Differences one can see
(case, raised or circled digits, other punctuation, the number of spaces, line breaks) are kept.

The batch goes through lookup tables over all code points: an expansion length and an expansion start per
code point, a gather, then canonical ordering and composition of marks, all on whole arrays.

Edge cases: null stays null, the empty string stays empty, a text of invisible characters becomes empty;
length is not limited. Unpaired or unknown code points map to themselves.
"""

from __future__ import annotations

import unicodedata as ucd
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import session
from foliant.llm import charspace as cs

#: Letters drawn alike. Each Latin letter is followed by the letters of other scripts drawn like it.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ",
    "v": "ν", "w": "ԝ", "x": "х", "y": "у",
}
#: Hyphens drawn like the hyphen-minus.
HYPHENS = "‐‑﹣－"
#: Default ignorable characters that are not of the format category.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
SIZE = 0x110000


def _seen_as(ch: str) -> str:
    """What one character folds to before marks are composed again."""
    cp, kind = ord(ch), ucd.category(ch)
    if kind == "Cs" or kind == "Co":
        return ch
    if kind == "Cf" or ch in UNSEEN or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    tag = ucd.decomposition(ch).split(" ")[0]
    radical = 0x2E80 <= cp <= 0x2FDF
    ligature = 0xFB00 <= cp <= 0xFB4F or "LIGATURE" in ucd.name(ch, "") and cp < 0x250
    if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and (radical or ligature)):
        return "".join(map(_seen_as, ucd.normalize("NFKD", ch)))
    if tag and not tag.startswith("<"):
        return "".join(_seen_as(c) if c != ch else c for c in ucd.normalize("NFD", ch))
    return ch


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made from the Unicode data of the interpreter and LOOK_ALIKES."""
    twin = {ord(o): ord(latin) for latin, others in LOOK_ALIKES.items() for o in others}
    length, start, out = np.ones(SIZE, np.uint8), np.arange(SIZE, dtype=np.int32), []
    order = np.zeros(SIZE, np.uint8)
    heads, keys, made = [], [], []
    for cp in range(SIZE):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or 0x2FA20 <= cp <= 0xE0000 or cp >= 0xF0000:
            continue
        ch = chr(cp)
        order[cp] = ucd.combining(ch)
        seen = [twin.get(ord(c), ord(c)) for c in _seen_as(ch)]
        if seen != [cp]:
            heads.append((cp, len(out), len(seen)))
            out += seen
        parts = ucd.decomposition(ch).split(" ")
        if len(parts) == 2 and not parts[0].startswith("<") and ucd.normalize("NFC", ch) == ch:
            a, b = (int(p, 16) for p in parts)
            a, b = twin.get(a, a), twin.get(b, b)
            keys.append(a << 21 | b)
            made.append(twin.get(cp, cp))
    for lead in range(19):  # syllables from their parts, by the rule of the standard
        for vowel in range(21):
            syllable = 0xAC00 + (lead * 21 + vowel) * 28
            keys.append(0x1100 + lead << 21 | 0x1161 + vowel)
            made.append(syllable)
            keys += [syllable << 21 | 0x11A7 + tail for tail in range(1, 28)]
            made += [syllable + tail for tail in range(1, 28)]
    flat = np.concatenate([np.arange(SIZE, dtype=np.uint32), np.array(out, np.uint32)])
    for cp, at, n in heads:
        start[cp], length[cp] = SIZE + at, n
    keys_, first = np.unique(np.array(keys, np.int64), return_index=True)
    own = np.zeros(SIZE, np.uint8)  # letters that only one script has: 1 Cyrillic, 2 Greek
    back = [np.arange(SIZE, dtype=np.uint32) for _ in range(3)]
    for script, (lo, hi) in ((1, (0x400, 0x52F)), (2, (0x370, 0x3FF))):
        for cp in range(lo, hi + 1):
            if ucd.category(chr(cp))[0] == "L" and length[cp] == 1 and start[cp] == cp:
                own[cp] = script
        for other, latin in twin.items():
            if lo <= other <= hi:
                back[script][latin] = other
        for cp in range(lo, hi + 1):  # letters with marks that exist in both scripts
            parts = [int(p, 16) for p in ucd.decomposition(chr(cp)).split(" ") if p and not p.startswith("<")]
            both = ucd.normalize("NFC", chr(twin[parts[0]]) + chr(parts[1])) if len(parts) == 2 and parts[0] in twin else ""
            if len(both) == 1:
                back[script][ord(both)] = cp
    letter = np.zeros(SIZE, bool)
    for lo, hi in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x300, 0x36F), (0x370, 0x52F)):
        letter[lo : hi + 1] = True
    letter[[0xD7, 0xF7]] = False
    return {"length": length, "start": start, "flat": flat, "order": order, "keys": keys_, "made": np.array(made, np.uint32)[first], "own": own, "back": np.stack(back), "letter": letter}


def _ordered(cps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Canonical order of runs of marks, by swaps of neighbours until none is left."""
    rank = order[cps]
    while len(at := np.flatnonzero((rank[:-1] > rank[1:]) & (rank[1:] > 0))):
        at = at[np.r_[True, np.diff(at) > 1]]
        cps[at], cps[at + 1] = cps[at + 1].copy(), cps[at].copy()
        rank[at], rank[at + 1] = rank[at + 1].copy(), rank[at].copy()
    return cps


def fold(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points and row offsets of a batch."""
    t = tables()
    n = t["length"][cps]
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    offsets = ends[offsets]
    if ends[-1] == len(cps) and n.all() if len(n) else True:
        out = t["flat"][t["start"][cps]]
    else:
        first = t["start"][cps] - ends[:-1]
        out = t["flat"][np.repeat(first, n) + np.arange(ends[-1])]
    order = t["order"]
    marks = order[out] > 0
    jamo = (out >= 0x1160) & (out <= 0x11FF)
    if marks.any() or jamo.any():
        out = _ordered(out.copy(), order)
        inside = np.ones(len(out), bool)  # a mark at the start of a row has no base
        inside[offsets[:-1][offsets[:-1] < len(out)]] = False
        while True:
            at = np.flatnonzero(((order[out[1:]] > 0) | ((out[1:] >= 0x1160) & (out[1:] <= 0x11FF))) & inside[1:])
            key = out[at].astype(np.int64) << 21 | out[at + 1]
            where = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = t["keys"][where] == key
            at, where = at[hit], where[hit]
            if not len(at):
                break
            free = np.r_[True, np.diff(at) > 1]
            at, where = at[free], where[free]
            out[at] = t["made"][where]
            keep = np.ones(len(out), bool)
            keep[at + 1] = False
            offsets = offsets - np.searchsorted(at + 1, offsets, "left")
            out, inside = out[keep], inside[keep]
    own = t["own"][out]
    if own.any():  # words with letters of one script only are written in that script altogether
        letter = t["letter"][out]
        begins = letter & np.r_[True, ~letter[:-1]]
        begins[offsets[:-1][offsets[:-1] < len(out)]] = True
        word = np.cumsum(begins) - 1
        script = np.zeros(word[-1] + 2, np.uint8)
        at = np.flatnonzero(own)
        script[word[at[::-1]]] = own[at[::-1]]  # the first such letter of a word decides
        of = np.where(letter, script[np.maximum(word, 0)], 0)
        out = t["back"][of, out]
    return out, offsets


def fold_array(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """fold() of an Arrow string array; nulls stay null."""
    plain = cs.flat(array)
    parts = [cs.strings(*fold(*cs.codepoints(plain.slice(i, j - i)))) for i, j in cs.slices(plain)]
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    return pa.compute.if_else(array.is_null() if not isinstance(array, pa.ChunkedArray) else array.combine_chunks().is_null(), None, out)


def unify(df: DataFrame, column: str, out: str = "unified") -> DataFrame:
    """df with the folded form of a string column in ``out`` (replaced where the name exists). One row in, one row out."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(f)) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, fold_array(b.column(b.schema.get_field_index(column))).cast(pa.string())], [*names, out])

    names = [f.name for f in kept]
    return df.select(*{*names, column} if column == out else names).mapInArrow(run, schema)


#: Parts into which the rows of one spelling are dealt, so that none is as large as its spelling.
PARTS = 64


def _looks(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """(_key, *within, _l1, _l2, _s1, _s2), distinct: hashes of the look and the spelling of every row that has all of them."""
    schema = ", ".join(["_key bigint", *(f"`{c}` {dict(df.dtypes)[c]}" for c in within), "_text string", "_look string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, fold_array(b.column(len(b.columns) - 1)).cast(pa.string())], [*b.schema.names, "_look"])

    found = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_key"), *within, F.col(text).alias("_text")).mapInArrow(run, schema)
    one, two = F.lit(0), F.lit(1)
    hashes = [F.xxhash64(n, c).alias(name) for c, of in (("_look", "_l"), ("_text", "_s")) for n, name in ((one, f"{of}1"), (two, f"{of}2"))]
    return found.select("_key", *within, *hashes).distinct()


def look_classes(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """(key, *within, class_id bigint, spelling_id bigint, n_rows, n_spellings, links): one row a key and group of the looks with several spellings.

    links is the number of rows of the class that are spelled otherwise. Counts are made of partial aggregates, and
    no pair is made; a class and a spelling are named by a hash, unique within their group.
    """
    hashed = session.written(_looks(df, key, text, within))
    look = [*within, "_l1", "_l2"]
    spelled = hashed.groupBy(*look, "_s1", "_s2").agg(F.count("*").alias("_n"))
    sizes = spelled.groupBy(*look).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_spellings")).where("n_spellings > 1")
    several = spelled.join(sizes, look)
    return hashed.join(several, [*look, "_s1", "_s2"]).select(F.col("_key").alias("key"), *within, F.col("_l1").alias("class_id"), F.col("_s1").alias("spelling_id"), "n_rows", "n_spellings", (F.col("n_rows") - F.col("_n")).alias("links"))


def same_look(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """Pairs (key_a < key_b) of rows of one group ``within`` whose texts are different strings of one look.

    Rows repeated with the same key count once. Only looks with several spellings go on. The rows of a spelling are
    dealt to PARTS parts; the parts of a look that differ in spelling are paired first, from counts, and their rows
    are attached then, so rows with exactly the same string never meet, no group is collected, and a spelling that
    holds a third of all rows is spread. Strings are compared by two independent 64-bit hashes, which are written
    once in the shared folder when this is called. A null text, a null key or a null group column takes part in no pair; an empty group list means the
    whole table. look_classes has the same links without expanding them.
    """
    hashed = session.written(_looks(df, key, text, within).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(PARTS)).cast("int")))
    look, cell = [*within, "_l1", "_l2"], ["_s1", "_s2", "_part"]
    spelling = F.struct("_s1", "_s2")
    several = hashed.groupBy(*look).agg(F.min(spelling).alias("_lo"), F.max(spelling).alias("_hi")).where("_lo <> _hi").select(*look)
    rows = hashed.join(several, look, "left_semi")
    cells = rows.select(*look, *cell).distinct()
    other = cells.withColumnsRenamed({"_s1": "_o1", "_s2": "_o2", "_part": "_opart"})
    kinds = cells.join(other, look).where((F.col("_s1") < F.col("_o1")) | ((F.col("_s1") == F.col("_o1")) & (F.col("_s2") < F.col("_o2"))))
    first = kinds.join(rows.withColumnRenamed("_key", "_a"), [*look, *cell])
    both = first.join(rows.withColumnsRenamed({"_key": "_b", "_s1": "_o1", "_s2": "_o2", "_part": "_opart"}), [*look, "_o1", "_o2", "_opart"]).where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()
