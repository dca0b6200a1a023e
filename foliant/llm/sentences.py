"""Sentence boundaries across languages and scripts (problem 5).

Everything is a SQL expression: terminators that end nothing (decimals, URLs, initials, abbreviations, numbers
of headings, terminators inside quotations) are masked by private-use placeholders of the same length, a
marker is put behind every terminator left, by the rules of its script, and the text is split at the markers.
As masking keeps the length, the pieces give the positions in the original text.

Rules: a line break ends a unit. The full-width terminators end one wherever they stand; the Latin ones where
white space and a capital, digit or character of another script follow, or where the white space is missing
between a small and a capital letter. A quotation within a sentence is not cut; behind a quotation that ends
with a terminator a new unit starts if a new sentence does. In Thai, white space between two Thai characters
separates. Semicolons, colons and dashes end nothing.

Edge cases: a null or empty text, and one without visible characters, has no unit; a text without a terminator
is one unit; positions count code points, so characters outside the BMP count once; length is not limited, and
positions are sums over blocks, so time grows in proportion to it. The placeholders U+E000 to U+E003 in the input
are exchanged for another private character first, so they end nothing and move nothing. Runs of hidden
characters longer than words are matched across are shortened before and their lengths added to the positions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any Unicode kind, as str.strip() takes it, and characters that are not seen.
SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
TRIM = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
HIDDEN = "\\x{ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}"
LINE = "\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}"
UNSEEN = "".join(map(chr, [0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF]))
#: Placeholders: a masked terminator, one inside a quotation, and the cut marker.
MASKED, QUOTED, CUT, TOLD = "\ue000", "\ue001", "\ue002", "\ue003"  # TOLD: in a quotation behind a colon
#: What stands for these characters of the input, and hidden characters in a row that patterns look across.
OTHER, ACROSS = "\ue010", 2

#: Abbreviations that never end a sentence (they stand before a name, a number or a word).
ABBREVIATIONS = (
    "Mr Mrs Ms Messrs Dr Prof No Nos Vol pp doc Fig Figs Sec Secs Ver approx vs cf Nr Abschn Abs Anl Art ca bzw vgl Hr Fr aprox Sr Sra Srta pág págs párr p "
    "núm al e.g i.e z.B d.h u.a p.ex p.ej Mme Mlle т.е т.д см им рис стр гл Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
)
#: Abbreviations that, in a text all in capitals, are taken as standing within the sentence.
CAPITALS = "ETC INC LTD CORP CO FF"
#: Months behind an ordinal number (German).
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Words that go on with the sentence behind an ellipsis or a quotation.
GO_ON = "随后 然后 接着 之后 但 而 并"
GO_ON_QUOTED = "と 字样 的"
#: Letters drawn like Latin ones, which abbreviations may be typed with.
DRAWN_ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Z": "Ζ",
    "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "оο", "p": "р", "s": "ѕ", "x": "х", "y": "у",
}
_OPEN, _SHUT = "“«「『", "”»」』"
_CLOSE = f"(?:[{HIDDEN}]*[{_SHUT}’）】〕〉》\\])])*"
_DOT = "[.．]"
_END = ".．!?。！？…"
_CJK = "\\x{2e80}-\\x{2fdf}\\x{3005}\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}"
_THAI = "\\x{e01}-\\x{e5b}"
_IN_QUOTES = f"[^{_OPEN}{_SHUT}{LINE}]*+"
#: A terminator in a quotation, from its opening mark or the terminator before; $1 is what stands before it.
_QUOTED_END = f"[{_OPEN}](?={_IN_QUOTES}[{_SHUT}])|(?!^)\\G)[^{_OPEN}{_SHUT}{LINE}{_END}]*+)[{_END}]"


def _letter(ch: str) -> str:
    """All ways in which a letter may be typed, in either case."""
    ways = "".join(c + DRAWN_ALIKE.get(c, "") + "".join(latin for latin, others in DRAWN_ALIKE.items() if c in others) + (chr(ord(c) + 0xFEE0) if c.isascii() else "") for c in (ch.lower(), ch.upper()))
    return f"[{ways}]"


def _word(word: str, z: str) -> str:
    """A pattern of an abbreviation; z: what may stand between its letters."""
    parts = []
    for ch in word:
        apart = unicodedata.normalize("NFD", ch)
        parts.append(f"{_DOT}[{SPACE}]?" if ch == "." else _letter(ch) if len(apart) == 1 else f"(?:{_letter(ch)}|{_letter(apart[0])}{apart[1:]})")
    return z.join(parts)


def _any(words: str, z: str) -> str:
    return "|".join(_word(w, z) for w in sorted(dict.fromkeys(words.split()), key=lambda w: (-len(w), w)))


def rules(z: str) -> tuple[list[tuple], str, str]:
    """Masking rules (what a row must contain, pattern, replacement), the pattern of the ends of units, that of Thai.

    z: pattern of hidden characters allowed within words, empty for texts without any. All patterns begin with
    the terminator itself and look behind, so that other characters are passed over quickly.
    """
    many, gap = (f"[{HIDDEN}]*", f"[{SPACE}{HIDDEN}]") if z else ("", f"[{SPACE}]")
    start = f"{many}(?:(?:[“‘（【(\\[¿¡„「『]|«[{SPACE}]?)*{many}[\\p{{Lu}}\\p{{N}}\\p{{So}}{_CJK}{_THAI}])"
    number = f"[\\p{{N}}{HIDDEN}]++"
    dots = [
        f"(?={many}[\\p{{Ll}}\\p{{N}}])",  # decimals, versions, URLs, names of files
        f"(?={gap}*{start})(?<=(?<![\\p{{L}}\\p{{N}}]{z})(?:{_any(ABBREVIATIONS, z)}|ﬁ{z}g){z}.)",
        f"(?={many}[{SPACE}]?{many}\\p{{L}}{{1,2}}{many}{_DOT})(?<=(?<!\\p{{L}}{z})(?:{'|'.join(map(_letter, 'zdupieт'))}){z}.)",  # the inner point of z. B.
        f"(?={gap}*\\p{{L}})(?<=(?<![\\p{{L}}\\p{{N}}-]{z}|\\p{{N}}[{SPACE}])\\p{{Lu}}{z}.)",  # initials, but not a unit behind a number
        f"(?=[)\\]]?{gap}+\\p{{Lu}}{many}\\p{{Lu}})(?<=(?<!\\p{{L}})(?:{'|'.join(z.join(w) for w in CAPITALS.split())}){z}.)",
        f"(?={gap}+(?:ON|IN|AT|AND)\\b)(?<=M{z}.)",
        f"(?={gap}+(?:{_any(MONTHS, z)}))(?<=\\p{{N}}{z}.)",
        f"(?:(?=[.])|(?<=[.][.]))(?=[.]*[{SPACE}]+(?:AND|UND|ET|Y)\\b)",  # an ellipsis in a text in capitals
    ]
    mask = [
        ("＂", "＂", '"'),
        ("„", f"„({_IN_QUOTES})[“”]", "“$1”"),
        ('"', f'"(?={many}[^{SPACE}])(?<=(?m:^|[{SPACE}{HIDDEN}(\\[（：:—–])")', "“"),
        ('"', '"', "”"),
        (f"(?m:^)[{SPACE}{HIDDEN}]*+\\p{{N}}", f"(?m:^)([{SPACE}{HIDDEN}]*+(?:{number}{_DOT})*?{number}){_DOT}(?={gap})", f"$1{MASKED}"),  # number of a heading
        (f"{_DOT}", f"{_DOT}(?:{'|'.join(dots)})", MASKED),
        (f"[:：]{gap}?[{_OPEN}]", f"((?:[:：]{gap}?{_QUOTED_END}", f"$1{TOLD}"),
        (f"[{_SHUT}]", f"((?:{_QUOTED_END}", f"$1{QUOTED}"),
    ]
    more = f"(?:{many}[{_END}])*"
    quoted = f"{many}[{SPACE}]?[{_SHUT}]{_CLOSE}"
    ends = [
        f"\\r\\n|[{LINE}]",
        f"[。！？]{more}{_CLOSE}",
        f"[.．!?…]{more}{_CLOSE}(?={many}[{SPACE}]{gap}*{start})",
        f"[.．!?](?={many}[{_CJK}])",
        f"{_DOT}(?!{many}{_DOT})(?<=[{_CJK}）”]{z}.){_CLOSE}(?!{many}{MASKED})",
        f"[!?](?<=[{_CJK}]{z}.){more}{_CLOSE}",
        f"[.．!?](?<=[\\p{{Ll}}\\p{{N}})”]{z}.){more}{_CLOSE}(?={many}\\p{{Lu}}{many}[\\p{{Ll}}{SPACE}{MASKED}'’])",
        f"…(?:{many}…)*{_CLOSE}(?={start})(?!{many}(?:{'|'.join(z.join(w) for w in GO_ON.split())}))",
        f"[{QUOTED}{TOLD}]{quoted}(?=[{SPACE}]+{start})(?![{SPACE}]+(?:AND|IS|EST|UND|Y)\\b)",
        f"{TOLD}{quoted}(?={start})(?!{many}(?:{'|'.join(z.join(w) for w in GO_ON_QUOTED.split())}))",
    ]
    blank = "[ \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"
    thai = f"{blank}(?<=[{_THAI}]{z}.){blank}*(?={many}[{_THAI}])"
    return mask, f"(?=[{LINE}{_END}{QUOTED}{TOLD}])(?:{'|'.join(ends)})", thai


PLAIN_RULES, HIDDEN_RULES = rules(""), rules(f"[{HIDDEN}]{{0,{ACROSS}}}")


def _step(only: str, pattern: str, by: str) -> Callable[[Column], Column]:
    def run(t: Column) -> Column:
        needed = t.contains(only) if len(only) == 1 else t.rlike(only)
        return F.when(needed, F.regexp_replace(t, pattern, by)).otherwise(t)

    return run


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def marked(text: Column, ways: tuple | None = None) -> Column:
    """The text with the terminators that end nothing masked and a marker behind every unit; ways: the rules, by the text where None."""

    def by(mask: list[tuple], ends: str, thai: str) -> Callable[[Column], Column]:
        def run(t: Column) -> Column:
            for rule in [*mask, (f"[{_THAI}]", thai, f"$0{CUT}")]:
                t = _let(t, _step(*rule))
            return F.regexp_replace(t, ends, f"$0{CUT}")

        return run

    own = [MASKED, QUOTED, CUT, TOLD]
    taken = text.contains(own[0]) | text.contains(own[1]) | text.contains(own[2]) | text.contains(own[3])
    free = F.when(taken, F.regexp_replace(text, f"[{''.join(own)}]", OTHER)).otherwise(text)
    if ways:
        return by(*ways)(free)
    return _let(free, lambda t: F.when(t.rlike(f"[{HIDDEN}]"), by(*HIDDEN_RULES)(t)).otherwise(by(*PLAIN_RULES)(t)))


#: Numbers summed one after the other; so are the sums of blocks of them.
BLOCK = 128


def _sums(lengths: Column, levels: int = 2) -> Column:
    """Sums for _before(), of an array of any size: within blocks, and of the blocks before."""
    zero = F.array(F.lit(0).cast("bigint"))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    if levels == 1:
        return F.struct(F.aggregate(lengths, zero, add).alias("within"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK)), lambda k: F.aggregate(F.slice(lengths, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)), zero, add))
    return _let(blocks, lambda x: F.struct(x.alias("within"), _let(F.transform(x, lambda b: F.element_at(b, -1)), lambda t: _sums(t, levels - 1)).alias("before")))


def _ends(lengths: Column) -> Column:
    """The sum of the numbers up to each."""
    return _let(_sums(lengths), lambda sums: F.transform(lengths, lambda n, i: _before(sums, i) + n))


def _before(sums: Column, i: Column, levels: int = 2) -> Column:
    """The sum of the numbers before place i."""
    if levels == 1:
        return F.get(sums["within"], i)
    block = F.floor(i / BLOCK).cast("int")
    return F.get(F.get(sums["within"], block), (i % BLOCK).cast("int")) + _before(sums["before"], block, levels - 1)


def _spans(text: Column, ways: tuple) -> Column:
    def unit(at: Column, piece: Column) -> Column:
        start = at + F.length(piece) - F.length(F.ltrim(piece, F.lit(TRIM)))
        return F.struct(start.alias("start_char"), (at + F.length(F.rtrim(piece, F.lit(TRIM)))).alias("end_char"))

    seen = lambda piece: F.ltrim(piece, F.lit(TRIM + UNSEEN)) != ""
    none = F.array().cast(UNITS)

    def step(acc: Column, piece: Column) -> Column:
        units = F.when(seen(piece), F.concat(acc["units"], F.array(unit(acc["at"], piece)))).otherwise(acc["units"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), units.alias("units"))

    def many(pieces: Column) -> Column:
        """Of any number of pieces; an array grows by no more than a block."""
        at = lambda sums: F.transform(pieces, lambda p, i: F.struct(p.alias("p"), _before(sums, i).alias("at")))
        placed = _let(_sums(F.transform(pieces, lambda p: F.length(p).cast("bigint"))), at)
        return F.transform(F.filter(placed, lambda x: seen(x["p"])), lambda x: unit(x["at"], x["p"]))

    def units(pieces: Column) -> Column:
        few = F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("units")), step, lambda acc: acc["units"])
        return F.when(F.size(pieces) <= BLOCK, few).otherwise(many(pieces))

    return _let(F.split(marked(text, ways), CUT, -1), units)


UNITS = "array<struct<start_char:bigint,end_char:bigint>>"


def spans(text: Column) -> Column:
    """array<struct<start_char bigint, end_char bigint>>: the sentence units of a text, in order."""
    surplus = f"(?<=[{HIDDEN}]{{{ACROSS}}})[{HIDDEN}]+"

    def moved(t: Column, units: Column) -> Column:
        """Units of a text of which long runs of hidden characters have been shortened, in the whole text."""
        size = lambda x: F.transform(x, lambda r: F.length(r).cast("bigint"))
        left = F.arrays_zip(_let(size(F.split(t, surplus, -1)), _ends).alias("at"), size(F.regexp_extract_all(t, F.lit(f"({surplus})"), F.lit(1))).alias("n"))
        where = lambda runs, c: c + F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, r: acc + F.when(r["at"] <= c, F.coalesce(r["n"], F.lit(0))).otherwise(0))
        return _let(left, lambda runs: F.transform(units, lambda u: F.struct(where(runs, u["start_char"]).alias("start_char"), where(runs, u["end_char"]).alias("end_char"))))

    def hidden(t: Column) -> Column:
        found = _spans(F.regexp_replace(t, surplus, ""), HIDDEN_RULES)
        return _let(found, lambda units: F.when(t.rlike(f"[{HIDDEN}]{{{ACROSS + 1}}}"), moved(t, units)).otherwise(units))

    return F.coalesce(F.when(text.rlike(f"[{HIDDEN}]"), hidden(text)).otherwise(_spans(text, PLAIN_RULES)), F.array().cast(UNITS))


def sentence_units(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, start_char, end_char): every sentence unit of the text columns, once for each key.

    Rows repeated with the same key count once; the arrays of positions are shuffled for this, never the texts.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), spans(F.col(c)).alias("units")) for c in columns))).alias("f")
    long = df.select(F.col(key), each).select(key, "f.field", "f.units").where(F.size("units") > 0)
    once = long.groupBy(key, "field").agg(F.max("units").alias("units"))
    return once.select(key, "field", F.explode("units").alias("u")).select(key, "field", "u.start_char", "u.end_char")


def with_sentences(df: DataFrame, column: str, out: str = "sentences") -> DataFrame:
    """df with the sentence texts of a column as array<string> in ``out``."""
    return df.withColumn(out, F.transform(spans(F.col(column)), lambda u: F.substring(F.col(column), (u["start_char"] + 1).cast("int"), (u["end_char"] - u["start_char"]).cast("int"))))
