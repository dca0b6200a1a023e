"""Per-document text quality statistics and the verdict prose, list, table or junk (problem 8).

Huge documents are split into chunks of ``CHUNK`` characters, cut at byte offsets of the batch without a copy of
the text. Every chunk yields associative partial counts, made on code point arrays: counts of characters, words
and lines that lie wholly inside, and the open word and line at either end as fragments. ``merge`` joins two
neighbouring partials (it is associative): the last fragment of one and the first of the next become one word or
line, which is then counted or stays open. Partials are merged in a tree: runs of ``FAN`` chunks where they are
counted, then the runs of a document, whose states alone are shuffled; as a value has at most 2 GB, a document has
at most some 2,000 runs. The ratios and rule outcomes are derived from the merged counts.

Words are runs of letters, digits and marks; every ideograph or kana is a word, and Thai counts a word for four
characters, as it is written without spaces.

Edge cases: a null, empty or blank text has zero counts, null ratios and the verdict ``blank``; length is not
limited; repeated rows of a key count once; different lines are counted exactly.
"""

from __future__ import annotations

import unicodedata as ucd
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import charspace as cs

CHUNK, FAN = 16_384, 64
#: Visible characters of the next chunk looked at for numbers of items; for common words as many as the longest has.
AHEAD = 15
SPACE, BREAK, LETTER, CJK, THAI, DIGIT, SIGN, HIDDEN, BROKEN = range(9)
#: Marks that end a sentence or a line of prose, closing marks behind them, and marks of list items.
TERMINATORS, CLOSING, BULLETS = ".!?。！？…", "\"'”’»」』)）]】", "•▪◦‣·●○■□◆◇►▶→*-–—+☐☑☒✓✔⁃∙"
#: Additive counts. CHARS are per character, LINES per line.
CHARS = ["chars", "visible", "letters", "digits", "signs", "broken", "cjk", "thai", "ends", "tags", "words", "word_chars", "common", "long_words", "hex_words", "mixed_words", "latin_words", "mute_words"]
LINES = ["lines", "marked", "short", "pipe", "comma", "semicolon", "tab", "gap", "ended", "spoken"]
#: Of an open line: its counts and the hash of its content. Of an open word: its length, hash and kinds of characters.
LINE = ["visible", "words", "thai", "pipes", "commas", "semicolons", "tabs", "gaps", "ends", "marked", "ended", "solid", "lead", "trail", "first_run", "last_run", "hash", "length"]
WORD = ["length", "hash", "upper", "lower", "digits", "hex", "latin", "vowels"]
BITS = 1024
#: Sums over windows of CHUNK characters, so that the length of a document does not matter: different words, and the number up to which they are repetition.
VARIETY = ["varied", "least"]
_B = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kind = np.full(0x110000, SIGN, np.uint8)
    for cp in range(0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x323AF:
            kind[cp] = CJK
            continue
        if cp > 0x1FFFF:
            continue
        c = ucd.category(chr(cp))
        kind[cp] = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE}.get(c[0], SIGN)
        if c in ("Cf", "Cn", "Cs", "Co", "Cc"):
            kind[cp] = {"Cf": HIDDEN}.get(c, BROKEN)
        if c == "No":
            kind[cp] = SIGN
    for lo, hi, k in ((0x2E80, 0x2FDF, CJK), (0x3040, 0x30FF, CJK), (0xF900, 0xFAFF, CJK), (0xFF66, 0xFF9F, CJK), (0xE01, 0xE5B, THAI)):
        kind[lo : hi + 1] = k
    kind[[9, 0x1F]] = SPACE
    kind[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = BREAK
    kind[[0x3005, 0x30FC]] = CJK
    kind[[0xFFFD]] = BROKEN
    kind[0xFE00:0xFE10] = HIDDEN
    return kind


@lru_cache(maxsize=1)
def _chars() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(8)
    small = lambda s: np.isin(np.arange(0x10000), [ord(c) for c in s])
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x2000):
        low = chr(cp).lower()
        if len(low) == 1:
            lower[cp] = ord(low)
    return {"random": rng.integers(1, 2**63, 0x10000, dtype=np.uint64), "lower": lower, "end": small(TERMINATORS), "close": small(CLOSING), "bullet": small(BULLETS), "latin": small("abcdefghijklmnopqrstuvwxyz"), "vowel": small("aeiouy")}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_B), -1, 2**64))
    up, down = np.full(n + 1, _B), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hash_of(text: str) -> int:
    """The polynomial hash of a lower-case text, as the vectorised code makes it."""
    h, p = 0, 1
    for ch in text:
        h, p = (h + int(_chars()["random"][ord(ch) & 0xFFFF]) * p) % 2**64, p * int(_B) % 2**64
    return h


def join_hash(a: int, length: int, b: int) -> int:
    return (a + pow(int(_B), length, 2**64) * b) % 2**64


def _line_flags(L: dict[str, np.ndarray]) -> np.ndarray:
    """Which of LINES hold, for lines given by arrays of LINE; a blank line counts for nothing."""
    real = L["visible"] > 0
    L = L | {"words": L["words"] + L["thai"] // 4, "ends": np.maximum(L["ends"] - (L["marked"] > 0), 0)}
    prose = (L["ends"] > 0) & (L["words"] > 6)
    tables = {c: (L[k] >= 2) & ~prose for c, k in (("pipe", "pipes"), ("comma", "commas"), ("semicolon", "semicolons"), ("tab", "tabs"), ("gap", "gaps"))}
    short = (L["words"] <= 14) & (L["visible"] <= 60) & (L["ended"] == 0) & (L["ends"] == 0)
    return np.stack([real, real & (L["marked"] > 0), real & short, *(real & tables[c] for c in ("pipe", "comma", "semicolon", "tab", "gap")), real & (L["ended"] > 0), real & (L["ends"] > 0)], 1).astype(np.int64)


def partials(cps: np.ndarray, off: np.ndarray, open_left: np.ndarray, open_right: np.ndarray, common: frozenset[str], after: dict[int, str]) -> dict[str, np.ndarray]:
    """Partial counts of each chunk; open_left/right: whether a word or line may go on there; after: the visible characters behind a chunk."""
    t, n = _chars(), len(off) - 1
    kind, chars = _kinds()[cps], np.diff(off)
    seen = kind != HIDDEN  # hidden characters count as characters only
    if not seen.all():
        off = np.r_[0, np.cumsum(seen)][off]
        cps, kind = cps[seen], kind[seen]
    low = np.minimum(t["lower"][cps], 0xFFFF)
    at = np.flatnonzero(np.diff(off) > 0)
    heads, tails = off[:-1], off[1:]
    count = lambda flags: cs.sums(flags, heads, tails)
    visible = (kind != SPACE) & (kind != BREAK)
    end = t["end"][low]
    nxt = np.r_[kind[1:], BREAK] if len(kind) else kind
    nxt_low = np.r_[low[1:], 0] if len(low) else low
    lasts = off[1:][at] - 1
    nxt[lasts], nxt_low[lasts] = BREAK, 0
    for k, text in after.items():
        if text and off[k + 1] > off[k]:
            nxt[off[k + 1] - 1], nxt_low[off[k + 1] - 1] = _kinds()[ord(text[0])], min(ord(text[0]), 0xFFFF)
    inner_end = end & ((low >= 0x2000) | (nxt == SPACE) | (nxt == BREAK) | t["close"][nxt_low])
    letterish = (kind == LETTER) | (kind == CJK) | (kind == THAI)
    out = {c: np.zeros(n, np.int64) for c in CHARS}
    out |= {"chars": chars, "visible": count(visible), "letters": count(letterish), "digits": count(kind == DIGIT), "signs": count(kind == SIGN), "cjk": count(kind == CJK), "thai": count(kind == THAI)}
    out["broken"] = count((kind == BROKEN) | ((cps >= 0x80) & (cps <= 0xFF) & ~np.isin(cps, _LATIN1)))
    out["ends"], out["tags"] = count(inner_end), count((low == 60) | (low == 62) | ((low == 38) & np.isin(nxt_low, [35, 110])))
    row = cs.row_of(off)
    up, down = _powers(len(cps))
    prefix = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(t["random"][low] * up[:-1], out=prefix[1:], dtype=np.uint64)
    value = lambda s, e: (prefix[e] - prefix[s]) * down[s]

    # words: runs of letters and digits, and single ideographs
    runs = (kind == LETTER) | (kind == DIGIT)
    edge = np.zeros(len(cps) + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(runs & (edge[:-1] | np.r_[True, ~runs[:-1]])) if len(cps) else np.zeros(0, np.int64)
    stop = np.flatnonzero(runs & (edge[1:] | np.r_[~runs[1:], True])) + 1 if len(cps) else begin
    length = stop - begin
    wrow = row[begin] if len(begin) else begin
    isupper, islower = (cps != t["lower"][cps]), (kind == LETTER) & (cps == t["lower"][cps])
    W = {"length": length, "hash": value(begin, stop), "upper": cs.sums(isupper, begin, stop), "lower": cs.sums(islower, begin, stop), "digits": cs.sums(kind == DIGIT, begin, stop), "hex": cs.sums((kind == DIGIT) | ((low >= 97) & (low <= 102)), begin, stop)}
    W |= {"latin": cs.sums(t["latin"][low], begin, stop), "vowels": cs.sums(t["vowel"][low], begin, stop)}
    latin = (length >= 3) & (W["latin"] == length)
    left, right = open_left[wrow] & (begin == heads[wrow]), open_right[wrow] & (stop == tails[wrow])
    closed = ~left & ~right
    listed = np.fromiter((hash_of(w) for w in sorted(common)), np.uint64, len(common))
    add = lambda name, rows, weights=None: out.__setitem__(name, out[name] + np.bincount(rows, weights, n).astype(np.int64))
    for name, hit in (("words", closed), ("common", closed & np.isin(W["hash"], listed)), ("long_words", closed & (length >= 20)), ("hex_words", closed & (length == 2) & (W["hex"] == 2)), ("mixed_words", closed & (length >= 12) & (W["upper"] > 1) & (W["lower"] > 1)), ("latin_words", closed & latin), ("mute_words", closed & latin & (W["vowels"] == 0))):
        add(name, wrow[hit])
    add("word_chars", wrow[closed], length[closed])
    single = np.flatnonzero(kind == CJK)
    add("words", row[single]), add("word_chars", row[single])
    # common words of scripts written without spaces: every place where one begins
    block = (kind == CJK) | (kind == THAI)
    if block.any():
        for size in sorted({len(w) for w in common}):
            words = np.array([hash_of(w) for w in sorted(common) if len(w) == size and not w[0].isascii() and _kinds()[ord(w[0])] in (CJK, THAI)], np.uint64)
            s = np.flatnonzero(block[: max(len(cps) - size + 1, 0)])
            s = s[row[s + size - 1] == row[s]] if len(s) else s
            if len(words) and len(s):
                add("common", row[s[np.isin(value(s, s + size), words)]])
    bits = np.zeros((n, BITS), bool)
    pick = lambda h: ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(54)).astype(np.int64)
    bits[wrow[closed], pick(W["hash"][closed])] = True
    bits[row[single], pick(value(single, single + 1))] = True
    pairs = np.flatnonzero((kind[:-1] == THAI) & (kind[1:] == THAI) & ~edge[1:-1]) if len(cps) > 1 else single[:0]
    bits[row[pairs], pick(value(pairs, pairs + 2))] = True
    for k, text in after.items():
        last = off[k + 1] - 1
        if text and off[k + 1] > off[k] and kind[last] == THAI and _kinds()[ord(text[0])] == THAI:
            bits[k, int(pick(np.array([hash_of(chr(cps[last]) + text[0])], np.uint64))[0])] = True

    # lines
    breaks = kind == BREAK
    cut = np.flatnonzero(breaks)
    lb = np.sort(np.r_[heads[at], cut + 1]) if len(cps) else cut
    lb = lb[lb < len(cps)] if len(lb) else lb
    lb = np.unique(lb)
    le = np.r_[lb[1:], len(cps)] if len(lb) else lb
    lrow = row[lb] if len(lb) else lb
    body = le - cs.sums(breaks, lb, le)
    runs2 = np.zeros(len(cps), bool)
    runs2[begin] = True
    first_seen = _next_at(visible, lb, body)
    last_seen = _last_at(visible & ~t["close"][low], lb, body)
    gap = np.zeros(len(cps), bool)
    if len(cps) > 2:
        blank = kind == SPACE
        gap[2:] = visible[2:] & blank[1:-1] & blank[:-2]
    f = np.minimum(first_seen, max(len(cps) - 1, 0))
    marked = (first_seen < body) & (t["bullet"][low[f]] | _numbered(low, kind, f, body)) if len(lb) else np.zeros(0, bool)
    ended = (last_seen >= lb) & end[np.maximum(last_seen, 0)] if len(lb) else marked
    gaps = cs.sums(gap, lb, body) - gap[f] * (first_seen < body) if len(lb) else np.zeros(0, np.int64)
    space = kind == SPACE
    zero = np.zeros(len(lb), np.int64)
    last_visible = _last_at(visible, lb, body) + 1 if len(lb) else zero
    L = {
        "visible": cs.sums(visible, lb, body), "words": cs.sums(runs2 | (kind == CJK), lb, body), "thai": cs.sums(kind == THAI, lb, body), "pipes": cs.sums(low == 124, lb, body),
        "commas": cs.sums(low == 44, lb, body), "semicolons": cs.sums(low == 59, lb, body), "tabs": cs.sums(low == 9, lb, body), "gaps": gaps, "ends": cs.sums(inner_end, lb, body),
        "marked": marked.astype(np.int64), "ended": ended.astype(np.int64), "solid": cs.sums(visible & ~t["close"][low], lb, body),
        "lead": cs.sums(space, lb, first_seen) if len(lb) else zero, "trail": cs.sums(space, np.maximum(last_visible, lb), body) if len(lb) else zero,
        "first_run": runs[lb].astype(np.int64) if len(lb) else zero, "last_run": (runs[np.maximum(body - 1, 0)] & (body > lb)).astype(np.int64) if len(lb) else zero,
        "hash": value(lb, body), "length": body - lb,
    }
    lleft, lright = open_left[lrow] & (lb == heads[lrow]), open_right[lrow] & (le == tails[lrow]) & (body == le)
    for k in np.flatnonzero(lright & (first_seen < body)):  # the number of an item may go on in the next chunk
        start = np.r_[low[f[k] : f[k] + 8][: body[k] - f[k]], [min(ord(c), 0xFFFF) for c in after.get(int(lrow[k]), "").split("\n")[0].lower()]].astype(np.int64)
        one = np.array([0])
        L["marked"][k] = bool(t["bullet"][start[0]] | _numbered(start, _kinds()[start], one, np.array([len(start)]))[0])
    lclosed = ~lleft & ~lright
    flags = _line_flags(L)
    for k, name in enumerate(LINES):
        out[name] = np.bincount(lrow[lclosed], flags[lclosed, k], n).astype(np.int64)
    solid = lclosed & (L["visible"] > 0)
    hashes, srow = L["hash"][solid].astype(np.uint64).view(np.int64), lrow[solid]
    order = np.lexsort((hashes, srow))
    hashes, srow = hashes[order], srow[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (srow[1:] != srow[:-1])][: len(hashes)]

    def fragment(D: dict, cols: list[str], rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
        res = np.zeros((n, len(cols)), np.int64)
        for k, c in enumerate(cols):
            res[rows[hit], k] = D[c][hit].astype(np.uint64).view(np.int64) if c == "hash" else D[c][hit]
        return res

    out |= {"bits": bits, "seen_lines": hashes[new], "distinct_lines": np.bincount(srow[new], minlength=n), "has_break": np.bincount(row[cut], minlength=n) > 0, "all_word": (np.bincount(wrow[left & right], minlength=n) > 0) | (np.diff(off) == 0)}
    out |= {"head_line": fragment(L, LINE, lrow, lleft), "tail_line": fragment(L, LINE, lrow, lright & ~lleft), "head_word": fragment(W, WORD, wrow, left), "tail_word": fragment(W, WORD, wrow, right & ~left)}
    return out


#: Latin-1 characters common in proper text of the eight languages.
_LATIN1 = np.array([ord(c) for c in "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜßàáâäçèéêëìíîïñòóôöøùúûü\xa0\xad«»¡¿·°±²³¹×§"], np.uint32)


def _next_at(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first flagged place from s on, e where there is none before."""
    where = np.flatnonzero(flags)
    k = np.searchsorted(where, s)
    return np.minimum(np.r_[where, len(flags)][k], e)


def _last_at(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The last flagged place before e, -1 where there is none from s on."""
    where = np.flatnonzero(flags)
    k = np.searchsorted(where, e) - 1
    got = np.r_[where, -1][k]
    return np.where((k >= 0) & (got >= s), got, -1)


def _numbered(low: np.ndarray, kind: np.ndarray, f: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether a line begins like 1. or 1) or (1) or a) or [ ]."""
    n = len(low)
    get = lambda k: low[np.minimum(k, n - 1)] * (k < stop)
    is_digit = lambda k: (kind[np.minimum(k, n - 1)] == DIGIT) & (k < stop)
    a = f + np.isin(get(f), [40, 91, 0xFF08])
    box = np.isin(get(f), [91]) & np.isin(get(f + 2), [93])
    one, two, three = is_digit(a), is_digit(a) & is_digit(a + 1), is_digit(a) & is_digit(a + 1) & is_digit(a + 2)
    width = one.astype(np.int64) + two + three
    letter = ~one & (get(a) >= 97) & (get(a) <= 122)
    close = get(a + np.where(one, width, 1))
    after = get(a + np.where(one, width, 1) + 1)
    return box | ((one | letter) & np.isin(close, [41, 93, 0xFF09])) | (one & np.isin(close, [46, 0x3001]) & (after == 32))


#: What a run of chunks hands on: counts, bits, hashes of the lines closed in it, and its open ends.
STATE = ", ".join([*(f"{c}: bigint" for c in [*CHARS, *LINES]), "bits: binary", "seen_lines: array<bigint>", "has_break: boolean", "all_word: boolean", *(f"{c}: array<bigint>" for c in ("head_line", "tail_line", "head_word", "tail_word")), *(f"{c}: double" for c in VARIETY)])


def _state(p: dict[str, np.ndarray], k: int, lines: np.ndarray) -> dict:
    """The partial of one chunk of a batch as a state of merge(); the bits are one number, the lines a list of arrays."""
    s = {c: int(p[c][k]) for c in [*CHARS, *LINES]}
    s |= {"bits": int.from_bytes(np.packbits(p["bits"][k]).tobytes(), "big"), "seen_lines": [lines], **dict.fromkeys(VARIETY, 0.0), "has_break": bool(p["has_break"][k]), "all_word": bool(p["all_word"][k])}
    return s | {c: p[c][k].tolist() for c in ("head_line", "tail_line", "head_word", "tail_word")}


def _fold(parts: list[dict], common: set[int]) -> dict:
    """The partials of neighbours in order, merged by halves."""
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1], common) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _line_of(v: list[int]) -> dict[str, np.ndarray]:
    return {c: np.array([x]) for c, x in zip(LINE, v, strict=True)}


def _add_lines(a: list[int], b: list[int]) -> list[int]:
    x, y = dict(zip(LINE, a, strict=True)), dict(zip(LINE, b, strict=True))
    sums = {c: x[c] + y[c] for c in LINE}
    sums["words"] -= x["last_run"] and y["first_run"]
    sums["gaps"] += x["visible"] > 0 and y["visible"] > 0 and x["trail"] + y["lead"] >= 2
    sums["marked"] = x["marked"] if x["visible"] else y["marked"]
    sums["ended"] = y["ended"] if y["solid"] else x["ended"]
    sums["lead"], sums["trail"] = x["lead"] if x["visible"] else sums["lead"], y["trail"] if y["visible"] else sums["trail"]
    sums["first_run"], sums["last_run"] = x["first_run"] if x["length"] else y["first_run"], y["last_run"] if y["length"] else x["last_run"]
    out = [sums[c] for c in LINE]
    h = LINE.index("hash")
    out[h] = _signed(join_hash(a[h] % 2**64, a[LINE.index("length")], b[h] % 2**64))
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _bit(value: int) -> int:
    """The bit of a word's hash, as partials() sets it."""
    return 1 << (BITS - 1 - (((value % 2**64) * 0xD6E8FEB86659FD93 % 2**64) >> 54))


def _close_line(s: dict, v: list[int]) -> None:
    if v[0] > 0:
        for name, x in zip(LINES, _line_flags(_line_of(v))[0], strict=True):
            s[name] += int(x)
        s["seen_lines"] = [*s["seen_lines"], np.array([v[LINE.index("hash")]], np.int64)]


def _close_word(s: dict, v: list[int], common: set[int]) -> None:
    length, value, upper, lower, _, hexa, latin, vowels = v
    if length:
        s["words"] += 1
        s["word_chars"] += length
        s["common"] += value % 2**64 in common
        s["long_words"] += length >= 20
        s["hex_words"] += length == 2 and hexa == 2
        s["mixed_words"] += length >= 12 and upper > 1 and lower > 1
        s["latin_words"] += length >= 3 and latin == length
        s["mute_words"] += length >= 3 and latin == length and not vowels
        s["bits"] |= _bit(value)


def merge(a: dict, b: dict, common: set[int]) -> dict:
    """The partial of two neighbouring chunks (a before b)."""
    s = {c: a[c] + b[c] for c in [*CHARS, *LINES]}
    s["bits"] = a["bits"] | b["bits"]
    s |= {c: a[c] + b[c] for c in ("seen_lines", *VARIETY)}
    s |= {"has_break": a["has_break"] or b["has_break"], "all_word": a["all_word"] and b["all_word"]}
    word = lambda x, y: [x[0] + y[0], _signed(join_hash(x[1] % 2**64, x[0], y[1] % 2**64)), *(p + q for p, q in zip(x[2:], y[2:], strict=True))]
    s["head_line"], s["tail_line"], s["head_word"], s["tail_word"] = a["head_line"], b["tail_line"], a["head_word"], b["tail_word"]
    if not a["has_break"]:
        s["head_line"] = _add_lines(a["head_line"], b["head_line"])
    elif not b["has_break"]:
        s["tail_line"] = _add_lines(a["tail_line"], b["head_line"])
    else:
        _close_line(s, _add_lines(a["tail_line"], b["head_line"]))
    if a["all_word"]:
        s["head_word"] = word(a["head_word"], b["head_word"])
    elif b["all_word"]:
        s["tail_word"] = word(a["tail_word"], b["head_word"])
    else:
        _close_word(s, word(a["tail_word"], b["head_word"]), common)
    return s


def closed(s: dict, common: set[int]) -> dict:
    """A whole document's counts: its open ends are closed."""
    s = dict(s)
    for c in ("head_line", "tail_line"):
        _close_line(s, s[c])
    for c in ("head_word", "tail_word"):
        _close_word(s, s[c], common)
    return s


def _variety(bits: np.ndarray, words: np.ndarray, thai: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """VARIETY of windows of at most CHUNK characters: their different words, told by the bits set, and how many the same words over and over would have."""
    return -BITS * np.log1p(-np.minimum(bits, BITS - 1) / BITS), 2.0 * np.sqrt(np.maximum(words + np.floor(thai / 4), 1))


#: Counts a verdict is made of.
_JUDGED = [*CHARS, *LINES, *VARIETY, "distinct_lines"]
STATS = "words bigint, mean_word_length double, symbol_ratio double, end_share double, common_share double, lines bigint, kind string"


def verdict(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ratios and verdicts from arrays of merged counts (with VARIETY and the exact number of different lines: distinct_lines)."""
    f = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words = f["words"] + np.floor(f["thai"] / 4)
    vis, lines, w = np.maximum(f["visible"], 1), np.maximum(f["lines"], 1), np.maximum(words, 1)
    cells = np.maximum.reduce([f[c] for c in ("pipe", "comma", "semicolon", "tab", "gap")])
    table = (cells >= 0.6 * lines) & (f["lines"] >= 2)
    items = np.where(f["thai"] > 0.5 * f["letters"], (f["visible"] <= 25 * lines) | (f["marked"] >= 0.6 * lines), f["spoken"] <= 0.2 * lines)
    listing = (f["short"] >= 0.6 * lines) & items & (f["lines"] >= 3) & ~table
    signs = f["signs"] / vis
    junk = (
        (f["tags"] >= 0.04 * vis)
        | (f["broken"] >= 0.15 * vis)
        | ((signs >= 0.35) & ~table & ~(f["marked"] >= 0.6 * lines))
        | ((f["letters"] + f["digits"] < 0.45 * vis) & ~table & ~listing)
        | (f["mixed_words"] >= 0.2 * w)
        | ((f["hex_words"] >= 0.7 * w) & (words >= 8))
        | ((f["mute_words"] >= 0.6 * f["latin_words"]) & (f["latin_words"] >= np.maximum(5, 0.2 * w)))  # words nobody can say
        | ((words >= 40) & (f["varied"] <= f["least"]) & ~table)
        | ((f["lines"] >= 6) & (f["distinct_lines"] <= 0.2 * lines))
    )
    kind = np.where(f["visible"] == 0, "blank", np.where(junk, "junk", np.where(table, "table", np.where(listing, "list", "prose"))))
    null = lambda x, ok: np.where(ok, x, np.nan)
    word_chars = f["word_chars"] + f["thai"]
    return {"words": words.astype(np.int64), "mean_word_length": null(word_chars / w, words > 0), "symbol_ratio": null(signs, f["visible"] > 0), "end_share": null(f["ended"] / lines, f["lines"] > 0), "common_share": null(f["common"] / w, words > 0), "lines": f["lines"].astype(np.int64), "kind": kind}


def _cut(texts: pa.Array, chunk: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of at most ``chunk`` characters as views of the texts' bytes, with the row, the number and the count of chunks of each."""
    off = cs.byte_offsets(texts)
    data = texts.buffers()[2]
    cuts = [off]
    for r in np.flatnonzero(np.diff(off) > chunk):  # bytes are at least as many as characters
        at, seen = int(off[r]), 0
        while at < off[r + 1]:  # in blocks, so that nothing as large as the text is made
            end = min(int(off[r + 1]), at + (1 << 20))
            heads = np.flatnonzero((np.frombuffer(data.slice(at, end - at), np.uint8) & 0xC0) != 0x80)
            first = -seen % chunk
            own = heads[first::chunk] + at
            cuts.append(own[own > off[r]])
            seen, at = seen + len(heads), end
    ends = np.sort(np.concatenate(cuts), kind="stable") if len(cuts) > 1 else off
    row = np.searchsorted(off, ends[:-1], "right") - 1
    if len(cuts) == 1:
        row = np.arange(len(texts))  # empty texts share their offset
    else:  # an empty text has one chunk too: offsets come as often as rows begin there
        repeats = np.arange(len(ends) - 1) - np.searchsorted(ends, ends[:-1], "left")
        lowest = np.searchsorted(off, ends[:-1], "left")
        row = np.where(off[np.minimum(lowest, len(off) - 1)] == ends[:-1], lowest + repeats, row)
    first = np.searchsorted(row, np.arange(len(texts)), "left")
    number = np.arange(len(row)) - first[row]
    pieces = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), data)
    return pieces, row, number, np.bincount(row, minlength=len(texts))[row]


def _visible_after(pieces: pa.Array, k: int, most: int) -> str:
    """The next ``most`` visible characters behind a chunk of a text cut up, fewer at its end."""
    out = ""
    while len(out) < most and (k := k + 1) < len(pieces):
        text = pieces[k].as_py()
        width = most
        while len(own := _unhidden(text[:width])) + len(out) < most and width < len(text):
            width *= 4
        out += own
    return out[:most]


def statistics(df: DataFrame, key: str, text: str, common_words: frozenset[str], chunk: int = CHUNK) -> DataFrame:
    """(key, words, mean_word_length, symbol_ratio, end_share, common_share, lines, kind) of each document.

    common_words: a fixed list of frequent words in lower case (its size is the caller's bound, here 181).
    """
    kind = dict(df.dtypes)[key]
    common = frozenset(w for w in common_words if w)
    hashes = frozenset(hash_of(w) for w in common)
    window = max(1, CHUNK // chunk)
    size = window * -(-FAN // window)  # chunks of a run, which has whole windows
    ahead = max([AHEAD, *map(len, common)])
    stats = [x.split(" ")[0] for x in STATS.split(", ")]
    state_type = _arrow_state()

    def flat(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, dict[str, np.ndarray]]]:
        """Rows, run states (null for documents of one run) and results (for those) of a batch, in pieces of about 512 KB."""
        pieces, row, number, count = _cut(texts, chunk)
        last = number == count - 1
        held: list[dict] = []
        for i, j in cs.slices(pieces, 1 << 19):
            cps, off = cs.codepoints(pieces.slice(i, j - i))
            inner = np.flatnonzero(~last[i:j])
            after = {int(k): _visible_after(pieces.slice(i + k, count[i + k] - number[i + k]), 0, ahead) for k in inner}
            cut = count[i:j] > 1  # the ends of a document cut up are open, until its partials are merged
            p = partials(cps, off, cut, cut, common, after)
            for k, text_ in after.items():
                p["common"][k] += _across(cps[off[k] : off[k + 1]], text_, common, ahead)
            p["varied"], p["least"] = _variety(p["bits"].sum(1), p["words"], p["thai"])
            whole = np.flatnonzero(~cut)
            done = verdict({c: v[whole] for c, v in p.items() if c in _JUDGED})
            rows, numbers, runs = [row[i:j][whole]], [np.zeros(len(whole), np.int64)], [np.ones(len(whole), np.int64)]
            states: list[dict | None] = [None] * len(whole)
            results = [done]
            seen = np.r_[0, np.cumsum(p["distinct_lines"])]
            for k in np.flatnonzero(cut):
                held.append(_state(p, k, p["seen_lines"][seen[k] : seen[k + 1]]))
                at, n = int(number[i + k]), int(count[i + k])
                if (at + 1) % size and at + 1 < n:
                    continue
                run = _run_state(held, window, set(hashes), n <= window)
                held = []
                rows.append(row[i + k : i + k + 1]), numbers.append(np.array([at // size])), runs.append(np.array([-(-n // size)]))
                if n <= size:
                    state = _whole(run, set(hashes), n <= window)
                    results.append(verdict({c: np.array([state[c]]) for c in _JUDGED}))
                    states.append(None)
                else:
                    states.append({**run, "bits": run["bits"].to_bytes(BITS // 8, "big"), "seen_lines": np.unique(np.concatenate(run["seen_lines"]))})
                    results.append(dict.fromkeys(stats, np.array([None])))
            merged = [pa.array(np.concatenate([r[c] if r[c].dtype != object else np.array([np.nan]) for r in results]) if c != "kind" else np.concatenate([r[c].astype(object) for r in results]), from_pandas=True) for c in stats]
            yield np.concatenate(rows), [pa.array(np.concatenate(numbers).astype(np.int32)), pa.array(np.concatenate(runs).astype(np.int32)), pa.array(states, state_type)], merged

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if x.endswith("bigint") else pa.string() if x.endswith("string") else pa.float64() for x in STATS.split(", ")]
        for b in batches:
            for rows, ints, merged in flat(cs.flat(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *ints, *(x.cast(t) for x, t in zip(merged, kinds, strict=True))], ["_key", "_run", "_runs", "_state", *stats])

    made = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(count_, f"_key {kind}, _run int, _runs int, _state struct<{STATE}>, {STATS}")
    return _finish(made, kind, hashes, stats).withColumnRenamed("_key", key)


def _arrow_state() -> pa.DataType:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.struct([(name, kinds[t]) for name, t in (x.split(": ") for x in STATE.split(", "))])


def _varied(state: dict) -> dict:
    """VARIETY of a state of one window."""
    return dict(zip(VARIETY, (float(x) for x in _variety(np.float64(state["bits"].bit_count()), state["words"], state["thai"])), strict=True))


def _run_state(parts: list[dict], window: int, common: set[int], whole: bool) -> dict:
    """A run of chunks merged; VARIETY is summed over its windows, but for a document within one window, which is still open."""
    windows = [_fold(parts[i : i + window], common) for i in range(0, len(parts), window)]
    return _fold(windows if whole else [{**w, **_varied(w)} for w in windows], common)


def _whole(state: dict, common: set[int], one_window: bool) -> dict:
    """A document's counts, closed, with VARIETY and the number of different lines."""
    state = closed(state, common)
    if one_window:
        state |= _varied(state)
    return state | {"distinct_lines": len(np.unique(np.concatenate(state["seen_lines"])))}


def _unhidden(text: str) -> str:
    return "".join(c for c in text if _kinds()[ord(c)] != HIDDEN)


def _across(own: np.ndarray, after: str, common: frozenset[str], most: int) -> int:
    """Common words of scripts without spaces that lie across the end of a chunk."""
    width = 4 * most
    while len(tail := _unhidden("".join(map(chr, own[-width:])))) < most and width < len(own):
        width *= 4
    tail = tail[-most:].lower()
    both, n = tail + after.lower(), len(tail)
    spaced = lambda w: w[0].isascii() or _kinds()[ord(w[0])] not in (CJK, THAI)
    return sum(both.startswith(w, i) for w in common if len(w) > 1 and not spaced(w) for i in range(max(0, n - len(w) + 1), n))


def _finish(made: DataFrame, kind: str, common: frozenset[int], stats: list[str]) -> DataFrame:
    """Results of documents of one run, each key once, and of the others from the states of their runs."""
    import pandas as pd

    rest = ["_runs", "_state", *stats]
    once = made.groupBy("_key", "_run").agg(F.first(F.struct(*rest)).alias("_row")).select("_key", "_run", *(F.col(f"_row.{c}").alias(c) for c in rest))
    small = once.where("_runs = 1").select("_key", *stats)
    long = once.where("_runs > 1").select("_key", "_run", "_state.*")
    lists = ("head_line", "tail_line", "head_word", "tail_word")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [{**r, "bits": int.from_bytes(r["bits"], "big"), "seen_lines": [], **{c: [int(x) for x in r[c]] for c in lists}} for r in pdf.sort_values("_run").to_dict("records")]
        state = closed(_fold(parts, set(common)), set(common))
        return pd.DataFrame([{"_key": pdf["_key"].iloc[0], "seen_lines": [int(x[0]) for x in state["seen_lines"]], **{c: state[c] for c in [*CHARS, *LINES, *VARIETY]}}])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = verdict({c: pdf[c].to_numpy() for c in _JUDGED})
            yield pd.DataFrame({"_key": pdf["_key"], **{c: done[c] for c in stats}})

    counts_of = ", ".join([*(f"{c} bigint" for c in [*CHARS, *LINES]), *(f"{c} double" for c in VARIETY)])
    ends = long.groupBy("_key").applyInPandas(last, f"_key {kind}, seen_lines array<bigint>, {counts_of}")
    # different lines, exactly: those within runs, and those put together from several
    lines = [x.select("_key", F.explode("seen_lines").alias("_line")) for x in (long, ends)]
    counts = lines[0].unionByName(lines[1]).distinct().groupBy(F.col("_key").alias("_same")).agg(F.count("*").alias("distinct_lines"))
    full = ends.join(counts, F.col("_key").eqNullSafe(F.col("_same")), "left").select("_key", *CHARS, *LINES, *VARIETY, F.coalesce("distinct_lines", F.lit(0)).alias("distinct_lines"))
    return small.unionByName(full.mapInPandas(judge, f"_key {kind}, {STATS}"))
