"""Broken prompt and response pairs (problem 4).

One pass over the pairs, on whole batches, makes what the checks need: languages of both sides by sentence
units, sizes, how the response ends, whether it repeats its prompt, and the opening clauses of both sides.

Refusals are found by their templates: the opening clauses of responses are clustered by MinHash bands over
character trigrams, each member verified against the cluster's most frequent clause (Jaccard 0.8), and a
cluster is a template of refusals if it recurs across unrelated prompts: within each prompt language, sound
openings come from one prompt opening again and again, refusals from ever different ones. Copies are verified
by the trigrams of both sides, wrong languages by the majority of sentences, truncations by the size against
the usual ratio of the language (its median over all pairs) and by an end that is none.

Edge cases: pairs with a null side are no cases; rows repeated with the same key count once; prompts of codes
and numbers alone may be repeated; the first defect that fits, in the order of ``DEFECTS``, is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import session
from foliant.llm import charspace as cs
from foliant.llm import langid, unify

DEFECTS = ["empty", "refusal", "copy", "wrong_language", "truncated"]
#: Stand-ins for a missing text, in lower case, without brackets and punctuation around them.
STAND_INS = set(
    "tbd todo n/a na n.a null none nil empty blank missing untranslated notranslation no\xa0translation fixme xxx placeholder pending nan undefined "
    "未翻译 待译 空 空白 无 缺 缺失 待翻译 暂无 暂缺 无译文 未译 翻译中 未訳 なし 翻訳なし".split(" ")
) | {"no translation", "not translated", "to be translated", "not available", "translation missing", "to do", "to be done"}
#: Trigram hashes and bands of a clause's signature, and the similarity that verifies.
HASHES, BANDS, SIMILAR = 8, 4, 0.8
#: A template has at least this many repeats with a new prompt opening, and this share of those that random pairs have.
REPEATS, UNRELATED = 2, 0.6
#: Similarity of two prompt openings from which they are variants of one.
RELATED = 0.2
#: Relative size and share of units up to which a response lacks the latter half, the size up to which it does in any case, and that of a last sentence broken off.
SHORT, HALF, LEAST, LAST = 0.7, 0.65, 0.4, 0.8
#: Confidence, log-odds and letters with which a unit counts as being in another language written alike.
SURE, MARGIN, LETTERS = 0.85, 15.0, 20
#: Letters of a response for a letter of the prompt, as usual between these languages (used for last sentences only).
LETTERS_FOR_ONE = {"zh": 3.5, "en": 0.29, "de": 0.27, "fr": 0.27, "es": 0.27, "ru": 0.3, "ja": 0.75, "th": 0.29}
#: Letters from which the last unit of a prompt that has no terminator is a sentence, no heading or code, and the size of a last sentence broken off where the prompt's may lack its full stop too.
SENTENCE, LAST_OPEN = {"th": 20, "zh": 12, "ja": 20}, 0.65
_EDGE = " \t\n\r\"'“”‘’()（）[]【】<>《》「」『』*_.。…-—–~!！?？:：;；,，、/\\|#=+"
_CLAUSE = re.compile(r"(?<=\w{5})[.]\s|[，,。;；：:!！?？…\n“”\"()（）]+|[.]$")
_MARK = re.compile(r"[，,。;；：:!！?？…]|[.](?:\s|$)")
_UNIT = re.compile(r"[。！？!?；;…\n]+|[.](?=\s)")
_CODE = re.compile(r"\S*\d\S*")
_NAME = re.compile(r"[A-ZÀ-Þ][\w'’-]{3,}")
_KANA = re.compile("[\u3041-\u30fa]")
_SHUT = "\"'”’»」』)）]】  "
_STOP = ".!?。！？…:：;；"


def _plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def opening(text: str, number: int = 0) -> str:
    """Letters of the clause ``number`` of a folded text, headings (first lines without punctuation) left out; the text is read as far as needed."""
    at = 0
    while (end := text.find("\n", at)) >= 0 and not _MARK.search(text, at, end):
        at = end + 1
    for end in _ends(text, at):
        clause, at = _plain(text[at:end]), end
        if clause:
            if number == 0:
                return clause
            number -= 1
    return ""


def _ends(text: str, at: int) -> Iterator[int]:
    for m in _CLAUSE.finditer(text, at):
        yield m.end()
    yield len(text)


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))}


def jaccard(a: str, b: str) -> float:
    x, y = _trigrams(a), _trigrams(b)
    return len(x & y) / max(1, len(x | y))


def _empty(text: str) -> bool:
    inner = text.strip(_EDGE).lower()
    return not any(c.isalnum() for c in inner) or inner in STAND_INS


_ROW = "lang string, empty boolean, copy boolean, wrong boolean, open_end boolean, size double, last double, units double, related boolean, sentence boolean, clause string, second string, prompt string"


def _related(s: str, t: str) -> bool:
    """Whether two folded texts have a number or a name in common."""
    numbers = set(re.findall(r"\d+", t))
    return bool(numbers and numbers & set(re.findall(r"\d+", s))) or bool(set(_NAME.findall(s)) & set(_NAME.findall(t)))


def _last_units(text: str, n: int) -> str:
    """The last n sentences or lines of a text that have letters or digits."""
    return " ".join([u for u in _UNIT.split(text) if any(map(str.isalnum, u))][-n:])


def _broken_off(s: str, t: str, fewer: bool) -> bool:
    """Whether the end of a folded response, which lacks its full stop, is none: the last number of the prompt's last unit is missing from its last two, or a comma or the beginning of a clause ends it."""
    if t.rstrip(_SHUT + "\n.…")[-1:] in ",，、(（:：;；":
        return True
    numbers = re.findall(r"\d+", _last_units(s, 1))
    return fewer or bool(numbers and numbers[-1] not in re.findall(r"\d+", _last_units(t, 2)))


def _same_end(s: str, t: str) -> bool:
    """Whether the last line of a folded prompt, such as a code, ends the response too."""
    a, b = ("".join(filter(str.isalnum, x.rstrip().rsplit("\n", 1)[-1].lower())) for x in (s, t))
    return bool(a) and b.endswith(a)


def _facts(sources: pa.Array, targets: pa.Array, model: langid.Model) -> list[pa.Array]:
    n, k, langs = len(sources), len(model.langs), np.array(model.langs)
    both = pa.concat_arrays([sources, targets])
    folded = cs.strings(*unify.fold(*cs.codepoints(both))).to_pylist()
    u = langid.units(*cs.codepoints(both))
    best, sure, margin = langid.classify(u, model)
    weight = u.letters + 2.5 * u.wide
    none = model.langs.index(langid.NONE) if langid.NONE in model.langs else -1
    ok = (best >= 0) & (best != none)
    cell = u.row * k + np.maximum(best, 0)
    count = np.bincount(cell[ok], minlength=2 * n * k).reshape(2 * n, k)
    mass = np.bincount(cell[ok], weight[ok], 2 * n * k).reshape(2 * n, k)
    main, known = mass.argmax(1), mass.sum(1) > 0
    size = np.bincount(u.row, u.letters + u.wide, 2 * n)
    real = (u.letters + u.wide) > 0
    last = np.zeros(2 * n)
    last[u.row[real]] = (u.letters + u.wide)[real]  # the last one of each row stays
    units = np.bincount(u.row[real], minlength=2 * n)
    zh, en, ja = (model.langs.index(x) for x in ("zh", "en", "ja"))
    han = np.array([main[i] == ja and not _KANA.search(folded[i]) for i in range(n)], bool)  # ideographs alone: either language
    to_en = (main[:n] == zh) | han
    off = ok & (u.wide * 2 <= u.letters) & (best != en) & (sure >= SURE) & (margin >= MARGIN) & (u.letters >= LETTERS) | ok & (u.wide * 2 > u.letters)
    not_en = np.bincount(u.row[off], minlength=2 * n)[n:]
    wide, narrow = np.bincount(u.row, u.wide, 2 * n)[n:], np.bincount(u.row, u.letters, 2 * n)[n:]
    not_zh = (narrow >= 4) & (narrow > 4 * wide) | (count[n:][np.arange(n), ja] * 2 > count[n:].sum(1)) & np.array([bool(_KANA.search(x)) for x in folded[n:]], bool)
    readable = known[:n] & ((narrow + wide) >= 2)
    no_en = not_en * 2 > np.maximum(count[n:].sum(1), 1)
    foreign = np.isin(langs[main[n:]], ["ru", "th"]) & known[n:]  # told by the script
    wrong = readable & np.where(han, (no_en | foreign) & not_zh, np.where(to_en, no_en, not_zh))  # of ideographs alone: neither English nor Chinese
    usual = {j: LETTERS_FOR_ONE.get(x, 1.0) for j, x in enumerate(model.langs)}
    empty, copy, open_end, related, sentence, first, second, prompt = [], [], [], [], [], [], [], []
    for i in range(n):
        s, t = folded[i], folded[n + i]
        void = _empty(t)
        empty.append(void)
        s_end, t_end = s.rstrip(_SHUT + "\n\r\t")[-1:], t.rstrip(_SHUT + "\n\r\t")[-1:]
        dots = t.rstrip(_SHUT + "\n").endswith(("...", "…")) and not s.rstrip(_SHUT + "\n").endswith(("...", "…"))
        stop = bool(s_end) and s_end in _STOP
        ends = stop or bool(last[i] >= SENTENCE.get(str(langs[main[i]]), 40) and not _same_end(s, t))  # Thai has no terminators, others may lack theirs
        least = LAST if stop or langs[main[i]] == "th" else LAST_OPEN
        fewer = units[n + i] < units[i] or (last[i] > 0 and last[n + i] / last[i] / usual.get(int(main[i]), 1.0) < least)
        open_end.append(bool(ends and (dots or t_end not in _STOP) and _broken_off(s, t, fewer)))
        related.append(_related(s, t)), sentence.append(bool(t_end) and t_end in _STOP)
        same = False
        if not void and known[i] and known[n + i] and 0.5 < len(t) / max(1, len(s)) < 2 and (main[i] == main[n + i] or s[:20] == t[:20]):
            a, b = _plain(s), _plain(t)
            same = bool(a) and (a == b or jaccard(a, b) >= SIMILAR)
        copy.append(same)
        first.append("" if void else opening(t)), second.append("" if void else opening(t, 1)), prompt.append(opening(_CODE.sub(" ", s)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return [
            pa.array(np.where(known[:n], langs[main[:n]], None), pa.string()), pa.array(empty), pa.array(copy), pa.array(wrong), pa.array(open_end),
            pa.array(np.where(size[:n] > 0, size[n:] / size[:n], np.nan), from_pandas=True), pa.array(np.where(last[:n] > 0, last[n:] / last[:n], np.nan), from_pandas=True),
            pa.array(np.where(units[:n] > 0, units[n:] / units[:n], np.nan), from_pandas=True), pa.array(related), pa.array(sentence), pa.array(first), pa.array(second), pa.array(prompt),
        ]


def facts(df: DataFrame, key: str, prompt: str, response: str, group: list[str], model: langid.Model) -> DataFrame:
    """(key, *group, what the checks need) of every pair with both sides, each key once."""
    kinds = dict(df.dtypes)
    names = [key, *group, *(x.split(" ")[0] for x in _ROW.split(", "))]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = cs.flat(b.column(len(group) + 1)), cs.flat(b.column(len(group) + 2))
            for i, j in cs.slices(t, 1 << 19):
                for x, y in ((i + p, i + q) for p, q in cs.slices(s.slice(i, j - i), 1 << 19)):
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(x, y - x) for c in range(len(group) + 1)), *_facts(s.slice(x, y - x), t.slice(x, y - x), shared.value)], names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [key, *group]), _ROW])
    source = df.where(F.col(key).isNotNull() & F.col(prompt).isNotNull() & F.col(response).isNotNull())
    made = source.select(key, *group, prompt, response).mapInArrow(run, schema)
    return made.groupBy(key).agg(*(F.first(c).alias(c) for c in names if c != key))


def _signatures(clauses: pa.Array) -> np.ndarray:
    """MinHash bands of clauses over their trigrams: BANDS hashes of HASHES/BANDS minima each."""
    cps, off = cs.codepoints(clauses)
    k, mix = np.diff(off), np.uint64(0x9E3779B97F4A7C15)
    row, place = cs.row_of(off), np.arange(len(cps)) - np.repeat(off[:-1], k)
    code = np.r_[cps, 0, 0].astype(np.uint64)
    rest = np.repeat(k, k) - place
    gram = code[:-2] << np.uint64(42) | np.where(rest > 1, code[1:-1], 0).astype(np.uint64) << np.uint64(21) | np.where(rest > 2, code[2:], 0).astype(np.uint64)
    use = (rest >= 3) | (place == 0)  # a shorter clause is one gram
    gram, heads = gram[use], np.searchsorted(row[use], np.arange(len(k)))
    out = np.zeros((len(k), BANDS), np.uint64)
    if not len(gram):
        return out.view(np.int64)
    for h in range(HASHES):
        x = (gram + np.uint64(h + 1)) * mix
        for shift in (29, 32):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(x ^ x >> np.uint64(31), heads)
        out[:, h // (HASHES // BANDS)] = (out[:, h // (HASHES // BANDS)] ^ low) * mix + np.uint64(h)
    return out.view(np.int64)


def _banded(clauses: DataFrame) -> DataFrame:
    """(clause, all, band, h): every band of every clause; no clause is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _signatures(cs.flat(b.column(0)))
            at = pa.array(np.repeat(np.arange(len(h)), BANDS))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(h))), pa.array(h.ravel())], ["clause", "all", "band", "h"])

    return clauses.select("clause", "all").mapInArrow(run, "clause string, all bigint, band int, h bigint")


def _alike(a: Column, b: Column) -> Column:
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _expected(seen: DataFrame) -> DataFrame:
    """(lang, size, e): how many different prompt openings ``size`` random pairs of a language have.

    Each opening is weighed by its share in all pairs, so that neither the size nor a hot opening decides; openings
    of nearly the same frequency are taken together, so there are some hundred steps a language at most.
    """
    share = seen.groupBy("lang", "prompt").agg(F.sum("n").alias("c"))
    steps = share.groupBy("lang", F.round(F.log2("c") * 8).alias("_step")).agg(F.count("*").alias("k"), F.avg("c").alias("c"))
    total = steps.groupBy("lang").agg(F.sum(F.col("k") * F.col("c")).alias("total"))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(640))).alias("i")
    asked = total.select("lang", "total", sizes).select("lang", "total", _size(F.when(F.col("i") <= 64, F.col("i") + 1.0).otherwise(F.pow(2.0, F.col("i") / 16)))).distinct()
    new = F.col("k") * (1 - F.pow(1 - F.col("c") / F.col("total"), F.col("size")))
    return asked.where("size <= 1.1 * total").join(F.broadcast(steps), "lang").groupBy("lang", "size").agg(F.sum(new).alias("e"))


def _size(n: Column) -> Column:
    """A number, above 64 rounded to a sixteenth of a power of two."""
    return F.when(n <= 64, n.cast("double")).otherwise(F.round(F.pow(2.0, F.round(F.log2(n) * 16) / 16), 3)).alias("size")


def refusal_templates(found: DataFrame, group: list[str]) -> DataFrame:
    """(clause): opening clauses of responses that recur across unrelated prompts.

    Rows of one hot clause meet in partial aggregates only; clusters are keyed by band, and each clause is compared
    with one clause, the most frequent of its band. Occurrences of all variants in a cluster count together.
    """
    rows = found.where("clause <> '' and not empty and not copy and lang is not null")
    once = rows.groupBy("clause", "lang", "prompt", *group).agg(F.lit(1).alias("x"))
    seen = once.groupBy("clause", "lang", "prompt").agg(F.count("*").alias("n"))
    clauses = seen.groupBy("clause").agg(F.sum("n").alias("all"))
    banded = session.written(_banded(clauses))  # used twice
    leaders = banded.groupBy("band", "h").agg(F.max_by("clause", F.struct("all", "clause")).alias("leader"), F.sum("all").alias("_sum"), F.count("*").alias("_k"))
    close = banded.join(leaders.where((F.col("_k") > 1) | (F.col("_sum") > REPEATS)).drop("_sum", "_k"), ["band", "h"]).where((F.col("clause") == F.col("leader")) | (_alike(F.col("clause"), F.col("leader")) >= SIMILAR))
    members = close.select("leader", "clause", "all").distinct()
    often = members.groupBy("leader").agg(F.sum("all").alias("_sum")).where(F.col("_sum") > REPEATS).select("leader")
    members = members.join(often, "leader").select("leader", "clause")
    # the occurrences of all variants count together, in each prompt language
    held = seen.join(members, "clause").groupBy("leader", "lang", "prompt").agg(F.sum("n").alias("n"))
    spoken = held.groupBy("leader", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.max_by("prompt", F.struct("n", "prompt")).alias("_first"))
    sized = spoken.withColumn("size", _size(F.col("n"))).join(F.broadcast(_expected(seen)), ["lang", "size"])  # some hundred rows a language
    maybe = _unrelated(sized).select("leader")
    # prompts like the most frequent one count with it: variants of a sound response come from variants of a prompt
    new = held.join(maybe, "leader").join(sized.select("leader", "lang", "e", "_first"), ["leader", "lang"])
    apart = (F.col("prompt") == F.col("_first")) | (_alike(F.col("prompt"), F.col("_first")) < RELATED)
    strong = _unrelated(new.groupBy("leader", "lang").agg(F.sum(apart.cast("int")).alias("d"), F.first("e").alias("e")))
    return members.join(strong.select("leader"), "leader").select("clause").distinct()


def _unrelated(counts: DataFrame) -> DataFrame:
    """(leader) of the clusters with about as many new prompt openings as random pairs have; counts: one row a leader and language."""
    both = counts.groupBy("leader").agg(F.sum(F.col("d") - 1).alias("d"), F.sum(F.col("e") - 1).alias("e"))
    return both.where((F.col("d") >= REPEATS) & (F.col("d") >= UNRELATED * F.col("e")))


def broken_pairs(df: DataFrame, key: str, prompt: str, response: str, group: list[str], model: langid.Model) -> DataFrame:
    """(key, defect) of every defective pair."""
    found = session.written(facts(df, key, prompt, response, group, model))  # used several times
    templates = refusal_templates(found, group)
    usual = found.where("not empty and not copy and not wrong and lang is not null").groupBy("lang").agg(F.percentile_approx("size", 0.5, 1000).alias("usual"))
    # what follows a template opening is a template too, where it recurs
    begun = found.join(templates, "clause", "left_semi").where("not related and not empty")
    bodies = begun.where("second <> ''").groupBy("second").count().where("count > 1").select(F.col("second").alias("clause"))
    known = templates.unionByName(bodies).distinct().withColumn("_template", F.lit(True))
    # pairs without a clause are many and have no template: they are spread
    spread = F.when(F.col("clause") == "", F.concat(F.lit("\0"), F.pmod(F.xxhash64(key), F.lit(256)).cast("string"))).otherwise(F.col("clause"))
    all_ = found.withColumn("clause", spread).join(known, "clause", "left").join(F.broadcast(usual), "lang", "left")  # usual: one row a language
    relative = F.col("size") / F.col("usual")
    cut = ((relative < SHORT) & (F.col("units") <= HALF)) | (relative < LEAST) | F.col("open_end")
    defect = F.when(F.col("empty"), "empty").when(F.col("_template") & ~F.col("related"), "refusal").when(F.col("copy"), "copy").when(F.col("wrong"), "wrong_language").when(cut, "truncated")
    return all_.select(key, defect.alias("defect")).where("defect is not null")
