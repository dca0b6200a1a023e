import os
import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="needs the vocabulary files")


def _texts():
    rng = random.Random(7)
    pool = ["word ", "Satz. ", "句子。", "\n\n", "  ", "'s", " I'll", "x" * 50, "123", "📦", "\t", "…", "ก็", " <|endoftext|> "]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(80)] + ["", "a" * 3000, "word " * 9000, "中" * 20_000, " " * 17_000 + "x", "a, b" * 9000]


def test_pieces_give_the_same_ids():
    enc = tokens.encoding()
    for text in _texts():
        whole = enc.encode_ordinary(text)
        for most in (3, 17, 1 << 14):
            parts = list(tokens.pieces(text, most))
            assert "".join(parts) == text
            assert [i for p in parts for i in enc.encode_ordinary(p)] == whole
        assert tokens.encode(text).tolist() == whole and tokens.decode(np.array(whole)) == text.encode()


def test_against_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = [t for t in _texts() if len(t) < 3000]
    assert [e.ids for e in other.encode_batch(texts, add_special_tokens=False)] == tokens.encode_array(pa.array(texts)).to_pylist()


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello 世界"), (2, ""), (3, None), (1, "Hello 世界")], "doc_id bigint, text string").selectExpr("*", "text as ids")
    rows = tokens.token_ids(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows)[2:] == [(2, 0), (3, 0)] and len(rows) == 4
    back = tokens.texts_of(tokens.token_ids(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "Hello 世界"), (1, "Hello 世界"), (2, ""), (3, "")]
    assert tokens.token_ids(df.where("false"), "doc_id", "text").count() == 0


def test_pack_fills_and_never_overflows():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 2049, 3000), np.full(100, 2048), np.full(100, 1025), np.full(7, 1), rng.zipf(1.3, 4000).clip(1, 2048), np.zeros(0, np.int64)):
        box = packing.pack(sizes)
        fill = np.bincount(box, sizes) if len(sizes) else np.zeros(0)
        assert (fill <= 2048).all() and (fill > 0).all()
        least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert len(fill) <= 11 / 9 * least + 1
        step = packing.steps(fill)
        assert np.bincount(step).max(initial=0) <= packing.STEP


def test_tiers_decide():
    """Each tier packs windows of its own size, and such a window stays together in a long one's gap; best fit alone would part it."""
    assert packing.tiers() == [2048, 512, 128, 32, 8]
    sizes = np.array([1548, 1698, 350, 150])  # gaps of 500 and 350; the window of 350 + 150 fills the first gap
    assert packing.pack(sizes).tolist() == [0, 1, 0, 0] or packing.pack(sizes).tolist() == [1, 0, 1, 1]
    plain = packing.windows(sizes, 2048)
    assert plain[2] == plain[1] and plain[2] != plain[0]
    rng = np.random.default_rng(3)
    other = 0
    for n in (50, 500, 5000):
        for sizes in (rng.integers(1, 2049, n), rng.integers(1, 600, n), np.exp(rng.normal(5, 1.5, n)).astype(int).clip(1, 2048)):
            box = packing.pack(sizes)
            other += (box != packing.windows(sizes, 2048)).any()
            assert np.bincount(box, sizes).max() <= 2048 and box.max() + 1 <= 1.005 * (packing.windows(sizes, 2048).max() + 1) + 1
    assert other >= 6


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 700, 1500, 2048, 2049, 6000, 5 * 2048])) for i in range(500)] + [(3, 700), (900, None), (None, 5)]
    rows = [(i, n if i != 3 else 700) for i, n in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens int").selectExpr("*", "1 as container", "2 as piece")
    out = packing.containers(df, "doc_id", "tokens", group=100).toPandas()
    assert (out.groupby("container").tokens.sum() <= 2048).all()
    want = {i: n for i, n in rows if n and i is not None}
    assert out.groupby("doc_id").tokens.sum().to_dict() == want
    for i, own in out.groupby("doc_id"):
        assert len(own) == -(-want[i] // 2048) and sorted(own.piece) == list(range(len(own)))
    again = packing.containers(df, "doc_id", "tokens", group=100).toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, out.values))
    assert packing.containers(df.where("false"), "doc_id", "tokens").count() == 0
