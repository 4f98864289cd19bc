"""Token ids and counts against the library itself; packing against the contract."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsmith.llm import op2_packing, op10_tokens, tokens
from tabsmith.llm.tokens import WordTokenizer, tokenizer_text
from tests.llm.helpers import docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "",
    "  \t\n",
    "Don't STOP me\x1cnow\x85x",
    "a<|endoftext|>b <|startoftext|>",
    "ΑΣ Σας é ́x ÅNG İstanbul ﬁ ½ x² 12345 日本語 한국 x y",
    "I'll've 's 'S 'RE can't'",
    "ß ẞ straße é̂",
    "\U0001f600 ok" + "x" * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return WordTokenizer(tokenizer_text(PATH))


def test_ids_equal_the_library(library, own):
    rng = random.Random(1)
    letters = "aZé'’ \n\tß<|>#1²́ ΣσñÑ\x1f‍日ǅ"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(50)) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_prefix(library, own):
    for text in [*HARD, "thanedble the, and  hello!! it's <b>", words(12, 3)]:
        counts = op10_tokens.PrefixCounts(own, text.encode())
        exact = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert [counts.at(n) for n in range(len(text) + 1)] == exact
        assert counts.every().tolist() == exact
        for budget in (0, 1, 2, 5, 9, 1000):
            assert counts.within(budget) == max(n for n, c in enumerate(exact) if c <= budget)


def test_every_prefix_of_long_random_words(library, own):
    rng = random.Random(6)
    alphabets = ["etaoinshr", "abcdefghijklmnopqrstuvwxyz", "aZé'sretlvmd!", "日本語한국각", "e\u0301\u0302\u0323\u0301o\u0308q", "'rvlesx1 \u1100\u1161\u11a8<|>", "aΣİßǅﬁ²x\u00a0\u2028\x1c\x85", "0123456789abcdefABCDEF+/="]
    for _ in range(120):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) + rng.choice(["", "<|endoftext|>", "'re", "!<|startoftext|>'ll"])
        exact = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert op10_tokens.PrefixCounts(own, text.encode()).every().tolist() == exact, text


def test_one_very_long_word(library, own, monkeypatch):
    rng = random.Random(7)
    word = "".join(rng.choice("etaoinshrdlucmf") for _ in range(60_000))
    counts = op10_tokens.PrefixCounts(own, word.encode())
    monkeypatch.setattr(own, "encode", None)  # nothing is encoded again
    inside = counts.inside(0)
    assert inside[-1] == counts.total == len(library.encode(word, add_special_tokens=False).ids)
    for n in (1, 1000, 59_999):
        assert inside[n] == counts.at(n) == len(library.encode(word[:n], add_special_tokens=False).ids)
    fit = counts.within(2048)
    assert inside[fit] <= 2048 < inside[fit + 1 :].min()


def test_counts_query_shape(spark, library):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "two words", "en", "a"), (3, words(3000, 1), "en", "a"), (3, "same id", None, "b"), (3, "same id", None, "b")]
    out = op10_tokens.prefix_counts(docs(spark, rows), PATH, budgets=(5,), cuts=(3,), table=True).collect()
    assert len(out) == 6
    for (i, text, _, _), row in zip(rows, out, strict=True):
        text = text or ""
        assert (row.doc_id, row.n_bytes, row.n_tokens) == (i, len(text.encode()), len(library.encode(text).ids))
        assert row.tokens_at_3 == len(library.encode(text[:3]).ids)
        assert row.counts[-1] == row.n_tokens and len(row.counts) == len(text) + 1
    assert op10_tokens.prefix_counts(docs(spark, []), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))


def test_tree_is_first_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 300)
    bins, offsets = op2_packing.first_fit_decreasing(sizes, 64)
    room, expected = [], np.zeros(300, int)
    for k in np.argsort(-sizes, kind="stable"):
        b = next((n for n, r in enumerate(room) if r >= sizes[k]), len(room))
        room[b:] = [64 - sizes[k]] if b == len(room) else [room[b] - sizes[k], *room[b + 1 :]]
        expected[k] = b
    assert bins.tolist() == expected.tolist()
    for b in set(bins.tolist()):
        spans = sorted((offsets[k], sizes[k]) for k in np.flatnonzero(bins == b))
        assert [o for o, _ in spans] == np.append(0, np.cumsum([s for _, s in spans])[:-1]).tolist()


def test_packing_contract(spark, library):
    rows = [(n, words(n % 90, n), "en", "hot") for n in range(200)] + [(500, words(4000, 7), "en", "a"), (501, None, None, None), (502, "", None, None), (None, "no id", None, None), (7, "again", None, None)]
    table = docs(spark, rows)
    out = op2_packing.pack(table, PATH, capacity=256, group_documents=64).toPandas()
    texts = {(i, t) for i, t, _, _ in rows}
    assert len(texts) == len(rows)
    filled = out.sort_values(["sequence_id", "offset"])
    for _, part in filled.groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert part.length.sum() <= 256
    for i, text in ((500, rows[200][1]), (501, ""), (502, "")):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = out[out.doc_id == i].sort_values("start")
        assert pieces.length.sum() == len(ids) and (pieces.doc_tokens == len(ids)).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[int(p.start) : int(p.start + p.length)].tobytes())
    assert out.length.sum() > 0.9 * 256 * out.sequence_id.nunique()
    again = op2_packing.pack(table, PATH, capacity=256, group_documents=64).toPandas()
    order = ["doc_id", "start", "ids_crc32"]
    assert out.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert op2_packing.pack(docs(spark, []), PATH).count() == 0


def test_frequent_parts_of_words_outlive_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    own, asked = WordTokenizer(tokenizer_text(PATH)), []
    monkeypatch.setattr(own.units, "encode", lambda unit: asked.append(unit) or own._unit(unit))
    # Every word is new, its first part is not.
    texts = ["often" + "!" * (n % 30 + 1) + words(1, n) for n in range(300)]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, (own.memo, own.memo.old, own.units, own.units.old))) <= 20
    assert asked.count("often") == 1
