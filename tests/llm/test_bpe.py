"""Both ways of encoding against the library, on strings made of pieces that break tokenizers."""

from __future__ import annotations

import random

import pytest

from contractlake.llm import bpe
from contractlake.llm.queries import tokenizer_path

PIECES = list("abcstmdlvreIİıKÅéñßſΑΣσςДж漢字かな한글½Ⅷ١٢09.,*&$%#!?;:|)('\"-_<>[]{}@/\\+=~^`") + [
    "́", "̇", "̈", "̧", "ͅ", "̣̀", "é", "i̇", "ᄀ", "ᅡ", "ᆨ", "​", "‍", "️", "🙂", "🇩🇪",
    " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "᠎", " ", " ", " ", " ", " ", "　", "﻿", "\x00", "\xad",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'s", "'t", "'re", "'ll", "the", "ing", "station", "hello", "Straße", "ﬁ", "ǅ", "ẞ", "ŉ", "İ.", "İ)", "\U00010400", "กำ", "कि", "͸",
]


def strings(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        pool = r.sample(PIECES, r.randrange(2, 14))
        yield "".join(r.choice(pool) for _ in range(r.randrange(1, 40)))


def test_words_that_end_in_a_mark_from_lower_case():
    t = bpe.Bpe(tokenizer_path())
    texts = ["İ.", "İ.x", "xİ)", "i̇.", "ΑΣ.", "K.", "İİ!! İ", "a. b) c.d", "x. x x."]
    assert t.answers(texts).to_pylist() == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(4))
def test_no_difference_from_the_library(seed):
    t = bpe.Bpe(tokenizer_path())
    r = random.Random(seed)
    texts = list(strings(seed, 1500))
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids = t.answers(texts)
    assert [x for x, a, b in zip(texts, ids.to_pylist(), want) if a != b] == []
    assert t.decoded(ids).to_pylist() == [t.tokenizer.decode(i, skip_special_tokens=False) for i in want]
    for x, i in zip(texts, want):
        c = r.randrange(1, 12)
        leaves = [x[k : k + c] for k in range(0, len(x), c)]
        assert bpe.tree_concatenate(t.spans, leaves, [t.spans(y) for y in leaves], r.choice([15, 32]))[:, 2].tolist() == i, ascii(x)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    t = bpe.Bpe(tokenizer_path())
    for x in ("one two. three four five", "six two three", "", "one. two."):
        assert t.answers([x]).to_pylist() == [t.tokenizer.encode(x, add_special_tokens=False).ids]


def test_spans_are_packed_and_back():
    t = bpe.Bpe(tokenizer_path())
    for x in ("", "a", " one  two🙂🙂 x\u0301\u0323 ", "İ. 漢字"):
        s = t.spans(x)
        assert (bpe.unpacked(bpe.packed(s)) == s).all()
