"""Ids by words are those of whole texts, for any tokenizer file."""

import random

import numpy as np
import public_tokenizers
import pytest

from cases import texts
from leaksieve.llm.tokens import PROBE, WordTokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y, z", "<|EndOfText|> a", "< |endoftext|>", "don't 'tis it's I'LL", "é", "é É ÉCOLE café.",
    "a b　c\u0085d", "12ab34 a1b", "!!!...", "", " ", "\n\n", "ＡＢＣ", "İstanbul ſtraße K", "🙂a🙂", "á b", "́a", "x" * 3000,
]


def library(path, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return [whole.encode(t, add_special_tokens=False).ids for t in rows]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    path = public_tokenizers.path(name)
    rng = random.Random(1)
    rows = [t for t in texts() if t is not None] + ODD + [PROBE]
    rows += ["".join(rng.choices("abcdeéñ 'st.,12\n-A", k=rng.randint(0, 60))) for _ in range(400)]
    rows += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 14))) for _ in range(200)) for _ in range(10)]
    words = WordTokenizer(path)
    assert words.by_words == (name == "word_bpe_49k.json") and (words.merges is not None) == words.by_words
    got = [np.frombuffer(x, "<u4").tolist() for x in words.encode([t.encode() for t in rows])]
    for text, a, b in zip(rows, got, library(path, rows)):
        assert a == b, text


def test_special_names_are_special():
    [ids] = WordTokenizer(WORDS).encode([b"a <|endoftext|> b"])
    assert 49407 in np.frombuffer(ids, "<u4")


def test_words_of_letters_are_not_kept():
    words = WordTokenizer(WORDS)
    rows = ["zzqx zzqy, the THE (end)...", "", " \n", "été zzqx!?", "a-b -a a- c3 |x| 'tis\tx"]
    want = library(WORDS, rows)
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode([t.encode() for t in rows])] == want
    assert [np.frombuffer(words.encode([t.encode()])[0], "<u4").tolist() for t in rows] == want
    assert b"zzqx" not in words.known and words.encode([]) == [] and words.encode([b""]) == [b""]
