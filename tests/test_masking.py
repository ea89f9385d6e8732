"""Masked texts against a plain sweep, and no rule finds anything in them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import masking, matching
from leaksieve.operators.rules import RuleSet
from leaksieve.options import MatchOptions

RULES = RuleSet.from_dict(
    {
        "rules": [
            {"id": "key", "regex": "key=[a-f0-9]{4,}", "example": "key=abcd"},
            {"id": "long", "regex": "[a-z]{3}-[a-z]{3}", "example": "abc-def"},
            {"id": "over", "regex": "[a-f0-9]{3}!+", "example": "abc!"},
            {"id": "allowed", "regex": "(?i)secret[0-9]", "example": "SECRET1", "allowlists": [{"regexes": ["fine"]}]},
            {"id": "nests", "regex": "(?:x[0-9]+)+y", "example": "x1y"},
            {"id": "empty", "regex": "q*", "example": ""},
            {"id": "seam", "regex": "<<REDACTED>>", "example": ""},
        ]
    }
)
PIECES = ["key=abcd12", "key=", "abc", "-", "def", "!", "!!", "SECRET1", "secret2", "fine", "x1", "x22", "y", "é😀", "\n", " ", "<", ">", "qq", "<REDACTED>"]


def plain(text, low=0, high=None, marks="<REDACTED>"):
    """The same by loops."""
    patterns = [re.compile(p.python) for p in RULES.compiled() if p.java]
    high = len(text) if high is None else high

    def stretches(text):
        out = []
        for a, b in masking.find_spans(text, patterns):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def build(text, spans, low, high):
        out, at = [], low
        for a, b in spans:
            if b > low and a < high:
                out += [text[at : max(a, at)], marks]
                at = b
        return "".join(out) + text[min(at, high) : high]

    made = build(text, stretches(text), low, high)
    for turn in range(masking.ROUNDS):
        spans = stretches(made)
        if spans:
            made = build(made, spans, 0, len(made)) if turn + 1 < masking.ROUNDS else marks
    return made


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(400)] + ["", "<" + "key=abcd" + ">", "a" * 50]


def test_masked_texts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in masking.mask_secrets(frame, RULES).collect()}
    patterns = [re.compile(p.python) for p in RULES.compiled() if p.java]
    for k, text in enumerate(texts):
        assert got[k].masked_text == plain(text), text
        assert not masking.find_spans(got[k].masked_text, patterns)


def test_null_texts(spark):
    frame = spark.createDataFrame([(1, None), (2, "key=abcd")], "k int, text string")
    assert {r.k: r.masked_text for r in masking.mask_secrets(frame, RULES).collect()} == {1: None, 2: "<REDACTED>"}


def test_a_mark_that_a_rule_finds(spark):
    rules = RuleSet.from_dict({"rules": [{"id": "caps", "regex": "[A-Z]{4,}"}]})
    frame = spark.createDataFrame([("abcd EFGH ij KLMNO",), ("ABC" + "WXYZ" + "DEF",)], "text string")
    assert [r.masked_text for r in masking.mask_secrets(frame, rules).collect()] == ["abcd  ij ", ""]


@pytest.mark.parametrize("limit", [None, 20, 0])
def test_mocks(spark, texts, limit):
    """In a scan: whole texts up to the limit, windows beyond it, and no part of a secret at a window's border."""
    frame = spark.createDataFrame([("p", str(k), t) for k, t in enumerate(texts)], "platform string, url string, text string")
    options = MatchOptions(mock_limit=limit, mock_window=6, mock_all=True)
    only = RuleSet(RULES.rules[:5], unicode_classes=True)
    found = matching.scan_texts(frame, only, options).select("url", "begin", "end", "mocked_secret").collect()
    assert len(found) > 100
    patterns = [re.compile(p.python) for p in only.compiled()]
    for row in found:
        assert not masking.find_spans(row.mocked_secret, patterns), (texts[int(row.url)], row.mocked_secret)
    shown = matching.scan_texts(frame, only, MatchOptions(mock_limit=limit, mock_window=6)).select("mocked_secret").collect()
    assert any(masking.find_spans(r.mocked_secret, patterns) for r in shown)  # by default other secrets stay


def test_merged_spans(spark):
    rows = [([],), ([(1, 3)],), ([(1, 3), (2, 5), (5, 6), (8, 9), (0, 1)],), ([(4, 9), (5, 6)],)]
    frame = spark.createDataFrame(rows, "s array<struct<begin:int,end:int>>")
    got = [[tuple(x) for x in r.m] for r in frame.select(masking.merge_spans(F.col("s")).alias("m")).collect()]
    assert got == [[], [(1, 3)], [(0, 6), (8, 9)], [(4, 9)]]
