import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from plain import scan as plain_scan

from pyspark.sql import functions as F

from leaksieve.catalogue import default_rules
from leaksieve.functions import regex as rx
from leaksieve.operators import matching as mt
from leaksieve.operators.rules import Rule, RuleSet
from leaksieve.options import MatchOptions

RULES = RuleSet.from_dict(
    {
        "rules": [
            {"id": "r0", "regex": "AB[0-9]{4}", "example": "AB0000", "allowlists": [{"regexes": ["SAMPLE"]}]},
            {"id": "r1", "regex": "key=[a-z]{4}"},
            {"id": "r2", "regex": r"\bzz\b(?s:.){2}", "example": ""},
            {"id": "dead", "regex": "((", "example": "x"},
            {"id": "r4", "regex": "(?i)été(x?)", "example": "summer"},
        ]
    }
)


def table(spark, texts):
    rows = [(i, f"u{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, url string, text string")


def rows(df):
    return {
        r.i: (r.rule_ord, r.secret, r.line_number, r.sanitized_secret, r.mocked_secret, r.begin) for r in df.collect()
    }


CASES = [
    "x AB1234 y AB9999",
    "AB1234 key=abcd",
    "AB1234 SAMPLE\nkey=abcd",
    "AB0000",
    "nothing here",
    "",
    None,
    "😀😀 AB1234 tail",
    "line\r\nother\r\nAB1234",
    "azz zzb zz!? zz",
    "ÉTÉX in summer",
    "AB1234" + "x" * 12_000 + "AB1234",
    "y" * 5_000 + "AB1234" + "x" * 6_000,
    "zz" + "q" * 11_000,
    "key=abcd key=efgh <REDACTED>",
    "ab1234 AB1234",
    "AB1234",
    "end AB1234",
]


@pytest.mark.parametrize("gate", [True, False])
def test_golden_rows(spark, gate):
    got = rows(mt.scan_texts(table(spark, CASES), RULES, gate=gate))
    want = {i: plain_scan(RULES.rules, t) for i, t in enumerate(CASES) if t}
    assert got == {i: w for i, w in want.items() if w}
    assert got[0][3:5] == ("x <REDACTED> y AB9999", "x AB0000 y AB9999")
    assert got[2][:4] == (1, "key=abcd", 2, "AB1234 SAMPLE\n<REDACTED>")
    assert got[3][4] == "AB0000"


PIECES = hs.sampled_from(
    ["AB12", "34", "AB9999", " ", "\n", "\r\n", "SAMPLE", "key=", "abcd", "zz", "😀", "é", "ÉTÉ", "x", "zz ", "ab1234", " "]
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(hs.lists(hs.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=60))
def test_random_texts_agree_with_plain_python(spark, texts):
    got = rows(mt.scan_texts(table(spark, texts), RULES))
    want = {i: plain_scan(RULES.rules, t) for i, t in enumerate(texts) if t}
    assert got == {i: w for i, w in want.items() if w}


def test_catalogue_agrees_with_plain_python(spark):
    """Every rule's example, alone and in company, in the order of the rules."""
    rules = default_rules()
    texts = [r.example for r in rules.rules] + [f'a="b"\nclé {r.example}\n' for r in rules.rules]
    got = rows(mt.scan_texts(table(spark, texts), rules))
    want = {i: plain_scan(rules.rules, t) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert len(got) >= 2 * len(rules) - 4  # allow-listed placeholders apart


def test_has_leak(spark):
    got = {r.i: r.has_leak for r in mt.has_leak(table(spark, CASES), RULES).collect()}
    assert got == {i: bool(t and plain_scan(RULES.rules, t)) for i, t in enumerate(CASES)}


def test_filters_on_results_stay_above_the_chain(spark):
    df = table(spark, CASES)
    for kept in (mt.has_leak(df, RULES).where("has_leak"), mt.scan_texts(df, RULES).where("rule_id = 'r1' AND secret <> ''")):
        assert kept._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1


def test_no_live_rule_finds_nothing(spark):
    dead = RuleSet((Rule("d", "(("),))
    assert mt.scan_texts(table(spark, CASES), dead).count() == 0
    assert not any(r.has_leak for r in mt.has_leak(table(spark, CASES), dead).collect())


def test_long_rule_lists_keep_the_first_rule(spark):
    many = RuleSet(tuple(Rule(f"n{i}", f"W{i:03d}[a-z]") for i in range(60)))
    texts = [f"W{i:03d}a W{(i + 7) % 60:03d}b" for i in range(60)]
    got = {r.i: r.rule_ord for r in mt.scan_texts(table(spark, texts), many).collect()}
    assert got == {i: min(i, (i + 7) % 60) for i in range(60)}


def test_the_chain_is_evaluated_once_and_nothing_shuffles(spark):
    plan = mt.scan_texts(table(spark, CASES), RULES)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"RLIKE\(text#\d+, \(\?d", plan)) == sum(len(r.allowlists) + 1 for r in RULES.rules if r.id != "dead")
    assert plan.count("regexp_extract_all") == 1
    assert "Exchange" not in plan and "Join" not in plan


def test_the_matcher_ignores_opt_in_fields(spark):
    rule = Rule("e", "AB[0-9]{4}", entropy=9.0, keywords=("nope",), path="nope", secret_group=0)
    df = table(spark, ["AB1234"])
    assert mt.scan_texts(df, RuleSet((rule,))).count() == 1
    for name in ("entropy_filter", "keyword_prefilter", "path_filter"):
        assert mt.scan_texts(df, RuleSet((rule,)), MatchOptions(**{name: True})).count() == 0


def test_secret_group_narrows_the_span(spark):
    rules = RuleSet((Rule("g", "k=([a-z]+)([0-9]+)", secret_group=2, example="N"),))
    r = mt.scan_texts(table(spark, ["é k=abc123!"]), rules, MatchOptions(secret_group=True)).first()
    assert (r.secret, r.begin, r.end, r.sanitized_secret) == ("123", 7, 10, "é k=abc<REDACTED>!")


def test_python_search_has_small_batches(spark):
    nested = RuleSet.from_dict({"rules": [{"id": "n", "regex": "(?:ab?){2,}c"}]})
    key, old = rx.BATCH_BYTES, spark.conf.get(rx.BATCH_BYTES)
    try:
        for given, want in ((str(64 << 20), 4 << 20), (str(1 << 20), 1 << 20)):
            spark.conf.set(key, given)
            texts = spark.range(40).select(F.concat(F.repeat(F.lit("x"), F.lit(1 << 18)), F.lit("ababc")).alias("text"))
            assert mt.scan_texts(texts, nested).select("begin").distinct().collect() == [(1 << 18,)]
            assert int(spark.conf.get(key).rstrip("b")) == want
    finally:
        spark.conf.set(key, old)
