import random
import re

import pytest

from leaksieve.catalogue import counterexample, default_rules, formats, sample
from leaksieve.functions import regex as rx
from leaksieve.operators.rules import compile_pattern


def test_flags_move_to_the_front():
    assert rx.hoist_flags("ab(?i)c") == "(?i)abc"
    assert rx.hoist_flags("a(?i)b(?s)c(?i)") == "(?s)(?i)abc"
    assert rx.hoist_flags("(?i)ab") == "(?i)ab"
    # a flag at the start and again later stays where it is
    assert rx.hoist_flags("(?i)a(?i)b") == "(?i)a(?i)b"


def test_column_form_hoists_alike(spark):
    patterns = ["ab(?i)c", "a(?i)b(?s)c(?i)", "(?i)a(?i)b", "plain", "x(?U)(?L)y(?m)"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = [r.h for r in df.select(rx.hoist_inline_flags(df.p).alias("h")).collect()]
    assert got == [rx.hoist_flags(p) for p in patterns]


@pytest.mark.parametrize(
    "pattern,text",
    [
        (r"(?P<a_b>x+)-(?P=a_b)", "--xx-xx"),
        (r"a{,2}b{c", "aab{c"),
        (r"x[[]y", "x[y"),
        (r"[^]]+]", "ab]"),
        (r"[a&&b]+", "&&a"),
        (r"^\${a}$", "${a}"),
        (r"a\Z", "ba"),
        (r"\x41\101\v", "AA\x0b"),
        (r"a(?#note)b", "ab"),
        (r"(?x) a [ ] b # end", "a b"),
        (r"é\w+", "xéàb"),
        (r"\bкот\b", "а кот б"),
        (r"a.b", "a\rb"),
        (r"(?i)straße kelvin", "STRAßE KELVIN"),
        (r"\U0001F600+", "ab\U0001f600"),
        (r"[[:alnum:]]{3}", "..a1B"),
    ],
)
def test_java_form_matches_like_python(spark, pattern, text):
    compiled = compile_pattern(pattern)
    m = re.search(rx.python_form(rx.hoist_flags(pattern)), text)
    assert m, "the case itself must match"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.selectExpr(f"regexp_extract(t, {_sql(compiled.java)}, 0) as g").first().g
    assert got == m[0]


def _sql(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def test_dead_patterns_say_why():
    for pattern in ("(", "a(?L)b", "x**", "(?(1)a|b)("):
        assert compile_pattern(pattern).java is None
        assert compile_pattern(pattern).reason
    assert compile_pattern("").java is None
    assert compile_pattern("(a)(?(1)b|c)").reason.startswith("not supported")


def test_required_literals():
    assert rx.required_literals("ghp_[a-z]{3}") == {"ghp_"}
    assert rx.required_literals("(?:ab_|cd_)x*") == {"ab_", "cd_"}
    assert rx.required_literals("[a-z]+") is None
    assert rx.required_literals("(?:abc)?x*") is None
    assert rx.required_literals("(?i)Token") == {"token"}
    assert rx.required_literals("é+") is None


def test_every_match_contains_a_required_literal():
    for rule, pattern in zip(default_rules().rules, default_rules().compiled()):
        match = re.search(rx.python_form(rx.hoist_flags(rule.regex)), rule.example)
        assert match, rule.id
        if pattern.literals:
            assert any(x in match[0].lower() for x in pattern.literals), rule.id


def test_gate_opens_for_every_example_in_any_surroundings(spark):
    """The gate may open too often but never misses a rule, in whatever letter case or company."""
    rules, rng = default_rules(), random.Random(7)
    patterns = rules.compiled()
    gate = rx.build_gate({i: p.literals for i, p in enumerate(patterns)})
    noise = ["", "asiasiakey", " sk_live_ ghs_ pat.", "xoxxoxe.xoxb-", "ſKıİ", "😀 -----BEGIN", "password"]
    rows = []
    for i, rule in enumerate(rules.rules):
        text = rng.choice(noise) + " " + rule.example + " " + rng.choice(noise)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "i int, t string")
    found = {r.i: set(r.f) for r in df.select("i", gate.found(df.t).alias("f")).collect()}
    for i, text in rows:
        if patterns[i].literals:
            assert found[i] & patterns[i].literals, (rules.rules[i].id, text)
            # and what it reports is really there
            assert all(x in text.lower().translate(str.maketrans("ſıİK", "siik")) for x in found[i])


def test_gate_sees_folded_characters(spark):
    gate = rx.build_gate({0: {"slack"}, 1: {"linkedin"}})
    df = spark.createDataFrame([("ſlacK Lİnkedın",)], "t string")
    assert set(df.select(gate.found(df.t).alias("f")).first().f) == {"slack", "linkedin"}


def test_every_rule_has_its_case_and_countercase():
    rules = default_rules().rules
    assert len({r.id for r in rules}) == len(rules) == len(formats())
    for at, (rule, found) in enumerate(zip(rules, formats())):
        assert found.source and not re.search(rule.regex, counterexample(found)), rule.id
        assert next(i for i, r in enumerate(rules) if re.search(r.regex, rule.example)) == at, rule.id
    compiled = default_rules().compiled()
    assert all(p.java and p.literals and not p.nests for p in compiled)


def test_sample_is_stable():
    assert sample("ab[0-9]{3}(?:x|y)") == sample("ab[0-9]{3}(?:x|y)")
