"""Patterns that would overflow the JVM's stack, and spans of groups."""

import plain
import pytest

from leaksieve.functions import regex as rx
from leaksieve.operators import findings as fi
from leaksieve.operators import matching as mt
from leaksieve.operators.rules import RuleSet
from leaksieve.options import MatchOptions, ScanOptions
from leaksieve.plans.scan import scan
from leaksieve.sources import files

DEEP = [r"key=(?:a|b)+c", r"(?i)pw:(\w|-)+;", r"x(?:[0-9]+,?)*y", r"<(?:(?:ab)?c)*>"]


def rules(*patterns, **more):
    return RuleSet.from_dict({"rules": [{"id": f"r{i}", "regex": p, **more} for i, p in enumerate(patterns)]})


def texts(spark, *rows):
    return spark.createDataFrame([("p", str(i), f"u{i}", "file", t) for i, t in enumerate(rows)], "platform string, issue_id string, url string, field string, text string")


def test_which_patterns_may_nest():
    assert all(rx.may_nest(p) for p in DEEP)
    safe = [r"ab+", r"(?:ab)+", r"([a-z]|b)", r"(?:a|b){1,20}", r"[(|)]+x", r"\(a|b\)+", r"(?P<n>ab)*", r"(?:-[a-z]{3})+"]
    assert not any(rx.may_nest(p) for p in safe)


def test_long_texts(spark):
    long = 1_000_000
    rows = ["key=" + "ab" * (long // 2) + "c", "key=" + "ab" * (long // 2), "pw:" + "a-" * 5000 + ";", "é x" + "12," * 5000 + "y", "<" + "abc" * 9000 + ">", "<" + "abc" * 9000, "none"]
    ruleset = rules(*DEEP)
    got = {r.url: r for r in mt.scan_texts(texts(spark, *rows), ruleset).collect()}
    for i, text in enumerate(rows):
        want = plain.scan(ruleset.rules, text)
        assert (f"u{i}" in got) == (want is not None)
        if want:
            r = got[f"u{i}"]
            assert (r.rule_ord, r.secret, r.line_number, r.sanitized_secret, r.mocked_secret, r.begin) == want
    flags = {r.url: r.has_leak for r in mt.has_leak(texts(spark, *rows), ruleset).collect()}
    assert {u for u, f in flags.items() if f} == set(got)


def test_deep_allowlists_and_targets(spark):
    long = "ab" * 300_000
    rows = [f"TOKEN1 ok={long}z", f"TOKEN2 ok={long}", "TOKEN3"]
    allow = [{"regexes": [r"ok=(?:a|b)+z"]}]
    got = mt.scan_texts(texts(spark, *rows), rules("TOKEN[0-9]", allowlists=allow)).collect()
    assert sorted(r.secret for r in got) == ["TOKEN2", "TOKEN3"]
    for target in ("match", "line"):
        allow = [{"regexes": ["yes"], "regexTarget": target}]
        ruleset = rules(r"t=(?:a|[yes])+;", allowlists=allow)
        got = mt.scan_texts(texts(spark, "t=ayes;", "t=aaa;\nyes"), ruleset, MatchOptions(regex_target=True)).collect()
        assert [r.secret for r in got] == ["t=aaa;"]


def test_group_span_is_its_own(spark):
    """The group's text also stands earlier in the match."""
    ruleset = rules(r"token=([a-z]+)!", secretGroup=1)
    rows = ["my token=to! end", "é token=abc!", "x"]
    for options in (MatchOptions(secret_group=True), MatchOptions(*[True] * 9)):
        got = {r.url: r for r in mt.scan_texts(texts(spark, *rows), ruleset, options).collect()}
        assert (got["u0"].secret, got["u0"].sanitized_secret) == ("to", "my token=<REDACTED>! end")
        assert (got["u1"].begin, got["u1"].end) == (8, 11)


@pytest.mark.parametrize("setting", ["true", "false"])
def test_session_setting_does_not_matter(spark, setting):
    name = "spark.sql.parser.escapedStringLiterals"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, setting)
    try:
        found = mt.scan_texts(texts(spark, "AB1234", "it's $x \\d"), rules(r"AB\d{4}", r"it's \$x \\d")).collect()
        assert sorted(r.secret for r in found) == ["AB1234", "it's $x \\d"]
    finally:
        spark.conf.set(name, before)


def test_null_urls_keep_findings(spark):
    rows = spark.createDataFrame([("Jira", str(i), None, "file", f"x{i} AB{i}") for i in range(2)], "platform string, issue_id string, url string, field string, text string")
    found = fi.dedup_findings(fi.build_findings(mt.scan_texts(rows, rules("AB[0-9]")))).collect()
    assert len(found) == 2 and all(r.id for r in found) and {r.url for r in found} == {""}


def test_genuine_replacement_characters_stay(spark):
    rows = [("h", "b", "p", bytearray("a�b".encode() + b"\xff" + b"c"))]
    table = spark.createDataFrame(rows, "html_url string, branch string, path string, content binary")
    assert files.norm_github(table).first().file == "a�bc"


def test_skipped_comments_do_not_hold_posts_back(spark):
    tickets = spark.createDataFrame([("Jira", "1", "u", "AB1")], "platform string, issue_id string, url string, title string")
    comments = spark.createDataFrame([("Jira", "1", 0, "leaksieve_auto_comment")], "platform string, issue_id string, item_ord bigint, text string")
    for skip, posts in ((False, 0), (True, 1)):
        options = ScanOptions(post_comment=True, skip_comment=skip)
        assert scan(tickets, comments, rules("AB[0-9]"), options).outbox.count() == posts
