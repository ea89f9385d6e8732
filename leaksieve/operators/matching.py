"""The scan: first accepted rule per text, its span, and the redacted and mocked forms.

Everything here is one narrow stage over a ``texts`` table. Patterns enter the plan as literals,
so each is compiled once per task; the rule table is never joined with the texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions import regex as rx
from leaksieve.functions import text as tx
from leaksieve.functions.text import sql_literal as lit
from leaksieve.operators.masking import mock_all_secrets
from leaksieve.operators.rules import Allowlist, Pattern, Rule, RuleSet
from leaksieve.options import MatchOptions

_FOUND, _ORD = "_found", "_ord"
_CHAIN = 16  # rules per projection
_RULE_CONSTANTS = (
    "array<struct<id:string,description:string,regex:string,java:string,tail:string,"
    "groups:int,example:string,entropy:double,secret_group:int,python:string,nests:boolean>>"
)


# Conditions of single rules are SQL strings: a chain of hundreds of rules is then parsed in a few
# steps by the JVM, instead of being put together call by call.


def _any(tests: list[str]) -> str | None:
    return "(" + " OR ".join(tests) + ")" if tests else None


def _search(on: str, pattern: Pattern, only: str | None = None) -> str:
    """Whether a pattern is found. ``only``: where the answer matters, for patterns that Python has to run."""
    if not pattern.nests:
        return f"{on} RLIKE {lit(pattern.java)}"
    on = f"CASE WHEN {only} THEN {on} END" if only else on
    return f"coalesce(leaksieve_search({on}, {lit(pattern.python)}), false)"


def _any_rlike(on: str, patterns: list[Pattern], only: str | None = None) -> str | None:
    return _any([_search(on, p, only) for p in patterns])


def _any_contains(on: str, words: tuple[str, ...]) -> str | None:
    return _any([f"contains(lower({on}), lower({lit(w)}))" for w in words])


def _target(text: str, pattern: Pattern, kind: str | None) -> str:
    """What an allow-list is tested on: the whole text, the match, or the line it starts on."""
    span = f"leaksieve_span({text}, {lit(pattern.python)}, 0)"
    if kind in ("match", "secret"):
        return f"coalesce({span}.text, '')" if pattern.nests else f"regexp_extract({text}, {lit(pattern.java)}, 0)"
    if kind == "line":
        tail = f"regexp_extract({text}, {lit(rx.tail_form(pattern.java))}, 0)"
        begin = f"coalesce({span}.begin, 0)" if pattern.nests else f"length({text}) - length({tail})"
        prefix = f"substring({text}, 1, {begin})"
        return f"element_at(split({text}, '\\n', -1), size(split({prefix}, '\\n', -1)))"
    return text


def _suppressed(
    rules: RuleSet, rule: Rule, pattern: Pattern, opens: str | None, text: str, url: str, options: MatchOptions
) -> str | None:
    """True where one of the rule's allow-lists is found anywhere in the text."""
    tests: list[str | None] = []
    for allow in rule.allowlists:
        if allow.applied or options.regex_target:
            on = _target(text, pattern, allow.regex_target if options.regex_target else None)
            tests.append(_any_rlike(on, rules.compile_all(allow.regexes), opens))
        if options.allowlist_paths:
            tests.append(_any_rlike(url, rules.compile_all(allow.paths), opens))
        if options.stopword_filter:
            tests.append(_any_contains(_target(text, pattern, "match"), allow.stopwords))
    return _any([t for t in tests if t])


def _accepts(
    rules: RuleSet, rule: Rule, pattern: Pattern, opens: str | None, text: str, url: str, options: MatchOptions
) -> str:
    """Whether the rule applies to the text and is not suppressed, cheap tests first."""
    tests = [opens]
    if options.path_filter and rule.path:
        tests.append(_any_rlike(url, rules.compile_all([rule.path]), opens) or "false")
    if options.keyword_prefilter and rule.keywords:
        tests.append(_any_contains(text, rule.keywords))
    tests.append(_search(text, pattern, opens))
    if suppressed := _suppressed(rules, rule, pattern, opens, text, url, options):
        tests.append(f"NOT {suppressed}")
    return " AND ".join(t for t in tests if t)


def _gated(texts: DataFrame, patterns: list[Pattern], text_col: str, gate: bool) -> tuple[DataFrame, rx.Gate]:
    """Find all required literals in one pass over each text.

    The result is a column of its own because every rule refers to it; Catalyst keeps it below
    the rule chain and evaluates it once per row.
    """
    required = {i: p.literals for i, p in enumerate(patterns) if p.java is not None}
    built = rx.build_gate(required if gate else {})
    if built.pattern is None:
        return texts, built
    return texts.withColumn(_FOUND, built.found(F.col(text_col))), built


def _branches(
    rules: RuleSet, patterns: list[Pattern], gate: rx.Gate, text: str, url: str, options: MatchOptions
) -> list[tuple[int, str]]:
    return [
        (i, _accepts(rules, rule, pattern, gate.opens(i, _FOUND), f"`{text}`", url, options))
        for i, (rule, pattern) in enumerate(zip(rules.rules, patterns))
        if pattern.java is not None
    ]


def _prepare(texts: DataFrame, rules: RuleSet) -> None:
    if rules.nests():
        rx.register_python_search(texts.sparkSession)


def has_leak(texts: DataFrame, rules: RuleSet, text_col: str = "text", gate: bool = True) -> DataFrame:
    """Add ``has_leak``: some live rule is found and not suppressed.

    The flag comes out of a generator, like the matches below: a filter on it stays above the chain.
    """
    patterns = rules.compiled()
    _prepare(texts, rules)
    gated, built = _gated(texts, patterns, text_col, gate)
    branches = _branches(rules, patterns, built, text_col, "''", MatchOptions())
    marked = _first_accepting(gated, branches)
    return marked.withColumn("has_leak", F.explode(F.array(F.col(_ORD).isNotNull()))).drop(_FOUND, _ORD)


def first_match_rule(
    texts: DataFrame,
    rules: RuleSet,
    options: MatchOptions = MatchOptions(),
    text_col: str = "text",
    gate: bool = True,
) -> DataFrame:
    """Keep the texts that some rule accepts, with the lowest accepting ``rule_ord``.

    ``CASE`` stops at the first accepting rule, and a suppressed rule lets the next one try.
    Dropping the other texts goes through ``explode`` on purpose: a filter on ``rule_ord`` would be
    pushed below the projection and the whole chain evaluated twice.
    """
    patterns = rules.compiled()
    _prepare(texts, rules)
    url = "`url`" if "url" in texts.columns else "''"
    gated, built = _gated(texts, patterns, text_col, gate)
    branches = _branches(rules, patterns, built, text_col, url, options)
    kept = _first_accepting(gated, branches).withColumn(
        "rule_ord", F.explode(F.array_compact(F.array(_ORD)))
    )
    rule = F.element_at(_rule_constants(rules, patterns), F.col("rule_ord") + 1)
    return kept.drop(_FOUND, _ORD).withColumn("_rule", rule)


def _first_accepting(texts: DataFrame, branches: list[tuple[int, str]]) -> DataFrame:
    """Add the number of the first condition that holds, or null.

    A long chain is laid out over several projections, each skipped once a rule was found. Spark
    compiles one method per projection, and only short methods are taken up by the JIT.
    """
    if not branches:
        return texts.withColumn(_ORD, F.lit(None).cast("int"))
    for start in range(0, len(branches), _CHAIN):
        cases = " ".join(f"WHEN {c} THEN {i}" for i, c in branches[start : start + _CHAIN])
        part = f"CASE {cases} END"
        if start:
            part = f"CASE WHEN {_ORD} IS NOT NULL THEN {_ORD} ELSE {part} END"
        texts = texts.withColumn(_ORD, F.expr(part))
    return texts


def _rule_constants(rules: RuleSet, patterns: list[Pattern]) -> Column:
    """The rules as one constant array, indexed by ``rule_ord``; folded when the plan is optimised."""
    rows = [
        {
            "id": r.id,
            "description": r.description,
            "regex": r.regex,
            "java": p.java,
            "tail": rx.tail_form(p.java) if p.java else None,
            "groups": p.groups,
            "example": tx.REDACTED if r.example is None else r.example,
            "entropy": r.entropy,
            "secret_group": r.secret_group or 0,
            "python": p.python,
            "nests": p.nests,
        }
        for r, p in zip(rules.rules, patterns)
    ]
    return F.from_json(F.lit(json.dumps(rows)), _RULE_CONSTANTS)


def match_span(matched: DataFrame, text_col: str = "text", rules: RuleSet | None = None) -> DataFrame:
    """Add ``begin`` and ``end`` of the first match, in characters.

    The text from the match on, and the text after it, are cut off by the pattern itself; lengths
    then count code points. Searching for the secret's text would find earlier look-alikes. Matches of
    patterns that Python has to run get their span from it; ``rules`` tells whether there are such.
    """
    text = F.col(text_col)
    if rules is not None and not rules.nests():
        plain, nests = text, None
    else:
        nests = F.coalesce("_rule.nests", F.lit(False))
        plain = F.when(~nests, text)
    from_match = tx.regex_group(plain, F.col("_rule.tail"), 0)
    after = tx.regex_group(plain, F.col("_rule.tail"), F.col("_rule.groups") + 1)
    begin, end = F.length(text) - F.length(from_match), F.length(text) - F.length(after)
    if nests is None:
        return matched.withColumn("begin", begin).withColumn("end", end)
    span = rx.python_span(F.when(nests, text), F.col("_rule.python"), F.lit(0))
    spanned = matched.withColumn("_span", span)
    return (
        spanned.withColumn("begin", F.coalesce("_span.begin", begin))
        .withColumn("end", F.coalesce("_span.end", end))
        .drop("_span")
    )


def extract_secret(matched: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secret``: the whole first match."""
    return matched.withColumn("secret", tx.cut(F.col(text_col), F.col("begin"), F.col("end")))


def line_number(matched: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the 1-based ``line_number`` of the match's start."""
    prefix = tx.cut(F.col(text_col), F.lit(0), F.col("begin"))
    return matched.withColumn("line_number", tx.count_of(prefix, "\n") + 1)


def redact_window(matched: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``sanitized_secret``: the surroundings with the secret blanked."""
    window = tx.window_around(F.col(text_col), F.col("begin"), F.col("end"), tx.WINDOW, F.lit(tx.REDACTED))
    return matched.withColumn("sanitized_secret", window)


def snippet_window(matched: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``snippet_text``: the surroundings with the secret in clear."""
    window = tx.window_around(F.col(text_col), F.col("begin"), F.col("end"), tx.WINDOW, F.col("secret"))
    return matched.withColumn("snippet_text", window)


def mock_secret(matched: DataFrame, text_col: str = "text", options: MatchOptions = MatchOptions()) -> DataFrame:
    """Add ``mocked_secret``: the text with every copy of the secret replaced by the rule's example.

    A result longer than ``mock_limit``, or one that still shows the secret, shrinks to a window around the match.
    """
    text, example = F.col(text_col), F.col("_rule.example")
    whole = F.replace(text, F.col("secret"), example)
    begin, end = F.col("begin"), F.col("end")
    window = F.when(
        example == "", tx.window_around(text, begin, end, tx.WINDOW, F.lit(tx.REDACTED))
    ).otherwise(tx.window_around(text, begin, end, options.mock_window, example))
    too_long = F.lit(False) if options.mock_limit is None else F.length("_whole") > options.mock_limit
    shows = tx.contains_ignore_case(F.col("_whole"), F.col("secret"))
    return (
        matched.withColumn("_whole", whole)
        .withColumn("mocked_secret", F.when(too_long | shows, window).otherwise(F.col("_whole")))
        .drop("_whole")
    )


def secret_group(matched: DataFrame, text_col: str = "text") -> DataFrame:
    """Narrow ``secret`` and its span to the rule's capture group, where it names one that took part.

    The span is the group's own, from Python's engine: looking for the group's text inside the match would
    find earlier copies. Only matches of rules with a group are searched again.
    """
    group = F.col("_rule.secret_group")
    text = F.when(group > 0, F.col(text_col))
    narrowed = matched.withColumn("_span", rx.python_span(text, F.col("_rule.python"), group))
    known = F.col("_span.end") > F.col("_span.begin")
    narrowed = narrowed.withColumn("begin", F.when(known, F.col("_span.begin")).otherwise(F.col("begin")))
    narrowed = narrowed.withColumn("end", F.when(known, F.col("_span.end")).otherwise(F.col("end")))
    return extract_secret(narrowed.drop("_span"), text_col)


def entropy_filter(matched: DataFrame) -> DataFrame:
    """Drop matches whose secret is less random than the rule asks for."""
    threshold = F.col("_rule.entropy")
    return matched.where(threshold.isNull() | (tx.shannon_entropy(F.col("secret")) >= threshold))


def global_path_exclude(texts: DataFrame, rules: RuleSet) -> DataFrame:
    """Drop texts whose url matches a globally excluded path."""
    _prepare(texts, rules)
    hit = _any_rlike("`url`", rules.compile_all(rules.allowlist.paths))
    return texts if hit is None else texts.where(f"NOT coalesce({hit}, false)")


def global_regex_allowlist(matched: DataFrame, rules: RuleSet) -> DataFrame:
    """Drop matches whose secret matches a global allow-list pattern."""
    _prepare(matched, rules)
    hit = _any_rlike("secret", rules.compile_all(rules.allowlist.regexes))
    return matched if hit is None else matched.where(f"NOT {hit}")


def stopword_filter(matched: DataFrame, allowlist: Allowlist) -> DataFrame:
    """Drop matches whose secret contains a stop word."""
    hit = _any_contains("secret", allowlist.stopwords)
    return matched if hit is None else matched.where(f"NOT {hit}")


def scan_texts(
    texts: DataFrame,
    rules: RuleSet,
    options: MatchOptions = MatchOptions(),
    text_col: str = "text",
    gate: bool = True,
) -> DataFrame:
    """All of the above: at most one row per text, no shuffle.

    The text itself is dropped, the result carries the input's other columns.
    """
    if options.global_path_exclude and "url" in texts.columns:
        texts = global_path_exclude(texts, rules)
    m = first_match_rule(texts, rules, options, text_col, gate)
    m = extract_secret(match_span(m, text_col, rules), text_col)
    if options.secret_group:
        m = secret_group(m, text_col)
    if options.entropy_filter:
        m = entropy_filter(m)
    if options.global_regex_allowlist:
        m = global_regex_allowlist(m, rules)
    if options.stopword_filter:
        m = stopword_filter(m, rules.allowlist)
    for step in (line_number, redact_window, snippet_window):
        m = step(m, text_col)
    if options.mock_all:
        m = mock_all_secrets(m, rules, options.mock_limit, options.mock_window, text_col)
    else:
        m = mock_secret(m, text_col, options)
    return (
        m.withColumn("rule_id", F.col("_rule.id"))
        .withColumn("rule_description", F.col("_rule.description"))
        .withColumn("rule_regex", F.col("_rule.regex"))
        .drop("_rule", text_col)
    )
