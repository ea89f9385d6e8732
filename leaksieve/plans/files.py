"""Scans of folders whose files may be larger than a row.

Small files are rows and go through the scan as they are. Large ones are read in pieces that overlap by what the rules
can look at, as told by their parse trees, so that a match that begins in a piece is found there just as in the
whole file. What a rule finds in any piece counts for the file: the first rule that is found and not allow-listed anywhere
in the file is the file's finding, at its first place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.functions import regex as rx
from leaksieve.functions import text as tx
from leaksieve.functions.reach import pattern_reach
from leaksieve.operators import matching as mt
from leaksieve.operators.flatten import FIELD_ORDER, flatten_fields
from leaksieve.operators.rules import Pattern, RuleSet
from leaksieve.options import MatchOptions
from leaksieve.session import materialise
from leaksieve.sources.files import read_text_files
from leaksieve.sources.ranges import PIECE, list_files, read_pieces

WHOLE = 64 << 20  # largest file that is one row
_HIT = "array<struct<item:int,begin:int,end:int,line:int,ahead:string,secret:string,behind:string>>"


@dataclass(frozen=True)
class Item:
    """A pattern that is looked for in pieces: a rule's own, or one of its allow-lists'."""

    rule: int
    pattern: Pattern
    allows: bool


@dataclass(frozen=True)
class Looked:
    """What can be looked for in pieces, how far it reaches, and the rules for which that is not known."""

    items: tuple[Item, ...]
    left: int
    right: int
    unbounded: tuple[int, ...]


def bounded_items(rules: RuleSet, longest_run: int | None = None) -> Looked:
    """Rules whose patterns, allow-lists included, have a bound on what they look at."""
    items, unbounded, left, right = [], [], 0, 0
    for number, (rule, pattern) in enumerate(zip(rules.rules, rules.compiled())):
        if pattern.java is None:
            continue
        lists = [p for a in rule.allowlists if a.applied for p in rules.compile_all(a.regexes)]
        reaches = [pattern_reach(p.python, longest_run) for p in (pattern, *lists)]
        if None in reaches:
            unbounded.append(number)
            continue
        left, right = max(left, *(r.left for r in reaches)), max(right, *(r.right for r in reaches))
        items += [Item(number, pattern, False), *(Item(number, p, True) for p in lists)]
    return Looked(tuple(items), left, right, tuple(unbounded))


def unbounded_rules(spark: SparkSession, rules: RuleSet, longest_run: int | None = None) -> DataFrame:
    """``rule_ord, rule_id``: the rules that large files are not searched for, because a match could be of any length."""
    rows = [(n, rules.rules[n].id) for n in bounded_items(rules, longest_run).unbounded]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string")


def _candidates(pieces: DataFrame, items: tuple[Item, ...]) -> DataFrame:
    """Add ``_items``: the numbers of patterns that are found somewhere in the piece's text."""
    gate = rx.build_gate({n: item.pattern.literals for n, item in enumerate(items)})
    if gate.pattern is not None:
        pieces = pieces.withColumn("_found", gate.found(F.col("text")))
    groups = []
    for low in range(0, len(items), mt._CHAIN):  # short methods, as in the rule chain
        tests = []
        for n, item in list(enumerate(items))[low : low + mt._CHAIN]:
            opens = gate.opens(n, "_found")
            search = mt._search("`text`", item.pattern, opens)
            tests.append(f"CASE WHEN {opens + ' AND ' if opens else ''}{search} THEN {n} END")
        name = f"_g{low}"
        pieces = pieces.withColumn(name, F.expr(f"array_compact(array({', '.join(tests)}))"))
        groups.append(name)
    found = F.concat(*groups) if groups else F.expr("cast(array() as array<int>)")
    return pieces.withColumn("_items", found).drop("_found", *groups)


def _first_hits(items: tuple[Item, ...], around: int):
    """A function that finds each candidate's first match that begins in the piece itself."""
    patterns = [item.pattern.python for item in items]

    @F.pandas_udf(_HIT)
    def hits(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        compiled: dict[int, re.Pattern] = {}
        for texts, numbers, befores, sizes, last in parts:
            out = []
            for text, items_, before, chars, ends in zip(texts, numbers, befores, sizes, last):
                rows = []
                for n in items_ if text is not None else ():
                    if n not in compiled:
                        compiled[n] = re.compile(patterns[n])
                    # looks behind see what is before the place, as in the whole file
                    m = compiled[n].search(text, int(before))
                    if m and (m.start() < before + chars or ends):
                        rows.append(
                            {
                                "item": int(n), "begin": m.start() - int(before), "end": m.end() - int(before),
                                "line": text.count("\n", int(before), m.start()),
                                "ahead": text[max(0, m.start() - around) : m.start()], "secret": m[0],
                                "behind": text[m.end() : m.end() + around],
                            }
                        )
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return hits


def scan_pieces(files: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions(), size: int = PIECE, longest_run: int | None = None) -> DataFrame:
    """Matches in large files ``path, length``, as ``scan_texts`` has them for files that are rows.

    Mocked texts are windows around the secret. Rules without a bound are not looked for, see :func:`unbounded_rules`.
    """
    if replace(options, mock_limit=None, mock_window=0) != MatchOptions(mock_limit=None, mock_window=0):
        raise ValueError("large files are searched with the default options only")
    spark = files.sparkSession
    looked = bounded_items(rules, longest_run)
    if any(item.pattern.nests for item in looked.items):
        rx.register_python_search(spark)
    around = max(options.mock_window, tx.WINDOW)
    pieces = read_pieces(files, looked.left + around, looked.right + around, size)
    pieces = _candidates(pieces, looked.items)
    some = F.when(F.size("_items") > 0, F.col("text"))
    hits = _first_hits(looked.items, around)(some, F.col("_items"), F.col("before"), F.col("chars"), F.col("last"))
    pieces = materialise(pieces.select("path", "piece", "valid", "chars", "lines", hits.alias("hits")), "pieces")

    # a row for each piece, without its text
    order = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_{c}") for c in ("chars", "lines")]
    broken = pieces.where("NOT valid").select("path").distinct()
    found = pieces.join(broken, "path", "left_anti").select("path", "piece", *sums, "hits").where(F.size("hits") > 0)
    found = found.select("path", "piece", "_chars", "_lines", F.explode("hits").alias("h"))
    first = found.groupBy("path", F.col("h.item").alias("item")).agg(F.min(F.struct("piece", "h.begin", "_chars", "_lines", "h")).alias("f"))

    def of(number: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(None)), number + 1)

    first = first.withColumn("rule_ord", of(F.col("item"), [i.rule for i in looked.items]).cast("int"))
    first = first.withColumn("_allows", of(F.col("item"), [i.allows for i in looked.items]).cast("boolean"))
    allowed = first.where("_allows").select("path", "rule_ord").distinct()
    own = first.where("NOT _allows").join(allowed, ["path", "rule_ord"], "left_anti")
    own = own.groupBy("path").agg(F.min(F.struct("rule_ord", "f")).alias("m")).select("path", "m.rule_ord", "m.f.*")

    url = F.regexp_replace("path", "^file:(//)?", "")
    rows = own.select(
        F.lit("LocalFilesystem").alias("platform"), url.alias("issue_id"), url.alias("url"), F.lit("file").alias("field"),
        F.lit(FIELD_ORDER["file"]).alias("field_ord"), F.lit(0).cast("bigint").alias("item_ord"), "rule_ord", "h",
        (F.col("_chars") + F.col("h.begin")).alias("_begin"), (F.col("_chars") + F.col("h.end")).alias("_end"),
        (F.col("_lines") + F.col("h.line") + 1).cast("int").alias("line_number"),
    )
    rows = rows.withColumn("_rule", F.element_at(mt._rule_constants(rules, rules.compiled()), F.col("rule_ord") + 1))
    rows = rows.withColumn("text", F.concat("h.ahead", "h.secret", "h.behind")).withColumn("secret", F.col("h.secret"))
    rows = rows.withColumn("begin", F.length("h.ahead")).withColumn("end", F.length("h.ahead") + F.length("h.secret"))
    for step in (mt.redact_window, mt.snippet_window):
        rows = step(rows)
    rows = mt.mock_secret(rows, options=replace(options, mock_limit=-1))
    return (
        rows.withColumn("rule_id", F.col("_rule.id"))
        .withColumn("rule_description", F.col("_rule.description"))
        .withColumn("rule_regex", F.col("_rule.regex"))
        .withColumn("begin", F.col("_begin"))
        .withColumn("end", F.col("_end"))
        .drop("_rule", "text", "h", "_begin", "_end")
    )


def scan_files(
    spark: SparkSession,
    path: str,
    rules: RuleSet,
    options: MatchOptions = MatchOptions(),
    pattern: str | None = None,
    whole: int = WHOLE,
    size: int = PIECE,
    longest_run: int | None = None,
) -> DataFrame:
    """Matches in all UTF-8 files below a path, of any size: those above ``whole`` bytes are read in pieces."""
    small = mt.scan_texts(flatten_fields(read_text_files(spark, path, pattern, whole)), rules, options)
    files = list_files(spark, path, pattern).where(F.col("length") > whole)
    large = scan_pieces(files, rules, replace(MatchOptions(), mock_limit=options.mock_limit, mock_window=options.mock_window), size, longest_run)
    small = small.withColumns({c: F.col(c).cast("bigint") for c in ("begin", "end")})  # places in a large file
    return small.unionByName(large.select(*small.columns))
