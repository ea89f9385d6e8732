"""Texts in which nothing is left that any rule would find.

All matches of all rules become spans, whether their rule was the first or not, allow-listed or not. A sweep over
the sorted spans joins those that overlap, and each stretch is replaced once. What is put side by side by that may be a match
again, so texts that were changed are searched once more; what is not settled in ``ROUNDS`` goes altogether.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions import regex as rx
from leaksieve.functions import text as tx
from leaksieve.operators.rules import RuleSet

ROUNDS = 3
_SPANS = "array<struct<begin:int,end:int>>"
_FOLDED = str.maketrans(*rx._FOLDED)


def find_spans(text: str | None, patterns: list[re.Pattern]) -> list[tuple[int, int]]:
    """All matches of all patterns, in characters; empty ones do not count."""
    if text is None:
        return []
    return sorted({m.span() for p in patterns for m in p.finditer(text) if m.end() > m.start()})


def _spans_of(patterns: list[str]):
    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, numbers):
            found = find_spans(text, [rx._compiled(patterns[n]) for n in some]) if some is not None and len(some) else []
            out.append([{"begin": a, "end": b} for a, b in found])
        return pd.Series(out, dtype=object)

    return spans


def settled(text: str, patterns: list[tuple[str, tuple[str, ...]]], mark: str, rounds: int) -> str:
    """A text in which nothing is found any more; ``patterns`` come with the literals that their matches need."""
    for turn in range(rounds):
        low = text.translate(_FOLDED).lower()
        some = [rx._compiled(p) for p, needs in patterns if not needs or any(x in low for x in needs)]
        spans = find_spans(text, some)
        if not spans:
            return text
        out, at = [], 0
        for begin, end in spans:
            if begin > at or not out:
                out += [text[at:begin], mark]
            at = max(at, end)
        text = "".join(out) + text[at:] if turn + 1 < rounds else mark
    return text


def _settled(patterns: list[tuple[str, tuple[str, ...]]], mark: str, rounds: int):
    @F.pandas_udf("string")
    def settle(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else settled(t, patterns, mark, rounds) for t in texts], dtype=object)

    return settle


def merge_spans(spans: Column) -> Column:
    """Sorted spans as stretches that neither overlap nor touch."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            F.coalesce(span["begin"] <= last["end"], F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(spans), F.expr(f"cast(array() as {_SPANS})"), add)


def replace_stretches(text: Column, stretches: Column, low: Column, high: Column, mark: str) -> Column:
    """The part ``[low, high)`` of a text with the mark in place of each stretch; a stretch across its border is replaced too."""
    inside = F.filter(stretches, lambda s: (s["end"] > low) & (s["begin"] < high))

    def piece(stretch: Column, k: Column) -> Column:
        since = F.when(k == 0, low).otherwise(F.get(inside, k - 1)["end"])
        return F.concat(tx.cut(text, since, F.greatest(stretch["begin"], since)), F.lit(mark))

    rest = F.when(F.size(inside) == 0, low).otherwise(F.least(F.try_element_at(inside, F.lit(-1))["end"], high))
    return F.concat(F.array_join(F.transform(inside, piece), ""), tx.cut(text, rest, high))


class Masker:
    """Spans and masks of one set of rules."""

    def __init__(self, rules: RuleSet, mark: str = tx.REDACTED):
        live = [p for p in rules.compiled() if p.java is not None]
        self.patterns = [p.python for p in live]
        self.needs = [(p.python, tuple(p.literals or ())) for p in live]
        self.gate = rx.build_gate({n: p.literals for n, p in enumerate(live)})
        # a mark that a rule finds would never go
        self.mark = "" if find_spans(mark, [rx._compiled(p) for p in self.patterns]) else mark
        self.spans = _spans_of(self.patterns)

    def with_stretches(self, frame: DataFrame, text: str, into: str) -> DataFrame:
        """Add the stretches to be replaced. Rules whose literals are not in the text are not tried."""
        frame = frame.withColumn("_found", self.gate.found(F.col(text)) if self.gate.pattern else F.lit(None).cast("array<string>"))
        tests = []
        for n in range(len(self.patterns)):
            opens = self.gate.opens(n, "_found")
            tests.append(f"CASE WHEN {opens} THEN {n} END" if opens else f"{n}")
        names = []
        for low in range(0, len(tests), 64):
            names.append(f"_n{low}")
            frame = frame.withColumn(names[-1], F.expr(f"array_compact(array({', '.join(tests[low : low + 64])}))"))
        numbers = F.concat(*names) if names else F.expr("cast(array() as array<int>)")
        frame = frame.withColumn(into, merge_spans(self.spans(F.col(text), numbers)))
        return frame.drop("_found", *names)

    def settle(self, frame: DataFrame, column: str, changed: Column, rounds: int = ROUNDS) -> DataFrame:
        """Search a masked column again where it was changed; what is never settled becomes the mark alone."""
        again = _settled(self.needs, self.mark, rounds)(F.when(changed, F.col(column)))
        return frame.withColumn(column, F.coalesce(again, F.col(column)))


def mask_secrets(texts: DataFrame, rules: RuleSet, text_col: str = "text", into: str = "masked_text", rounds: int = ROUNDS) -> DataFrame:
    """Add the text with every match of every rule replaced, so that no rule finds anything in it."""
    masker = Masker(rules)
    found = masker.with_stretches(texts, text_col, "_stretches")
    whole = replace_stretches(F.col(text_col), F.col("_stretches"), F.lit(0), F.length(text_col), masker.mark)
    return masker.settle(found.withColumn(into, whole), into, F.size("_stretches") > 0, rounds).drop("_stretches")


def mock_all_secrets(
    matched: DataFrame, rules: RuleSet, limit: int | None, window: int, text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """Add ``mocked_secret``: the masked text, or if that has more than ``limit`` characters what is around the match.

    Stretches are those of the whole text, so a secret at the window's border is not shown in part.
    """
    masker = Masker(rules)
    text, begin, end = F.col(text_col), F.col("begin"), F.col("end")
    found = masker.with_stretches(matched, text_col, "_stretches")
    own = F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))
    found = found.withColumn("_stretches", F.when(end > begin, merge_spans(F.concat("_stretches", F.array(own)))).otherwise(F.col("_stretches")))
    whole = replace_stretches(text, F.col("_stretches"), F.lit(0), F.length(text), masker.mark)
    part = replace_stretches(
        text, F.col("_stretches"), F.greatest(begin - window, F.lit(0)), F.least(end + window, F.length(text)), masker.mark
    )
    long = F.lit(False) if limit is None else F.length("_whole") > limit
    found = found.withColumn("_whole", whole).withColumn("mocked_secret", F.when(long, part).otherwise(F.col("_whole")))
    return masker.settle(found, "mocked_secret", F.size("_stretches") > 0, rounds).drop("_whole", "_stretches")
