"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

Statistics come from whole texts, in built-in functions. The list is grown and pruned on labelled rows: each
step is one aggregate that counts labels per feature and threshold, so the driver only ever sees a
table of ``features x thresholds`` counts. The result is a chain of conditional expressions, which is
applied to all rows without Python.

Defined cases: a null or empty text has no words; a null label is no label; a key labelled twice counts
with its smaller label; without labels, or labels of one kind, the list is empty and every row is kept;
extra columns are carried by none of the functions here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# shares and means that thresholds are learned on, as SQL over the statistics
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "marks_per_word": "n_marks / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "variety": "n_distinct / sqrt(n_words)",
    "words_per_line": "n_words / n_lines",
}


def text_stats(frame: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Per row: keys and counts of the whole text. Windows are compared by a 64-bit hash of their words' hashes."""
    body = F.coalesce(F.col(text), F.lit(""))

    def kept(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(body, pattern, "")).cast("long")

    rows = frame.select(
        *keys,
        F.array_remove(F.split(body, BLANKS, -1), "").alias("words"),
        F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        kept(r"[^\p{Lu}]+").alias("n_upper"),
        kept(r"[^0-9]+").alias("n_digits"),
        kept(r"[^!?]+").alias("n_marks"),
    )
    counts = ["n_symbols", "n_upper", "n_digits", "n_marks"]
    rows = rows.select(
        *keys,
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counts += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    last = F.col("n_words").cast("int") - WINDOW
    window = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    )
    none = F.expr("cast(array() as array<bigint>)")
    rows = rows.select(
        *keys,
        *counts,
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.when(last >= 0, window).otherwise(none).alias("windows"),
    )
    counts.append("n_distinct")
    # most texts repeat no window: only the others are sorted
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*keys, *counts, F.when(repeats, ranked).alias("ranked"))
    twin = F.filter(
        F.sequence(F.lit(0), F.size("ranked") - 1),
        lambda k: F.coalesce(F.get("ranked", k)["h"] == F.get("ranked", k - 1)["h"], F.lit(False))
        | F.coalesce(F.get("ranked", k)["h"] == F.get("ranked", k + 1)["h"], F.lit(False)),
    )
    at = F.sort_array(F.transform(twin, lambda k: F.get("ranked", k)["i"]))
    rows = rows.select(*keys, *counts, F.when(F.col("ranked").isNotNull(), at).alias("at"))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("at") - 1),
        F.lit(0),
        lambda total, k: total + F.coalesce(F.least(F.lit(WINDOW), F.get("at", k + 1) - F.get("at", k)), F.lit(WINDOW)),
    )
    n_repeat = F.when(F.col("at").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words")
    return rows.select(*keys, *counts, n_repeat)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature's value; 0 where it is undefined."""
    return F.coalesce(F.try_divide(*[F.expr(p) for p in FEATURES[name].split(" / ")]) if " / " in FEATURES[name] else F.expr(FEATURES[name]), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = feature(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for condition in self.conditions[1:]:
            out = out & condition.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules for the rejected class; what no rule takes is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def verdict(self) -> Column:
        """The number of the first rule that holds, null if none does."""
        chain = F.lit(None).cast("int")
        for number in reversed(range(len(self.rules))):
            chain = F.when(self.rules[number].column(), F.lit(number)).otherwise(chain)
        return chain


@dataclass(frozen=True)
class LearnOptions:
    """``most_labelled`` bounds the labelled rows a list is fitted on: those with the smallest key hashes."""

    most_labelled: int = 20_000
    bins: int = 24
    most_rules: int = 8
    most_conditions: int = 4
    least_covered: int = 3
    least_precision: float = 0.9


def learn(stats: DataFrame, labels: DataFrame, key: str, bad: Column, options: LearnOptions = LearnOptions()) -> DecisionList:
    """Fit a list that finds the rows of ``labels`` for which ``bad`` is true.

    Two thirds of the rows grow a rule condition by condition (by information gain of the covered rows), the
    others prune its last conditions and decide whether it is precise enough to stay. A threshold is then
    moved half way towards the covered rows of the class, away from what should be left alone.
    """
    marked = labels.select(F.col(key).alias("_key"), bad.alias("_bad")).where("_key is not null and _bad is not null")
    marked = marked.groupBy("_key").agg(F.max("_bad").alias("_bad"))
    marked = marked.orderBy(F.xxhash64("_key"), "_key").limit(options.most_labelled)
    values = F.array(*[feature(name) for name in FEATURES])
    rows = stats.join(marked, stats[key] == marked["_key"])
    rows = rows.select("_bad", (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(3)) < 2).alias("_grow"), values.alias("_v"))
    rows = materialise(rows, "labelled")
    names = list(FEATURES)
    steps = [(i + 1) / options.bins for i in range(options.bins - 1)]
    cuts = rows.select(
        *[F.array_distinct(F.percentile_approx(F.col("_v")[i], steps, 10_000)).alias(n) for i, n in enumerate(names)]
    ).first()
    cuts = [sorted(set(c or [])) for c in cuts] if cuts else []
    if not any(cuts):
        return DecisionList()
    # the number of cuts below a value: value > cuts[b] holds exactly if the bin is above b
    def bin_of(i: int) -> Column:
        return sum(((F.col("_v")[i] > float(c)).cast("int") for c in cuts[i]), F.lit(0))

    binned = F.array(*map(bin_of, range(len(names))))
    rows = materialise(rows.select("_bad", "_grow", "_v", binned.alias("_b")), "binned")

    def holds(test: tuple[int, bool, int]) -> Column:
        i, above, cut = test
        return F.col("_b")[i] > cut if above else F.col("_b")[i] <= cut

    def tally(subset: DataFrame) -> dict[tuple[int, int, bool], int]:
        counts = subset.select("_bad", F.posexplode("_b").alias("f", "b")).groupBy("f", "b", "_bad").count()
        return {(r.f, r.b, r._bad): r["count"] for r in counts.collect()}

    found: list[Rule] = []
    failed: set[tuple[int, bool]] = set()  # features whose rules were not precise enough start none again
    growing, pruning = rows.where("_grow"), rows.where("not _grow")
    while len(found) < options.most_rules:
        tests: list[tuple[int, bool, int]] = []
        subset = growing
        while len(tests) < options.most_conditions:
            best = _best_test(tally(subset), cuts, options.least_covered, set() if tests else failed)
            if best is None or best in tests:
                break
            tests.append(best)
            subset = subset.where(holds(best))
        if not tests:
            break
        size, bad_n, all_n = _prune(growing, pruning, tests, holds) or (0, 0, 0)
        if all_n < options.least_covered or bad_n / all_n < options.least_precision:
            failed.add(tests[0][:2])
            continue
        tests = tests[:size]
        covered = F.lit(True)
        for test in tests:
            covered = covered & holds(test)
        edges = growing.where(covered & F.col("_bad")).agg(
            *[(F.min if above else F.max)(F.col("_v")[i]).alias(f"e{k}") for k, (i, above, _) in enumerate(tests)]
        )
        edges = edges.first()
        conditions = tuple(
            Condition(names[i], above, (float(cuts[i][c]) + edges[k]) / 2) for k, (i, above, c) in enumerate(tests)
        )
        found.append(Rule(conditions, bad_n / all_n, all_n))
        growing, pruning = growing.where(~covered), pruning.where(~covered)
    return DecisionList(tuple(found))


def _best_test(counts: dict, cuts: list, least: int, without: set) -> tuple[int, bool, int] | None:
    """The condition with the largest gain: rows of the class it keeps times the bits it adds."""
    bad = sum(n for (f, _, is_bad), n in counts.items() if f == 0 and is_bad)
    good = sum(n for (f, _, is_bad), n in counts.items() if f == 0 and not is_bad)
    if not bad or not good:
        return None
    before, best, choice = math.log2(bad / (bad + good)), 1e-9, None
    for i, cs in enumerate(cuts):
        below = [0, 0]
        for c in range(len(cs)):
            for is_bad in (0, 1):
                below[is_bad] += counts.get((i, c, bool(is_bad)), 0)
            for above in (False, True):
                if (i, above) in without:
                    continue
                g, b = (good - below[0], bad - below[1]) if above else below
                if b >= least and (gain := b * (math.log2(b / (b + g)) - before)) > best:
                    best, choice = gain, (i, above, c)
    return choice


def _prune(growing: DataFrame, pruning: DataFrame, tests: list, holds) -> tuple[int, int, int] | None:
    """The most precise prefix of a conjunction: its length, and its hits and rows among the pruning rows.

    Precision on the pruning rows decides, then on the growing rows, then shortness.
    """
    sums, both = [], F.lit(True)
    for k, test in enumerate(tests):
        both = both & holds(test)
        sums += [F.count_if(both & F.col("_bad")).alias(f"b{k}"), F.count_if(both).alias(f"n{k}")]
    new, old = pruning.agg(*sums).first(), growing.agg(*sums).first()
    scored = [
        ((new[f"b{k}"] + 1) / (new[f"n{k}"] + 2), old[f"b{k}"] / max(1, old[f"n{k}"]), -k)
        for k in range(len(tests))
        if new[f"n{k}"]
    ]
    if not scored:
        return None
    k = -max(scored)[2]
    return k + 1, new[f"b{k}"], new[f"n{k}"]


def judge_documents(docs: DataFrame, labels: DataFrame, options: LearnOptions = LearnOptions()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule``.

    ``rule`` is the number of the learned rule that took the row, null if none did. Learns from ``quality``.
    """
    stats = materialise(text_stats(docs, ["doc_id"]), "stats")
    verdict = learn(stats, labels, "doc_id", F.col("quality") == 0, options).verdict()
    judged = stats.withColumns({"base_failed": base_failed(), "rule": verdict})
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", kept.alias("kept"), "rule")
