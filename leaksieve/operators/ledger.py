"""Repeated scans that do only new work.

A ledger remembers by the SHA-256 of a text which rule, in which version, it was that accepted the text, and what was
found. The rules before that one are known not to accept the text, those behind it were never tried. When the rules
change, or move, the same rule version is still known wherever it stands: of a known text only rules are tried that
are unknown for it, up to the first that accepts. A text that needs none is not even read again.

Each run writes a folder of its own, whose name replaces one of the same name, so a run that is repeated leaves the ledger as
it was. Rows hold raw secrets: the folder has to be a restricted one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators import matching as mt
from leaksieve.operators.rules import Rule, RuleSet
from leaksieve.options import MatchOptions

FOUND = (
    "begin int, end int, secret string, line_number int, sanitized_secret string, snippet_text string, mocked_secret string"
)
_ANSWERS = f"text_hash string, version string, rule_ord int, tried int, {FOUND}, run string"
_SETS = "version string, rule_ord int, rule_version string, run string"


def rule_version(rule: Rule, unicode_classes: bool = True) -> str:
    """A digest of all that a rule's finding depends on."""
    said = json.dumps([asdict(rule), unicode_classes], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()


def _digest(said: list[str]) -> str:
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def rule_versions(rules: RuleSet, options: MatchOptions) -> list[str]:
    """The versions of a set's rules; other options are other versions."""
    under = json.dumps(asdict(options), sort_keys=True)
    return [_digest([rule_version(r, rules.unicode_classes), under]) for r in rules.rules]


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Ledger:
    """``answers``: a row for each text and run; ``sets``: the rule versions of each set of rules."""

    path: str

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:  # the first run finds no folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], schema)

    def answers(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "answers", _ANSWERS)

    def sets(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "sets", _SETS)

    def write(self, spark: SparkSession, run: str, version: str, rules: list[str], answers: DataFrame) -> None:
        """Add a run; the rules come first, so that no answer is ever without them."""
        known = [(version, n, rule) for n, rule in enumerate(rules)]
        sets = spark.createDataFrame(known, "version string, rule_ord int, rule_version string")
        sets.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sets/run={run}")
        answers.write.mode("overwrite").parquet(f"{self.path}/answers/run={run}")


@dataclass(frozen=True)
class _Work:
    """What is left to do for a text whose answer by some version was ``k`` (none: no rule accepted it)."""

    version: str
    k: int | None
    yes: int | None  # the rule that is known to accept
    unknown: list[int]  # rules that have to be tried before it

    @property
    def settled(self) -> bool:
        return not any(self.yes is None or n < self.yes for n in self.unknown)


def work_table(sets: dict[str, list[str]], own: list[str]) -> list[_Work]:
    """For each earlier set of rules and each of its answers. Rules of equal text share a version; the first one counts."""
    out = []
    for version, old in sets.items():
        place: dict[str, int] = {}
        for n, rule in enumerate(old):
            place.setdefault(rule, n)
        for k in [None, *range(len(old))]:
            unknown, yes = [], None
            for n, rule in enumerate(own):
                at = place.get(rule)
                if at is None or (k is not None and at > k):
                    unknown.append(n)
                elif at == k and yes is None:
                    yes = n
            out.append(_Work(version, k, yes, [n for n in unknown if yes is None or n < yes]))
    return out


def _sets_of(ledger: Ledger, spark: SparkSession) -> dict[str, list[str]]:
    rows = ledger.sets(spark).select("version", "rule_ord", "rule_version").distinct().orderBy("version", "rule_ord").collect()
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row.version, []).append(row.rule_version)
    return out


def scan_new(
    texts: DataFrame,
    rules: RuleSet,
    ledger: Ledger,
    options: MatchOptions = MatchOptions(),
    run: str | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Matches of all texts, as ``scan_texts`` has them; only what the ledger does not know is searched.

    Equal texts are searched once, whatever their places. Rules that depend on a text's place cannot be known by the text alone:
    ``path_filter``, ``allowlist_paths`` and ``global_path_exclude`` are errors, as are filters of matches, which can be applied to
    the result.
    """
    if options.path_filter or options.allowlist_paths or options.global_path_exclude:
        raise ValueError("a text's ledger entry cannot depend on its path")
    if options.entropy_filter or options.global_regex_allowlist or options.stopword_filter:
        raise ValueError("filters of matches belong behind the ledger")
    spark = texts.sparkSession
    run = run or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    own = rule_versions(rules, options)
    version, sets = _digest(own), _sets_of(ledger, spark)

    keyed = texts.where(F.col(text_col).isNotNull()).withColumn("text_hash", text_hash(F.col(text_col)))
    hashes = keyed.select("text_hash").distinct()
    answers = ledger.answers(spark).join(hashes, "text_hash", "left_semi")
    rest = [c for c in answers.columns if c not in ("text_hash", "run")]
    best = F.max(F.struct((F.col("version") == version).alias("own"), "run", F.struct(*rest).alias("a")))
    latest = answers.groupBy("text_hash").agg(best["a"].alias("a")).select("text_hash", "a.*")
    plan = [(w.version, -1 if w.k is None else w.k, w.yes, w.unknown, w.settled) for w in work_table(sets, own)]
    work = spark.createDataFrame(plan, "_v string, _k int, _yes int, _unknown array<int>, _settled boolean")  # a row for each rule of each set
    known = latest.join(F.broadcast(work), (F.col("version") == F.col("_v")) & (F.coalesce("rule_ord", F.lit(-1)) == F.col("_k")))
    fields = [c for c in answers.columns if c not in ("text_hash", "version", "rule_ord", "tried", "run")]
    carried = known.where(F.col("_settled") & (F.col("version") != version)).select(
        "text_hash", F.lit(version).alias("version"), F.col("_yes").alias("rule_ord"), F.lit(0).alias("tried"), *fields
    )

    done = known.where("_settled").select("text_hash")
    todo = hashes.join(done, "text_hash", "left_anti").join(known.select("text_hash", "_yes", "_unknown"), "text_hash", "left")
    left = keyed.select("text_hash", F.col(text_col).alias("text")).join(todo, "text_hash")
    left = left.groupBy("text_hash").agg(F.first("text").alias("text"), F.first("_yes").alias("_yes"), F.first("_unknown").alias("_unknown"))
    ledger.write(spark, run, version, own, _searched(left, rules, options, version, fields).unionByName(carried))

    current = ledger.answers(spark).where(F.col("version") == version).join(hashes, "text_hash", "left_semi")
    current = current.groupBy("text_hash").agg(F.max(F.struct("run", "rule_ord", *fields)).alias("a"))
    current = current.select("text_hash", "a.rule_ord", *[f"a.{c}" for c in fields]).where("rule_ord IS NOT NULL")
    rule = F.element_at(mt._rule_constants(rules, rules.compiled()), F.col("rule_ord") + 1)
    found = keyed.drop(text_col).join(current, "text_hash").withColumn("_rule", rule)
    return (
        found.withColumn("rule_id", F.col("_rule.id"))
        .withColumn("rule_description", F.col("_rule.description"))
        .withColumn("rule_regex", F.col("_rule.regex"))
        .drop("_rule", "text_hash")
    )


def _searched(left: DataFrame, rules: RuleSet, options: MatchOptions, version: str, fields: list[str]) -> DataFrame:
    """Answers for texts with rules to try: ``_unknown`` ones, all where that is null, up to the one known to accept."""
    patterns = rules.compiled()
    mt._prepare(left, rules)
    gated, gate = mt._gated(left, patterns, "text", True)
    branches = []
    for number, condition in mt._branches(rules, patterns, gate, "text", "''", options):
        known = f"WHEN _yes = {number} THEN true WHEN NOT array_contains(_unknown, {number}) THEN false"
        branches.append((number, f"CASE {known} ELSE coalesce({condition}, false) END"))
    # a generator, so that nothing is pushed below the chain
    marked = mt._first_accepting(gated, branches).withColumn("rule_ord", F.explode(F.array(mt._ORD))).drop(mt._FOUND, mt._ORD)
    every = F.sequence(F.lit(0), F.lit(len(patterns) - 1)) if patterns else F.expr("cast(array() as array<int>)")
    stop = F.coalesce("rule_ord", F.lit(len(patterns)))
    tried = F.size(F.filter(F.coalesce("_unknown", every), lambda n: n <= stop))
    rule = F.element_at(mt._rule_constants(rules, patterns), F.col("rule_ord") + 1)
    m = marked.withColumn("tried", tried).withColumn("_rule", rule)
    m = mt.extract_secret(mt.match_span(m, "text", rules), "text")
    if options.secret_group:
        m = mt.secret_group(m, "text")
    for step in (mt.line_number, mt.redact_window, mt.snippet_window):
        m = step(m, "text")
    m = mt.mock_all_secrets(m, rules, options.mock_limit, options.mock_window) if options.mock_all else mt.mock_secret(m, "text", options)
    none = F.col("rule_ord").isNull()
    kinds = {f.name: f.dataType for f in m.schema}
    return m.select(
        "text_hash", F.lit(version).alias("version"), "rule_ord", "tried",
        *[F.when(~none, F.col(c)).cast(_KINDS.get(c, kinds[c])).alias(c) for c in fields],
    )


_KINDS = {part.split()[0]: part.split()[1] for part in FOUND.split(", ")}
