"""Rules as data: loading, compiling, validating."""

from __future__ import annotations

import json
import os
import re
import tomllib
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leaksieve import schema
from leaksieve.functions import regex as rx

MAX_RULES = 10_000  # most rules unless told otherwise: they become part of the query plan
MAX_RULE_FILE_BYTES = 16 << 20  # largest rule file unless told otherwise: the driver reads it


@dataclass(frozen=True)
class Allowlist:
    regexes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    regex_target: str | None = None
    stopwords: tuple[str, ...] = ()
    # lists under the singular key ``allowlist`` are declared but not applied by default
    applied: bool = True


@dataclass(frozen=True)
class Rule:
    id: str
    regex: str
    description: str = ""
    example: str | None = None
    entropy: float | None = None
    keywords: tuple[str, ...] = ()
    path: str | None = None
    secret_group: int | None = None
    allowlists: tuple[Allowlist, ...] = ()


@dataclass(frozen=True)
class Pattern:
    """A pattern in the JVM's dialect, or the reason why it can never match."""

    java: str | None
    groups: int = 0
    literals: frozenset[str] | None = None
    reason: str = ""
    #: the pattern for Python's engine, and whether only that engine is safe on long texts
    python: str = ""
    nests: bool = False


@lru_cache(maxsize=4 * MAX_RULES)
def compile_pattern(regex: str, unicode_classes: bool = True) -> Pattern:
    """Hoist flags, check the pattern, translate it.

    A pattern that Python rejects is tried once more without ``(?i)``, ignoring case; if that
    fails as well it matches nothing, and the reason says so.
    """
    if not regex:
        return Pattern(None, reason="no regex")
    hoisted = rx.hoist_flags(regex)
    compiled, error = _python_compile(hoisted)
    if compiled is None:
        hoisted = "(?i)" + hoisted.replace("(?i)", "")
        compiled, _ = _python_compile(hoisted)
    if compiled is None:
        return Pattern(None, reason=f"invalid pattern: {error}")
    try:
        java = rx.java_form(hoisted, unicode_classes)
    except rx.UnsupportedPattern as error:
        return Pattern(None, reason=f"not supported: {error}")
    python = compiled.pattern if unicode_classes else "(?a)" + compiled.pattern
    return Pattern(java, compiled.groups, rx.required_literals(compiled.pattern), "", python, rx.may_nest(hoisted))


def _python_compile(pattern: str) -> tuple[re.Pattern | None, str]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)  # sets that may change meaning some day
        try:
            return re.compile(rx.python_form(pattern)), ""
        except (re.error, OverflowError, RecursionError) as error:
            return None, str(error)


@dataclass(frozen=True)
class RuleSet:
    """Rules in priority order."""

    rules: tuple[Rule, ...]
    allowlist: Allowlist = field(default_factory=Allowlist)  # global: declared, opt-in
    unicode_classes: bool = True

    def __len__(self) -> int:
        return len(self.rules)

    def compiled(self) -> list[Pattern]:
        return [compile_pattern(r.regex, self.unicode_classes) for r in self.rules]

    def compile_all(self, patterns: Iterable[str]) -> list[Pattern]:
        """Patterns of an allow-list; one that cannot compile never matches."""
        found = (compile_pattern(p, self.unicode_classes) for p in patterns)
        return [p for p in found if p.java is not None]

    def nests(self) -> bool:
        """Whether some pattern of the rules needs Python's engine."""
        lists = [a for r in self.rules for a in r.allowlists] + [self.allowlist]
        more = [p for a in lists for p in (*a.regexes, *a.paths)] + [r.path for r in self.rules if r.path]
        return any(p.nests for p in (*self.compiled(), *self.compile_all(more)))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The rule table, dead rules included with their reason."""
        rows = [
            (
                i, r.id, r.description, r.regex, r.example, r.entropy, list(r.keywords), r.path, r.secret_group,
                [(list(a.regexes), list(a.paths), a.regex_target, list(a.stopwords)) for a in r.allowlists],
                p.java, p.java is not None, p.reason,
            )
            for i, (r, p) in enumerate(zip(self.rules, self.compiled()))
        ]
        return spark.createDataFrame(rows, schema.RULES)

    @classmethod
    def from_dict(cls, data: Mapping, max_rules: int = MAX_RULES, **kwargs) -> RuleSet:
        """Rules from a parsed rule file; more than ``max_rules`` are an error."""
        if "rules" not in data:
            raise ValueError("a rule file needs a top-level list called 'rules'")
        rules = tuple(_rule(r) for r in data["rules"])
        if len(rules) > max_rules:
            raise ValueError(f"more than {max_rules} rules")
        return cls(rules, _allowlist(data.get("allowlist") or {}, False), **kwargs)

    @classmethod
    def from_df(cls, rules: DataFrame, max_rules: int = MAX_RULES, **kwargs) -> RuleSet:
        """Rules from a table with at least ``id`` and ``regex``; ``rule_ord`` gives the order."""
        if "rule_ord" in rules.columns:
            rules = rules.orderBy("rule_ord")
        rows = rules.limit(max_rules + 1).collect()
        return cls.from_dict({"rules": [r.asDict(recursive=True) for r in rows]}, max_rules, **kwargs)


def _allowlist(data: Mapping, applied: bool) -> Allowlist:
    return Allowlist(
        tuple(data.get("regexes") or ()),
        tuple(data.get("paths") or ()),
        data.get("regexTarget") or data.get("regex_target"),
        tuple(data.get("stopwords") or ()),
        applied,
    )


def _rule(data: Mapping) -> Rule:
    lists = [_allowlist(a, True) for a in data.get("allowlists") or ()]
    if data.get("allowlist"):
        lists.append(_allowlist(data["allowlist"], False))
    group = data.get("secretGroup", data.get("secret_group"))
    entropy = data.get("entropy")
    return Rule(
        id=str(data.get("id") or ""),
        regex=data.get("regex") or "",
        description=data.get("description") or "",
        example=data.get("example"),
        entropy=None if entropy is None else float(entropy),
        keywords=tuple(data.get("keywords") or ()),
        path=data.get("path"),
        secret_group=None if group is None else int(group),
        allowlists=tuple(lists),
    )


def load_rules(
    spark: SparkSession,
    path: str,
    unicode_classes: bool = True,
    max_rules: int = MAX_RULES,
    max_bytes: int = MAX_RULE_FILE_BYTES,
) -> RuleSet:
    """Read a rule file: ``.yaml``, ``.json``, a ``.parquet`` table, or TOML for anything else.

    A file of more than ``max_bytes`` or ``max_rules`` is an error.
    """
    kind = path.rstrip("/").lower()
    if kind.endswith(".parquet"):
        return RuleSet.from_df(spark.read.parquet(path), max_rules, unicode_classes=unicode_classes)
    text = _read_small_file(spark, path, max_bytes)
    if kind.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:  # pragma: no cover
            raise RuntimeError("YAML rule files need the yaml package; use TOML, JSON or parquet") from error
        data = yaml.safe_load(text)
    elif kind.endswith(".json"):
        data = json.loads(text)
    else:
        data = tomllib.loads(text)
    return RuleSet.from_dict(data or {}, max_rules, unicode_classes=unicode_classes)


def _read_small_file(spark: SparkSession, path: str, max_bytes: int) -> str:
    if os.path.exists(path):
        if os.path.getsize(path) > max_bytes:
            raise ValueError("rule file too large")
        with open(path, encoding="utf-8") as f:
            return f.read()
    files = spark.read.format("binaryFile").load(path)
    row: Row = files.select("length").first()
    if row.length > max_bytes:
        raise ValueError("rule file too large")
    return bytes(files.select("content").first().content).decode("utf-8")


def compile_rules(rules: DataFrame, unicode_classes: bool = True) -> DataFrame:
    """Add ``pattern``, ``live``, ``reason`` and ``python`` to a rule table of any size; each distinct pattern is compiled once."""

    @F.pandas_udf("pattern string, reason string, python string")
    def compiled(patterns: pd.Series) -> pd.DataFrame:
        out = [compile_pattern(p or "", unicode_classes) for p in patterns]
        return pd.DataFrame({"pattern": [o.java for o in out], "reason": [o.reason for o in out], "python": [o.python for o in out]})

    known = rules.select(F.coalesce("regex", F.lit("")).alias("_regex")).distinct()
    known = known.withColumn("_c", compiled("_regex"))
    joined = rules.join(known, F.coalesce(rules["regex"], F.lit("")) == known["_regex"])
    return (
        joined.withColumn("pattern", F.col("_c.pattern"))
        .withColumn("live", F.col("_c.pattern").isNotNull())
        .withColumn("reason", F.col("_c.reason"))
        .withColumn("python", F.col("_c.python"))
        .drop("_c", "_regex")
    )


def load_patterns(rules: DataFrame, unicode_classes: bool = True, max_patterns: int = MAX_RULES) -> DataFrame:
    """Add ``pattern``, ``live`` and ``reason`` to a rule table, translated once and for all where it is loaded.

    The distinct patterns, at most ``max_patterns`` of them, are translated on the driver and checked by the JVM's own engine;
    what is planned on the result needs no Python. For more patterns there is :func:`compile_rules`.
    """
    spark = rules.sparkSession
    rows = rules.select(F.coalesce("regex", F.lit("")).alias("r")).distinct().limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns")
    known = []
    for row in rows:
        pattern = compile_pattern(row.r, unicode_classes)
        error = _jvm_error(spark, pattern.java)
        known.append((row.r, None, f"not supported: {error}") if error else (row.r, pattern.java, pattern.reason))
    table = spark.createDataFrame(known, "_regex string, pattern string, reason string")
    rest = rules.drop("pattern", "live", "reason")
    joined = rest.join(table, F.coalesce(rest["regex"], F.lit("")) == table["_regex"], "left").drop("_regex")
    return joined.withColumn("live", F.col("pattern").isNotNull())


def _jvm_error(spark: SparkSession, java: str | None) -> str | None:
    """Why the JVM's engine does not take a pattern."""
    if java is None:
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError as error:
        return str(error.java_exception.getMessage()).split("\n")[0]
    return None


def validate_rules(rules: DataFrame | RuleSet, max_patterns: int = MAX_RULES) -> DataFrame:
    """(rule_id, status, detail): every rule needs a regex and an example that it matches.

    Built-in functions over a table whose patterns were translated on load; the example is searched only for live patterns.
    """
    if isinstance(rules, RuleSet):
        spark = SparkSession.active()
        rules = rules.to_df(spark)
    table = rules if {"pattern", "live", "reason"} <= set(rules.columns) else load_patterns(rules, max_patterns=max_patterns)
    missing = (F.coalesce("regex", F.lit("")) == "") | (F.coalesce("example", F.lit("")) == "")
    status = (
        F.when(missing, "missing")
        .when(~F.col("live"), "invalid")
        .when(F.rlike(F.col("example"), F.col("pattern")), "ok")
        .otherwise("mismatch")
    )
    detail = (
        F.when(F.col("status") == "missing", "missing regex or example")
        .when(F.col("status") == "invalid", F.col("reason"))
        .when(F.col("status") == "mismatch", "example does not match the regex")
        .otherwise("")
    )
    return table.withColumn("status", status).select(F.col("id").alias("rule_id"), "status", detail.alias("detail"))
