"""Incremental scan of historical versions for secrets, by content address.

Every version of every path is addressed by the SHA-256 of its text. A text is scanned once per version of
a rule, however many paths and versions hold it; the ledger remembers which (text, rule version)
pairs are done, so a later run scans only new texts and, of old ones, only changed rules. Findings are
joined back to all paths. Everything is built-in Spark functions.

A rule's matches are leftmost and do not overlap. Spans come from the lengths of the matches and of the
pieces between them, as running sums, so each text is matched by the same engine twice at most
and only where it has a match at all.

Defined cases: a null text is the empty text; a null path is a path; repeated rows repeat their
findings; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.session import materialise


@dataclass(frozen=True)
class SecretRule:
    """``needs``: a literal that every match holds. ``group``/``shortest``: drop matches whose group is shorter."""

    kind: str
    pattern: str
    needs: str | None = None
    group: int = 0
    shortest: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order that breaks ties.
BASE = (
    SecretRule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        shortest=6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", "AKIA", shortest=20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
# Published token formats that the base kinds do not name.
MORE = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", "glpat-"),
    SecretRule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    SecretRule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "PRIVATE KEY-----"),
)
RULES = BASE + MORE


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def address(versions: DataFrame, path: Sequence[str], text: str = "text") -> DataFrame:
    """Every version of every path with the ``blob`` it holds, without its text."""
    return versions.select(*path, blob_id(F.col(text)).alias("blob"))


def _todo(blobs: DataFrame, rules: Sequence[SecretRule], ledger: DataFrame | None) -> DataFrame:
    """Texts with the rule versions still to run on them (``todo``); finished texts go."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    left = blobs.join(seen, "blob", "left")
    left = left.withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.expr("array()"))))
    return left.where(F.size("todo") > 0).drop("seen")


def scan_unseen(
    versions: DataFrame, rules: Sequence[SecretRule] = RULES, ledger: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """New ledger rows: ``blob, rules, spans``; ``rules`` are the rule versions run, also where nothing was found.

    ``spans`` are ``(start, end, rule)`` in code points, end exclusive, with the rule's version.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # equal ids mean equal texts: copies meet in each task first, and the text moves once
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), body.alias("_text"))
    blobs = _todo(blobs.groupBy("blob").agg(F.first("_text").alias("_text")), rules, ledger)

    hits = []
    for number, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.key) if ledger is not None else F.lit(True)
        if rule.needs:
            wanted = wanted & F.contains(F.col("_text"), F.lit(rule.needs))
        found = F.when(wanted, F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0)))
        hits.append(F.struct(F.lit(number).alias("ord"), found.alias("found")))
    # outer: a text without any match still becomes a ledger row
    some = F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0)
    rows = blobs.select("blob", "todo", "_text", F.explode_outer(some).alias("hit"))

    def by_rule(make) -> Column:
        chain = None
        for number, rule in enumerate(rules):
            value = make(rule)
            chain = F.when(F.col("hit.ord") == number, value) if chain is None else chain.when(F.col("hit.ord") == number, value)
        return chain

    def lengths(values: Column) -> Column:
        return F.transform(values, lambda v: F.char_length(v))

    rows = rows.select(
        "blob",
        "todo",
        F.col("hit.ord").alias("ord"),
        lengths(by_rule(lambda r: F.split("_text", r.pattern, -1))).alias("gaps"),
        lengths(F.col("hit.found")).alias("sizes"),
        lengths(
            by_rule(
                lambda r: F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col("hit.found")
            )
        ).alias("parts"),
    )
    rows = rows.select("blob", "todo", "ord", F.posexplode_outer(F.arrays_zip("gaps", "sizes", "parts")).alias("at", "m"))
    # both windows and the grouping below keep the partitioning by blob
    order = Window.partitionBy("blob", "ord").orderBy("at")
    end = F.sum(F.col("m.gaps") + F.coalesce("m.sizes", F.lit(0))).over(order)
    rows = rows.withColumn("end", end)
    least = F.element_at(F.array(*[F.lit(r.shortest) for r in rules]), F.col("ord") + 1)
    key = F.element_at(F.array(*[F.lit(r.key) for r in rules]), F.col("ord") + 1)
    span = F.struct((F.col("end") - F.col("m.sizes")).alias("start"), F.col("end").alias("end"), key.alias("rule"))
    good = F.col("m.sizes").isNotNull() & (F.col("m.parts") >= least)
    return rows.groupBy("blob").agg(
        F.first("todo").alias("rules"), F.collect_list(F.when(good, span)).alias("spans")
    )


def path_findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """Findings of all paths, from ledger rows of any number of runs; paths without one get an empty array.

    Findings of rule versions that are not in ``rules`` are left out. ``spans`` are ``(start, ord, end,
    kind)`` by start, then in the order of the rules.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
    current = F.filter("all", lambda s: F.array_contains(keys, s["rule"]))

    def named(s: Column) -> Column:
        ord_ = (F.array_position(keys, s["rule"]) - 1).cast("int")
        kind = F.element_at(kinds, F.array_position(keys, s["rule"]).cast("int"))
        return F.struct(s["start"].alias("start"), ord_.alias("ord"), s["end"].alias("end"), kind.alias("kind"))

    found = found.select("blob", F.sort_array(F.transform(current, named)).alias("spans"))
    joined = paths.join(found, "blob", "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string>>)")
    return joined.withColumn("spans", F.coalesce("spans", empty))


def secret_digest(found: DataFrame, path: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds and the listed spans of each path."""
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [
        F.size(F.filter("spans", lambda s: s["ord"] == F.lit(n))).cast("long").alias(f"n_{rule.kind}")
        for n, rule in enumerate(BASE)
    ]
    return found.select(*path, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Each document is a path with one version; the ledger starts empty and is stored before paths meet it."""
    ledger = materialise(scan_unseen(docs), "ledger")
    return secret_digest(path_findings(address(docs, ["doc_id"]), ledger))
