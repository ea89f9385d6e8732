"""From matches to findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.ordered import as_of

# Platforms whose urls can point at a line.
LINE_PLATFORMS = ("github", "gitlab", "localfilesystem")
FINDING = ("id", "url", "secret", "mocked_secret", "rule_id", "rule_description", "platform", "ticket_field")
SEQ = ("platform", "issue_id", "field_ord", "item_ord")


def finding_id(matches: DataFrame) -> DataFrame:
    """Add ``id``: a digest of the plain url and the redacted window.

    Two secrets in equal surroundings at one url therefore share an id. A null url counts as empty.
    """
    url = F.coalesce("url", F.lit(""))
    return matches.withColumn("id", F.sha2(F.concat(url, F.lit("_"), F.col("sanitized_secret")), 256))


def source_url(url: Column, platform: Column, line: Column) -> Column:
    """The url with a line anchor, on platforms that have one."""
    anchored = F.lower(platform).isin(*LINE_PLATFORMS) & (line > 0)
    return F.when(anchored, F.concat(url, F.lit("#L"), line.cast("string"))).otherwise(url)


def reported_secret(show_matched_secret: bool = False) -> Column:
    """What a finding shows: the redacted window, or the clear one when asked for."""
    return F.col("snippet_text" if show_matched_secret else "sanitized_secret")


def build_findings(
    matches: DataFrame, show_matched_secret: bool = False, sensitive: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Finding records with their place in the scan order (``seq``); the raw secret only when asked for.

    ``keep`` names columns of the matches to carry along.
    """
    with_id = matches if "id" in matches.columns else finding_id(matches)
    seq = F.struct(*[F.col(c) if c in matches.columns else F.lit(0).alias(c) for c in SEQ]).alias("seq")
    columns = [
        F.col("id"),
        source_url(F.coalesce("url", F.lit("")), F.col("platform"), F.col("line_number")).alias("url"),
        reported_secret(show_matched_secret).alias("secret"),
        F.col("mocked_secret"),
        F.col("rule_id"),
        F.col("rule_description"),
        F.col("platform"),
        F.col("field").alias("ticket_field"),
        seq,
        *keep,
    ]
    if sensitive:
        columns.append(F.col("secret").alias("sensitive_secret"))
    return with_id.select(*columns)


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The first finding of each id in scan order.

    ``min_by`` reduces within each task first, so an id that fills a third of the input shuffles
    as one row per task.
    """
    rest = [c for c in findings.columns if c not in ("id", "seq")]
    first = F.min_by(F.struct(*rest), F.col("seq")).alias("_f")
    return findings.groupBy("id").agg(first).select("id", *[F.col(f"_f.{c}").alias(c) for c in rest])


def sensitive_findings(matches: DataFrame, show_matched_secret: bool = False) -> DataFrame:
    """Findings with the raw secret, for restricted storage."""
    return dedup_findings(build_findings(matches, show_matched_secret, sensitive=True))


def consolidate_platforms(findings: list[DataFrame]) -> DataFrame:
    """Findings per platform over several scans, with the grand total under ``all``."""
    together = reduce(lambda a, b: a.unionByName(b), [f.select("platform") for f in findings])
    return (
        together.rollup("platform")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("platform").alias("_total"))
        .select(F.when(F.col("_total") == 1, "all").otherwise(F.col("platform")).alias("platform"), "n")
    )


def count_findings(findings: DataFrame, *by: str) -> DataFrame:
    """Number of findings, in all or per rule, platform or field."""
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the outcome of an external check, where there is one.

    A verdict table may repeat an id; the smallest (status, detail) counts. Columns of a finding
    that the verdict table also has are replaced by its non-null values.
    """
    values = [c for c in verdicts.columns if c != "id"]
    one = verdicts.groupBy("id").agg(F.min(F.struct(*values)).alias("_v"))
    joined = findings.join(one, "id", "left")
    kept = [
        F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in findings.columns
    ]
    new = [F.col(f"_v.{c}").alias(c) for c in values if c not in findings.columns]
    return joined.select(*kept, *new)


def _with_verdict(findings: DataFrame, joined: DataFrame, values: list[str]) -> DataFrame:
    """Columns of findings, replaced by the verdict's values ``_v`` where it has them, and the verdict's other ones."""
    kept = [F.coalesce(F.col(f"_v.{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in findings.columns]
    return joined.select(*kept, *[F.col(f"_v.{c}").alias(c) for c in values if c not in findings.columns])


def apply_verdicts_at(findings: DataFrame, verdicts: DataFrame, when: str, at: str = "at") -> DataFrame:
    """Findings with their latest verdict up to a moment.

    ``verdicts`` has ``id``, the moment ``at`` and values. Of several for one moment the largest values count.
    """
    values = [c for c in verdicts.columns if c not in ("id", at)]
    kind = verdicts.schema[at].dataType
    known = verdicts.where(F.col(at) <= F.lit(when).cast(kind))
    latest = known.groupBy("id").agg(F.max(F.struct(at, F.struct(*values).alias("v")))["v"].alias("_v"))
    return _with_verdict(findings, findings.join(latest, "id", "left"), values)


def verdicts_as_of(findings: DataFrame, verdicts: DataFrame, ts: str = "ts", at: str = "at") -> DataFrame:
    """Findings of any time with the verdict that held then; null where there was none.

    An id with most of the findings, or of the verdicts, is spread over many tasks.
    """
    values = [c for c in verdicts.columns if c not in ("id", at)]
    history = verdicts.select("id", F.col(at).alias(ts), F.struct(*values).alias("_v"))
    return _with_verdict(findings, as_of(findings, history, "id", ts, ["_v"]), values)


def late_verdicts(findings: DataFrame, verdicts: DataFrame, since: str, ts: str = "ts", at: str = "at", seen: str = "seen") -> DataFrame:
    """Findings whose verdict is another one now, because of verdicts that were seen after ``since`` for an earlier time.

    The rows are corrections to what ``verdicts_as_of`` gave then: only ids with such verdicts are looked at again.
    """
    values = [c for c in verdicts.columns if c not in ("id", at, seen)]
    new = F.col(seen) > F.lit(since).cast(verdicts.schema[seen].dataType)
    ids = verdicts.where(new).select("id").distinct()
    rows, history = findings.join(ids, "id", "left_semi"), verdicts.join(ids, "id", "left_semi")

    def moments(table: DataFrame, name: str) -> DataFrame:
        return table.select("id", F.col(at).alias(ts), F.struct(*values).alias(name))

    before = as_of(rows, moments(history.where(~new | F.col(seen).isNull()), "_old"), "id", ts, ["_old"])
    both = as_of(before, moments(history, "_v"), "id", ts, ["_v"])
    changed = both.where(~F.col("_v").eqNullSafe(F.col("_old")))
    return _with_verdict(findings, changed, values)
