"""Whole scans: content tables in, findings, sensitive findings and outbox out."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.operators import comments as cm
from leaksieve.operators import findings as fi
from leaksieve.operators import flatten as fl
from leaksieve.operators import scope as sc
from leaksieve.operators import tree as tr
from leaksieve.operators.matching import scan_texts
from leaksieve.operators.rules import RuleSet
from leaksieve.options import ScanOptions
from leaksieve.session import materialise
from leaksieve.sources.files import read_text_files
from leaksieve.sources.trackers import norm_zendesk
from leaksieve.sources.union import COMMENTS, PLATFORMS, empty_tickets, platform_key


def match_content(
    tickets: DataFrame, comments: DataFrame | None, rules: RuleSet, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Matches in all texts of the tickets.

    Comments are scanned where they lie and only their matches look up the ticket's url: the
    texts themselves are never shuffled. Rules limited to paths need the url beforehand.
    """
    comments = fl.skip_comments(comments, options.skip_comment) if comments is not None else None
    spread = lambda t: t.repartition(options.tasks) if options.tasks else t
    m = options.match
    needs_url = m.path_filter or m.allowlist_paths or m.global_path_exclude
    label = options.config_label
    if comments is None or needs_url:
        texts = fl.drop_labelled_text(fl.flatten_fields(tickets, comments), label)
        return scan_texts(spread(texts), rules, m)
    own = scan_texts(spread(fl.drop_labelled_text(fl.flatten_fields(tickets), label)), rules, m)
    texts = comments.where(F.coalesce("text", F.lit("")) != "").select(
        *fl.KEY,
        F.lit("comments").alias("field"),
        F.lit(fl.FIELD_ORDER["comments"]).alias("field_ord"),
        F.col("item_ord").cast("bigint").alias("item_ord"),
        "text",
    )
    found = scan_texts(spread(fl.drop_labelled_text(texts, label)), rules, m)
    return own.unionByName(fl.lookup_tickets(found, tickets, "url"))


@dataclass(frozen=True)
class Scan:
    """The lazy results of one scan."""

    tickets: DataFrame
    comments: DataFrame | None
    matches: DataFrame
    options: ScanOptions

    def materialise(self, path: str | None = None) -> Scan:
        """Run the match once and keep its rows, so that several results share one pass.

        The rows hold raw secrets: the folder, by default below ``spark.checkpoint.dir``, has to be
        a restricted one.
        """
        return replace(self, matches=materialise(self.matches, "matches", path))

    @property
    def findings(self) -> DataFrame:
        built = fi.build_findings(self.matches, self.options.show_matched_secret)
        return fi.dedup_findings(built)

    @property
    def sensitive_findings(self) -> DataFrame:
        return fi.sensitive_findings(self.matches, self.options.show_matched_secret)

    @property
    def outbox(self) -> DataFrame:
        rows = cm.comment_outbox(self.matches, self.tickets, self.comments, self.options)
        return cm.encode_comment(rows, self.options.jira_cloud)


def scan(
    tickets: DataFrame,
    comments: DataFrame | None,
    rules: RuleSet,
    options: ScanOptions = ScanOptions(),
) -> Scan:
    """Plan a scan. Nothing runs until a result is written or collected.

    With ``skip_comment`` no comment is seen at all, so none can say that a ticket was warned before.
    """
    comments = None if options.skip_comment else comments
    return Scan(tickets, comments, match_content(tickets, comments, rules, options), options)


def read_platform(
    spark: SparkSession,
    target: str,
    options: ScanOptions = ScanOptions(),
    export: DataFrame | None = None,
    scope_map: DataFrame | None = None,
) -> DataFrame:
    """The tickets of one platform that the options ask for.

    A query in ``options.scope`` is a predicate on the export's columns and falls back to everything
    if nothing satisfies it. ``scope_map`` lists containers by the export's column names, from the
    top, or for ``local`` files and directories as ``read_tree_map`` gives them; with a scope such as ``2/5`` only that part of
    the map is scanned.
    """
    key = platform_key(target)
    if key is None or (export is None and key != "local"):
        return empty_tickets(spark)
    if key == "local":
        export = read_text_files(spark, options.scan_path) if export is None else export
    if key in ("github", "gitlab"):
        export = sc.branch_filter(sc.owner_repo_filter(export, options.owner, options.repo), options.branch)
    if sc.scope_query(options.scope):
        export = sc.scope_filter_or_all(export, options.scope)
    elif scope_map is not None:
        tree = key == "local" and "kind" in scope_map.columns
        if part := re.fullmatch(r"(\d+)/(\d+)", options.scope or ""):
            scope_map = sc.scope_chunk(scope_map, int(part[1]), int(part[2]), ["path"] if tree else None)
        export = tr.tree_scope_join(export, scope_map, "url") if tree else sc.scope_semi_join(export, scope_map, scope_map.columns)
    if key == "zendesk":
        return norm_zendesk(export, options.server)
    return PLATFORMS[key][1](export)


def scan_platform(
    spark: SparkSession,
    target: str,
    rules: RuleSet,
    options: ScanOptions = ScanOptions(),
    export: DataFrame | None = None,
    comments: DataFrame | None = None,
    scope_map: DataFrame | None = None,
) -> Scan:
    """Plan the scan of one platform's exported records, or of a folder for ``local``."""
    tickets = read_platform(spark, target, options, export, scope_map)
    normalise = COMMENTS.get(platform_key(target) or "")
    notes = normalise(comments) if normalise and comments is not None else None
    if notes is not None and (scope_map is not None or sc.scope_query(options.scope)):
        # comments outside the scope are dropped before any rule is tried on them
        notes = notes.join(fl.by_comment_key(tickets).select(*fl.KEY).distinct(), list(fl.KEY), "left_semi")
    return scan(tickets, notes, rules, options)
