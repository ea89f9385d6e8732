"""One content table from several platforms."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from leaksieve import schema
from leaksieve.sources import files, trackers

# Platform names a scan can be asked for. ``name_scan`` means the same as ``name``.
PLATFORMS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "jira": ("Jira", trackers.norm_jira),
    "confluence": ("Confluence", trackers.norm_wiki),
    "linear": ("Linear", trackers.norm_linear),
    "local": ("LocalFilesystem", lambda tickets: tickets),
    "asana": ("Asana", trackers.norm_asana),
    "zendesk": ("Zendesk", trackers.norm_zendesk),
    "github": ("GitHub", files.norm_github),
    "gitlab": ("GitLab", files.norm_gitlab),
    "wrike": ("Wrike", trackers.norm_wrike),
    "slack": ("Slack", trackers.norm_chat),
}

COMMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "jira": trackers.norm_jira_comments,
    "confluence": trackers.norm_wiki_comments,
    "linear": trackers.norm_linear_comments,
    "asana": trackers.norm_asana_comments,
    "wrike": trackers.norm_wrike_comments,
    "zendesk": trackers.norm_zendesk_comments,
}


def platform_key(name: str) -> str | None:
    """Canonical name of a platform, ``None`` if unknown; no name at all means Jira."""
    key = name.removesuffix("_scan") or "jira"
    return key if key in PLATFORMS else None


def empty_tickets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.TICKETS)


def union_sources(
    spark: SparkSession,
    exports: Mapping[str, DataFrame],
    extra: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Normalise each platform's export and stack the results.

    ``extra`` registers normalisers for further platforms. An unknown platform adds no rows.
    """
    content = empty_tickets(spark)
    for name, export in exports.items():
        key = platform_key(name)
        if extra and name in extra:
            tickets = extra[name](export)
        elif key:
            tickets = PLATFORMS[key][1](export)
        else:
            continue
        known = [c for c in schema.column_names(schema.TICKETS) if c in tickets.columns]
        content = content.unionByName(tickets.select(*known), allowMissingColumns=True)
    return content
