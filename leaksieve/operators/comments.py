"""Warning comments: text, who gets one, and each platform's encoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions import text as tx
from leaksieve.operators.flatten import KEY, flag_already_warned
from leaksieve.options import COMMENT_VARIABLES, ScanOptions

# Platforms comments can be posted to, and the stand-in Wrike needs for angle brackets.
COMMENT_PLATFORMS = ("jira", "confluence", "linear", "asana", "zendesk", "wrike", "slack")
WRIKE_REDACTED = "**********"


def finding_info() -> Column:
    """The block of a comment that describes the match."""
    rule = "############## Sanitized Secret Leak ##############"
    return F.concat(
        F.lit("Platform:["), F.col("platform"),
        F.lit("] Field:["), F.col("field"),
        F.lit("] ID:["), F.col("rule_id"),
        F.lit("] Description:["), F.col("rule_description"),
        F.lit("] Regex: "), F.col("rule_regex"),
        F.lit(f"\n{rule}\n "), F.col("sanitized_secret"), F.lit(f"\n{rule}"),
    )


def compose_comment(matches: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Add ``comment``: the filled template; variables it leaves out are appended by name."""
    template = options.message_template
    for name in COMMENT_VARIABLES:
        if name not in template:
            template += f"\n{name}: {{{name}}}"
    values: dict[str, Column] = {
        "finding_info": finding_info(),
        "bot_name": F.lit(options.bot_name),
        "secret_manager": F.lit(options.secret_manager),
        "contact_help": F.lit(options.contact_help),
        "label": F.lit(options.label),
    }
    pieces = re.split(r"\{(%s)\}" % "|".join(COMMENT_VARIABLES), template)
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    source = F.when(
        F.lower("platform") == "slack", F.concat(F.lit("\nLeak source: "), F.col("url"))
    ).otherwise("")
    return matches.withColumn("comment", F.concat(*parts, source))


def comment_outbox(
    matches: DataFrame, tickets: DataFrame, comments: DataFrame | None, options: ScanOptions
) -> DataFrame:
    """(platform, issue_id, url, comment) to post: one per match, none on tickets warned before."""
    rows = compose_comment(matches, options).select(*KEY, "url", "comment")
    if not options.post_comment:
        return rows.limit(0)
    if comments is None:
        return rows
    ids = tickets.select(*KEY, *[c for c in tickets.columns if c == "comment_ref"])
    warned = flag_already_warned(ids, comments, options.config_label).where("already_warned")
    return rows.join(warned.select(*KEY), KEY, "left_anti")


def _escape_html(col: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col


def _adf(comment: Column) -> Column:
    """The comment as a document in Jira's cloud format."""
    text = F.struct(F.lit("text").alias("type"), comment.alias("text"))
    paragraph = F.struct(F.lit("paragraph").alias("type"), F.array(text).alias("content"))
    document = F.struct(
        F.lit("doc").alias("type"), F.lit(1).alias("version"), F.array(paragraph).alias("content")
    )
    return F.to_json(F.struct(document.alias("body")))


def encode_comment(outbox: DataFrame, jira_cloud: bool = True) -> DataFrame:
    """Add ``payload``, ``channel_id`` and ``thread_ts``; rows that cannot be posted are dropped."""
    platform, comment = F.lower("platform"), F.col("comment")
    no_hash = F.replace(comment, F.lit("#"), F.lit("0"))
    wrike = F.replace(F.replace(comment, F.lit(tx.REDACTED), F.lit(WRIKE_REDACTED)), F.lit("\n"), F.lit("<br>"))
    payload = (
        F.when(platform == "jira", _adf(no_hash) if jira_cloud else no_hash)
        .when(platform == "confluence", _escape_html(no_hash))
        .when(platform == "wrike", wrike)
        .when(platform == "linear", F.replace(comment, F.lit("\n"), F.lit("\\n")))
        .otherwise(comment)
    )
    link = tx.parse_message_link(F.col("issue_id"))
    is_slack = platform == "slack"
    posted = outbox.where(platform.isin(*COMMENT_PLATFORMS)).withColumns(
        {
            "payload": payload,
            "channel_id": F.when(is_slack, link["channel_id"]).otherwise(""),
            "thread_ts": F.when(is_slack, link["thread_ts"]).otherwise(""),
        }
    )
    complete = (F.col("channel_id") != "") & (F.col("thread_ts") != "") & (F.col("comment") != "")
    return posted.where(~is_slack | complete)
