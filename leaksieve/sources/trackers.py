"""Exports of trackers, wikis, help desks and chats as ticket and comment tables.

Every function shapes rows only; inputs are the platforms' exported records (README, "Inputs").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tickets(rows: DataFrame, platform: str, issue_id, url, title, description) -> DataFrame:
    return rows.select(
        F.lit(platform).alias("platform"),
        issue_id.cast("string").alias("issue_id"),
        url.alias("url"),
        title.alias("title"),
        description.alias("description"),
    )


def _comments(rows: DataFrame, platform: str, issue_id: Column, text: Column, order: str = "ord") -> DataFrame:
    return rows.select(
        F.lit(platform).alias("platform"),
        issue_id.cast("string").alias("issue_id"),
        F.col(order).cast("bigint").alias("item_ord"),
        text.alias("text"),
    )


def norm_jira(issues: DataFrame) -> DataFrame:
    """Issues are known by their key; comments point at the internal id, kept as ``comment_ref``."""
    base = F.coalesce(F.substring_index("self", "/rest/api", 1), F.lit(""))
    url = F.when(base != "", F.concat(base, F.lit("/browse/"), F.col("key"))).otherwise("")
    return issues.select(
        F.lit("Jira").alias("platform"),
        F.col("key").alias("issue_id"),
        url.alias("url"),
        F.col("summary").alias("title"),
        "description",
        F.col("id").cast("string").alias("comment_ref"),
    )


def norm_jira_comments(comments: DataFrame) -> DataFrame:
    return _comments(comments, "Jira", F.col("issue_id"), F.col("body"))


def norm_wiki(pages: DataFrame) -> DataFrame:
    """Wiki content of type page; the storage markup is scanned as it is."""
    only_pages = pages.where(F.lower("type") == "page")
    url = F.concat(F.coalesce("base", F.lit("")), F.coalesce("webui", F.lit("")))
    return _tickets(only_pages, "Confluence", F.col("id"), url, F.col("title"), F.col("storage_value"))


def norm_wiki_comments(comments: DataFrame) -> DataFrame:
    return _comments(comments, "Confluence", F.col("page_id"), F.col("storage_value"))


def _linear_nodes(responses: DataFrame) -> DataFrame:
    return responses.select(F.explode("data.issues.edges").alias("_e")).select("_e.node.*")


def norm_linear(responses: DataFrame) -> DataFrame:
    """Issues of the nested responses, one per edge."""
    nodes = _linear_nodes(responses)
    return _tickets(nodes, "Linear", F.col("identifier"), F.col("url"), F.col("title"), F.col("description"))


def norm_linear_comments(responses: DataFrame) -> DataFrame:
    """Non-empty comment bodies, numbered as they come."""
    nodes = _linear_nodes(responses).select("identifier", F.posexplode("comments.nodes").alias("ord", "_c"))
    rows = nodes.where(F.coalesce(F.col("_c.body"), F.lit("")) != "")
    return _comments(rows, "Linear", F.col("identifier"), F.col("_c.body"))


def norm_asana(tasks: DataFrame) -> DataFrame:
    return _tickets(tasks, "Asana", F.col("gid"), F.col("permalink_url"), F.col("name"), F.col("notes"))


def norm_asana_comments(stories: DataFrame) -> DataFrame:
    """Stories that are comments; the rest is the task's history."""
    comments = stories.where(F.lower("type") == "comment")
    return _comments(comments, "Asana", F.col("task_gid"), F.col("text"))


def norm_wrike(tasks: DataFrame) -> DataFrame:
    """Tasks; records without an id are dropped."""
    known = tasks.where(F.coalesce("id", F.lit("")) != "")
    return _tickets(known, "Wrike", F.col("id"), F.col("permalink"), F.col("title"), F.col("description"))


def norm_wrike_comments(comments: DataFrame) -> DataFrame:
    return _comments(comments, "Wrike", F.col("task_id"), F.col("text"))


def norm_zendesk(tickets: DataFrame, server: str = "") -> DataFrame:
    """Tickets; with a server name the url is the agent's view of the ticket."""
    view = F.concat(F.lit(f"https://{server}.zendesk.com/agent/tickets/"), F.col("id").cast("string"))
    url = view if server else F.col("url")
    return _tickets(tickets, "Zendesk", F.col("id"), url, F.col("subject"), F.col("description"))


def norm_zendesk_comments(comments: DataFrame) -> DataFrame:
    return _comments(comments, "Zendesk", F.col("ticket_id"), F.col("body"))


def norm_chat(messages: DataFrame) -> DataFrame:
    """Chat messages; the permalink is both url and id."""
    return messages.select(
        F.lit("Slack").alias("platform"),
        F.col("permalink").alias("issue_id"),
        F.col("permalink").alias("url"),
        F.col("text").alias("message"),
        F.struct(
            F.col("iid").alias("iid"),
            F.col("channel.name").alias("channel_name"),
            F.col("channel.id").alias("channel_id"),
            F.col("channel.is_channel").alias("is_channel"),
            F.col("ts").cast("string").alias("timestamp"),
            F.col("type").alias("slack_type"),
        ).alias("raw_data"),
    )
