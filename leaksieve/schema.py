"""Canonical table layouts, as DDL strings."""

from __future__ import annotations

RAW_DATA = (
    "struct<iid:string,channel_name:string,channel_id:string,is_channel:boolean,"
    "timestamp:string,slack_type:string>"
)

# One row per ticket, file or message. ``comment_ref`` is the id its comments know it by, where that
# is not ``issue_id``. Comments live in their own table (COMMENTS), so that a
# ticket with a huge discussion never becomes one huge row.
TICKETS = (
    "platform string, issue_id string, url string, title string, description string, "
    f"message string, file string, raw_data {RAW_DATA}, comment_ref string"
)
COMMENTS = "platform string, issue_id string, item_ord bigint, text string"

# One row per text to scan.
TEXTS = (
    "platform string, issue_id string, url string, field string, "
    "field_ord int, item_ord bigint, text string"
)

ALLOWLIST = "struct<regexes:array<string>,paths:array<string>,regex_target:string,stopwords:array<string>>"
RULES = (
    "rule_ord int, id string, description string, regex string, example string, entropy double, "
    f"keywords array<string>, path string, secret_group int, allowlists array<{ALLOWLIST}>, "
    "pattern string, live boolean, reason string"
)

FINDINGS = (
    "id string, url string, secret string, mocked_secret string, rule_id string, "
    "rule_description string, platform string, ticket_field string"
)
SCOPE_MAP = "platform string, l1 string, l2 string, l3 string, l4 string"
VERDICTS = "id string, status string, detail string"
TICKET_FIELDS = ("title", "description", "file", "message")


def column_names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    names, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            names.append(ddl[start:i].split()[0])
            start = i + 1
    return names
