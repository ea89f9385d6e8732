"""From tickets and comments to one row per text, and the filters that come before matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions import text as tx

KEY = ["platform", "issue_id"]
# Fields of a ticket in reporting order; comments come between description and file.
FIELD_ORDER = {"title": 0, "description": 1, "comments": 2, "file": 3, "message": 4}


def by_comment_key(tickets: DataFrame, *columns: str) -> DataFrame:
    """Tickets under the key their comments use, with their own id as ``_own_id``."""
    ref = F.coalesce("comment_ref", "issue_id") if "comment_ref" in tickets.columns else F.col("issue_id")
    return tickets.select("platform", ref.alias("issue_id"), F.col("issue_id").alias("_own_id"), *columns)


def _own_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("issue_id", F.col("_own_id")).drop("_own_id")


def lookup_tickets(comment_rows: DataFrame, tickets: DataFrame, *columns: str) -> DataFrame:
    """Rows that belong to comments, with columns and the id of their ticket.

    An inner join: adaptive execution can split the rows of a ticket that has very many.
    """
    return _own_id(comment_rows.join(by_comment_key(tickets, *columns), KEY))


def attach_comments(tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """Tickets with their comments, one row per comment, in long form.

    A ticket without comments keeps one row whose ``comment`` is null. Comments are never gathered
    into an array: one ticket may hold a third of them all, and adaptive execution can split the
    rows of such a ticket but not one value. It can do so in an inner join, not in an outer one,
    hence the tickets without comments are a part of their own.
    """
    rest = [c for c in tickets.columns if c not in (*KEY, "comment_ref")]
    items = comments.select(*KEY, "item_ord", F.col("text").alias("comment"))
    columns = [*KEY, *rest, "item_ord", "comment"]
    some = lookup_tickets(items, tickets, *rest).select(columns)
    none = _own_id(by_comment_key(tickets, *rest).join(comments.select(*KEY).distinct(), KEY, "left_anti"))
    return some.unionByName(none.select(*KEY, *rest), allowMissingColumns=True)


def explode_comments(tickets: DataFrame, comments: str | Column = "comments") -> DataFrame:
    """The comment table of tickets that arrive with an array of comment texts."""
    return tickets.select(*KEY, F.posexplode(comments).alias("item_ord", "text")).withColumn(
        "item_ord", F.col("item_ord").cast("bigint")
    )


def skip_comments(comments: DataFrame, skip: bool) -> DataFrame | None:
    """No comment table at all when comments are skipped, so neither scan nor join is planned."""
    return None if skip else comments


def flatten_fields(tickets: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """One row per non-empty text.

    ``field_ord`` and ``item_ord`` keep the reading order. Comment texts only look up the url of
    their ticket; the ticket's own texts are not part of that join.
    """
    present = [f for f in FIELD_ORDER if f in tickets.columns]
    field = lambda f: [F.lit(f).alias("field"), F.lit(FIELD_ORDER[f]).alias("field_ord"), F.col(f).alias("text")]
    if len(present) == 1:
        own = tickets.select(*KEY, "url", *field(present[0]))
    else:
        own = tickets.select(*KEY, "url", F.inline(F.array(*[F.struct(*field(f)) for f in present])))
    own = own.withColumn("item_ord", F.lit(0).cast("bigint"))
    columns = [*KEY, "url", "field", "field_ord", "item_ord", "text"]
    texts = own.select(columns)
    if comments is not None:
        written = comments.where(F.coalesce("text", F.lit("")) != "")
        items = lookup_tickets(written, tickets, "url").select(
            *KEY,
            "url",
            F.lit("comments").alias("field"),
            F.lit(FIELD_ORDER["comments"]).alias("field_ord"),
            F.col("item_ord").cast("bigint").alias("item_ord"),
            "text",
        )
        texts = texts.unionByName(items)
    return texts.where(F.coalesce("text", F.lit("")) != "")


def drop_labelled_text(texts: DataFrame, label: str, text_col: str = "text") -> DataFrame:
    """Skip texts that carry the bot's label; an empty label skips every text."""
    return texts.where(~tx.contains_ignore_case(F.col(text_col), label))


def flag_already_warned(tickets: DataFrame, comments: DataFrame, label: str) -> DataFrame:
    """Add ``already_warned``: some comment of the ticket carries the label.

    Only labelled comments reach the shuffle, reduced per task to one row per ticket.
    """
    warned = (
        comments.where(tx.contains_ignore_case(F.col("text"), label))
        .groupBy(*KEY)
        .agg(F.lit(True).alias("already_warned"))
    )
    known = by_comment_key(tickets, *[c for c in tickets.columns if c not in (*KEY, "comment_ref")])
    marked = known.join(warned, KEY, "left")
    return _own_id(marked.withColumn("already_warned", F.coalesce("already_warned", F.lit(False))))
