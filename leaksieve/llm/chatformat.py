"""Training text from turns and back, in built-in functions.

A template marks who speaks: neighbouring turns of a role share a block, ``[NEXT]`` parts the texts inside it.

* ``[INST]…[/INST]`` a user, ``<s>…</s>`` an assistant, ``<<SYS>>…<</SYS>>`` the system
* ``[ROLE]name[TEXT]…[/ROLE]`` any other role

A control string inside a text or a role's name gets a backslash behind its first character, one more than it has
already, so that nothing in a text can be read as a mark and every text comes back as it was.

The result is a list of segments, each with its text and whether it counts in the loss: an assistant's texts
do, marks and all else do not. The segments one after another are the formatted conversation.

A conversation may hold any share of the rows. Turns are first formatted by ranges of ``TURNS`` turn numbers, in
as many tasks as there are ranges, and only finished ranges meet, at whose seams a block goes on or ends.

Defined cases: rows go by turn, nulls first, those of equal turn by role, then by text; repeated rows are turns of
their own; a null text or role is the empty one; a null ``conv_id`` is a conversation; an empty table gives none;
extra columns are ignored. Rows of one conversation whose turns all are equal come together in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 512

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT, END_ROLE, NEXT = "[ROLE]", "[TEXT]", "[/ROLE]", "[NEXT]"
LOSS = "assistant"

# What follows the first character of a control string.
_REST = r"(/?INST\]|/?ROLE\]|TEXT\]|NEXT\]|/?s>|</?SYS>>)"
ESCAPE = rf"([<\[])(\\*){_REST}"
UNESCAPE = rf"([<\[])\\(\\*){_REST}"
CLOSING = r"\[/INST\]|</s>|<</SYS>>|\[/ROLE\]"

SPOKEN = "struct<text:string,loss:boolean>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _opening(role: Column) -> Column:
    mark = F.concat(F.lit(ROLE), escape(role), F.lit(TEXT))
    for name, (begin, _) in MARKS.items():
        mark = F.when(role == name, begin).otherwise(mark)
    return mark


def _closing(role: Column) -> Column:
    mark = F.lit(END_ROLE)
    for name, (_, end) in MARKS.items():
        mark = F.when(role == name, end).otherwise(mark)
    return mark


def _between(before: Column, after: Column) -> Column:
    """What stands between the texts of two turns."""
    return F.when(before == after, NEXT).otherwise(F.concat(_closing(before), _opening(after)))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _merged(turns: Column) -> Column:
    """Blocks ``(role, texts)`` of neighbouring turns with one role."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        goes_on = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(
            goes_on, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))
        ).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), add)


def _spoken(blocks: Column) -> Column:
    """Segments of blocks, without the mark before the first and the one behind the last."""

    def of_block(block: Column, number: Column) -> Column:
        before = F.get(blocks, number - 1)["role"]
        lead = F.when(number == 0, "").otherwise(_between(before, block["role"]))

        def of_text(text: Column, k: Column) -> Column:
            mark = F.when(k == 0, lead).otherwise(NEXT)
            return F.array(_segment(mark, F.lit(False)), _segment(escape(text), block["role"] == LOSS))

        return F.flatten(F.transform(block["texts"], of_text))

    return F.flatten(F.transform(blocks, of_block))


def format_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, formatted, segments``: a row for each conversation."""
    empty = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    ranges = rows.select(F.col(key).alias(key), F.expr(f"turn div {TURNS}").alias("_range"), turn.alias("_turn"))
    ranges = ranges.groupBy(key, "_range").agg(_merged(F.sort_array(F.collect_list("_turn"))).alias("_blocks"))
    part = F.struct(
        F.col("_range").alias("range"),
        F.get("_blocks", F.lit(0))["role"].alias("first"),
        F.element_at("_blocks", -1)["role"].alias("last"),
        _spoken(F.col("_blocks")).alias("segments"),
    )
    whole = ranges.select(key, part.alias("_part")).groupBy(key).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    parts = F.col("_parts")

    def with_seam(part: Column, number: Column) -> Column:
        seam = F.when(number == 0, _opening(part["first"])).otherwise(_between(F.get(parts, number - 1)["last"], part["first"]))
        return F.concat(F.array(_segment(seam, F.lit(False))), part["segments"])

    end = F.array(_segment(_closing(F.element_at(parts, -1)["last"]), F.lit(False)))
    segments = F.concat(F.flatten(F.transform(parts, with_seam)), end)
    segments = F.filter(segments, lambda s: (s["text"] != "") | s["loss"])
    whole = whole.select(key, segments.alias("segments"))
    return whole.select(key, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    blocks = F.split(formatted, CLOSING, -1)  # behind the last closing mark is nothing

    def of_block(block: Column) -> Column:
        named = F.split(F.substr(block, F.lit(len(ROLE) + 1)), r"\[TEXT\]", 2)
        role, body = unescape(F.get(named, F.lit(0))), F.get(named, F.lit(1))
        for name, (begin, _) in MARKS.items():
            here = F.startswith(block, F.lit(begin))
            role = F.when(here, name).otherwise(role)
            body = F.when(here, F.substr(block, F.lit(len(begin) + 1))).otherwise(body)
        texts = F.split(body, r"\[NEXT\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of_block))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescape(s["text"])), "")


def format_digest(rows: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    made = format_conversations(rows)
    back = made.select(
        "conv_id",
        parse_formatted(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two turns hold nothing but control strings and a word."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
