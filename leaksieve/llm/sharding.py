"""Rendezvous hashing of record keys over weighted shards, and gapless slots within a shard.

Every record scores each shard by ``-weight / ln(u)`` with ``u`` a uniform hash of key and shard number,
and goes to the best. A shard's scores do not depend on the other shards, so a further shard takes
records only into itself, in proportion to its weight, and no other record moves.

Defined cases: a null key is a key like any other (all null keys share a shard); repeated rows get the
same shard and one slot each; an empty table stays empty; an input column with the name of an
output column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_of(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The winning shard, from 0. Ties of two scores go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = []
    for number, weight in enumerate(weights):
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(number), *keys), 11)
        uniform = (draw.cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(uniform)).alias("score"), F.lit(-number).alias("n")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["n"]).cast("int")


def assign_shards(frame: DataFrame, keys: Sequence[str], weights: Sequence[float], into: str = "shard") -> DataFrame:
    """Add the shard of each row; no shuffle."""
    return frame.withColumn(into, shard_of([F.col(k) for k in keys], weights))


def number_slots(frame: DataFrame, group: str = "shard", into: str = "slot", buckets: int = 1024) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group may hold most of the table, so no task ever sees a whole one: rows are counted per hash
    bucket, the buckets' starts come from running totals (``buckets`` rows a group), and only rows of one
    bucket are ordered together. Equal rows are counted before they are shuffled and spread out
    again at the end, so one key that holds a third of the table costs a row.
    """
    names = [c for c in frame.columns if c != into]
    rows = frame.select(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*names)
    rows = rows.withColumn("_end", F.sum("_copies").over(inside))
    sums = rows.groupBy(group, "_bucket").agg(F.max("_end").alias("_size"))
    running = Window.partitionBy(group).orderBy("_bucket")
    starts = sums.select(
        F.col(group).alias("_g"),
        F.col("_bucket").alias("_b"),
        (F.sum("_size").over(running) - F.col("_size")).alias("_start"),
    )
    placed = rows.join(starts, rows[group].eqNullSafe(starts["_g"]) & (rows["_bucket"] == starts["_b"]))
    first = F.col("_start") + F.col("_end") - F.col("_copies")
    return placed.select(*names, F.explode(F.sequence(first, F.col("_start") + F.col("_end") - 1)).alias(into))


def move_plan(frame: DataFrame, keys: Sequence[str], old: Sequence[float], new: Sequence[float]) -> DataFrame:
    """The rows that change shards when the weights change, with ``from_shard`` and ``to_shard``."""
    columns = [F.col(k) for k in keys]
    moved = frame.withColumns({"from_shard": shard_of(columns, old), "to_shard": shard_of(columns, new)})
    return moved.where("from_shard <> to_shard")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``key``.

    A null text has no bytes: size 1, crc 0.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = assign_shards(rows, ["doc_id"], [1.0] * shards)
    rows = assign_shards(rows, ["doc_id"], [1.0] * (shards + 1), "grown_shard")
    return number_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
