"""Running values over a whole table in the order of its keys, by ranges.

Rows are laid out by ranges of the keys, so a run of neighbours that holds most of the table is spread over many
tasks. Inside a range a window gives the running value; what the ranges before contribute is a table
with one row for each range. No window ever runs over the table. Rows with equal keys stay in one range: reduce them
first where there may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.session import materialise

RANGE, PLACE = "_range", "_place"


def laid_out(frame: DataFrame, keys: Sequence[str], name: str = "laid-out") -> DataFrame:
    """Store the rows by ranges of the keys, with the number of the range and the row's place in it.

    Stored, because another run of the same plan may draw other borders.
    """
    sorted_ = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(sorted_.withColumn(RANGE, F.spark_partition_id()).withColumn(PLACE, place), name)


def running(laid: DataFrame, value: str, into: str, how: str = "max") -> DataFrame:
    """Add the ``max`` or ``sum`` of ``value`` over all rows up to this one; nulls do not count."""
    combine = {"max": F.max, "sum": F.sum}[how]
    so_far = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy(F.col(RANGE).alias("_r")).agg(combine(value).alias("_top"))
    ranges = ranges.select("_r", combine("_top").over(before).alias("_before"))  # as many rows as ranges
    own = laid.withColumn("_own", combine(value).over(so_far))
    joined = own.join(F.broadcast(ranges), F.col(RANGE) == F.col("_r"))
    both = F.greatest("_own", "_before")
    if how == "sum":
        both = F.coalesce(F.col("_own") + F.col("_before"), F.col("_own"), F.col("_before"))
    return joined.withColumn(into, both).drop("_own", "_before", "_r")


def as_of(frame: DataFrame, history: DataFrame, by: str, at: str, values: Sequence[str]) -> DataFrame:
    """Each row with the values that its ``by`` had last at ``at``; null where there are none yet.

    ``history`` has rows ``by, at, *values``. Of several for one moment the largest values count. Rows of both are put in
    order of (``by``, ``at``); the latest row of the history so far is a running maximum, and holds if it is of the
    same ``by``. Only distinct moments are ordered, so one key may have any share of the rows.
    """
    known = F.struct(F.col(by).alias("by"), F.col(at).alias("at"), F.struct(*values).alias("values"))
    own = history.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    own = own.groupBy(by, at).agg(F.max(known).alias("_known")).select(by, at, F.lit(0).alias("_kind"), "_known")
    moments = frame.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at).distinct()
    moments = moments.select(by, at, F.lit(1).alias("_kind"), F.lit(None).cast(own.schema["_known"].dataType).alias("_known"))
    laid = laid_out(own.unionByName(moments), [by, at, "_kind"], "as-of")
    found = running(laid, "_known", "_last").where("_kind = 1")
    found = found.where(F.col("_last.by") == F.col(by))
    found = found.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.col("_last.values").alias("_values"))
    joined = frame.join(found, (F.col(by) == F.col("_by")) & (F.col(at) == F.col("_at")), "left")
    return joined.select(*[frame[c] for c in frame.columns if c not in values], *[F.col(f"_values.{v}").alias(v) for v in values])
