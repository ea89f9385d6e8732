"""The scan as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.findings import build_findings
from leaksieve.operators.ledger import Ledger, scan_new
from leaksieve.operators.matching import scan_texts
from leaksieve.operators.rules import RuleSet
from leaksieve.options import MatchOptions


def scan_stream(texts: DataFrame, rules: RuleSet, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Matches of a stream of texts: the batch operator, which keeps no state."""
    return scan_texts(texts, rules, options)


def stream_findings(matches: DataFrame, ts: str = "ts", keep_seq: bool = False) -> DataFrame:
    """Finding records of a stream of matches, with their event time."""
    found = build_findings(matches, keep=(ts,))
    return found if keep_seq else found.drop("seq")


def stream_dedup(findings: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """The first finding of each id within the delay.

    State is one row per id seen within the watermark, so it is bounded by the findings of that
    time. A finding that comes later than the delay may be reported again.
    """
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def stream_leak_rate(findings: DataFrame, width: str = "1 hour", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """(window_start, rule_id, n): findings per rule in tumbling windows, in batch or stream.

    A stream closes a window, and forgets it, once event time is ``delay`` past its end.
    """
    if findings.isStreaming:
        findings = findings.withWatermark(ts, delay)
    counts = findings.groupBy(F.window(ts, width).alias("_w"), "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("_w.start").alias("window_start"), "rule_id", "n")


def scan_stream_new(texts: DataFrame, rules: RuleSet, ledger: Ledger, out: str, options: MatchOptions = MatchOptions()):
    """A writer of a stream's matches, one folder a batch, that searches only texts and rules the ledger does not know.

    A batch that is repeated after a failure replaces its own folders, in the ledger and in the output. Start it with
    ``.option("checkpointLocation", …).start()``.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch={number:012d}"
        found = scan_new(batch, rules, ledger, options, run=f"{out.rstrip('/').rsplit('/', 1)[-1]}-{number:012d}")
        found.write.mode("overwrite").parquet(f"{out}/{name}")

    return texts.writeStream.foreachBatch(write)
