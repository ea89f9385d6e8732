from pyspark.sql import functions as F

from leaksieve.operators import matching as mt
from leaksieve.operators.rules import RuleSet
from leaksieve.streaming import stream as st

RULES = RuleSet.from_dict({"rules": [{"id": "r", "regex": "AB[0-9]{4}", "example": "AB0000"}]})
SCHEMA = "platform string, issue_id string, url string, field string, ts timestamp, text string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn(
        "ts", F.col("ts").cast("timestamp")
    ).coalesce(1).write.mode("append").parquet(path)


def run(spark, frame, out, state, mode="append"):
    q = frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out)
    q.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch_and_dedups_across_runs(spark, tmp_path):
    src, out, dedup = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/dedup"
    row = lambda i, minute, text: ("Slack", f"m{i}", "place", "message", f"2024-01-01 00:{minute:02d}:00", text)
    land(spark, src, [row(1, 0, "a AB1111 b"), row(2, 1, "none"), row(3, 2, "other AB2222")])
    for step in range(2):
        texts = spark.readStream.schema(SCHEMA).parquet(src)
        matches = st.scan_stream(texts, RULES)
        run(spark, matches, out, f"{tmp_path}/state1")
        findings = st.stream_dedup(st.stream_findings(matches), "1 hour")
        run(spark, findings, dedup, f"{tmp_path}/state2")
        if step == 0:
            # the same place read again: redacted alike, so not reported twice
            land(spark, src, [row(4, 5, "a AB3333 b"), row(5, 6, "third AB4444")])
    batch = mt.scan_texts(spark.read.schema(SCHEMA).parquet(src), RULES)
    columns = ["issue_id", "secret", "sanitized_secret", "line_number"]
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect())
    )
    once = spark.read.parquet(dedup)
    assert sorted(r.secret for r in once.collect()) == ["a <REDACTED> b", "other <REDACTED>", "third <REDACTED>"]


def test_leak_rate_in_batch(spark):
    rows = [("2024-01-01 00:10:00", "r"), ("2024-01-01 00:50:00", "r"), ("2024-01-01 01:00:00", "r")]
    df = spark.createDataFrame(rows, "ts string, rule_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r.window_start), r.n) for r in st.stream_leak_rate(df).collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)]
