"""The earliest finding of each id from a stream in any order."""

import random

import pytest
from pyspark.sql import functions as F

from leaksieve.streaming.first import ROCKS, STORE, stream_earliest

SCHEMA = "id string, secret string, note string, ts timestamp, seq struct<platform:string,issue_id:string,field_ord:int,item_ord:bigint>"


def test_store_is_asked_for(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'x' id", "timestamp ts", "named_struct('platform','p','issue_id','i','field_ord',0,'item_ord',0L) seq")
    with pytest.raises(RuntimeError):
        stream_earliest(stream, "1 hour")


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    yield
    spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run(spark, tmp_path, batches, delay):
    """Each batch is a file that one micro-batch reads."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "id string, secret string, note string, s bigint, p string, k string, f int, i bigint")
        frame = frame.select("id", "secret", "note", F.timestamp_seconds("s").alias("ts"), F.struct(F.col("p").alias("platform"), F.col("k").alias("issue_id"), F.col("f").alias("field_ord"), F.col("i").alias("item_ord")).alias("seq"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = (
        stream_earliest(stream, delay).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_any_order_gives_the_rows_of_the_batch(spark, rocks, tmp_path):
    rng = random.Random(3)
    rows = [(f"id{rng.randrange(12)}", f"s{k}", None if k % 5 == 0 else "n", 1000 + k, "p", f"t{rng.randrange(40):03d}", rng.randrange(3), rng.randrange(30)) for k in range(90)]
    rng.shuffle(rows)
    batches = [rows[:30], rows[30:60], rows[60:], [("flush", "f", None, 9000, "p", "z", 0, 0)], [("flush2", "f", None, 20000, "p", "z", 0, 0)]]
    got = run(spark, tmp_path, batches, "300 seconds")
    want = {}
    for i, secret, note, s, p, k, f, n in rows:
        want[i] = min(want.get(i, ((p, k, f, n), secret, note, s)), ((p, k, f, n), secret, note, s), key=lambda x: x[0])
    got = {r.id: (r.secret, r.note, int(r.ts.timestamp())) for r in got.collect() if not r.id.startswith("flush")}
    assert got == {i: w[1:] for i, w in want.items()}


def test_later_than_the_delay_is_a_new_report(spark, rocks, tmp_path):
    batches = [
        [("a", "late in order", None, 100, "p", "b", 0, 0), ("a", "first", None, 150, "p", "a", 0, 9), ("a", "second time", None, 500, "p", "a", 0, 1)],
        [("flush", "f", None, 5000, "p", "z", 0, 0)],
        [("flush", "f", None, 9000, "p", "z", 0, 0)],
    ]
    got = run(spark, tmp_path, batches, "60 seconds").where("id = 'a'").collect()
    assert sorted(r.secret for r in got) == ["first", "second time"]
