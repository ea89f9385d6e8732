"""Repeated scans: the same matches as a whole scan, and no more work than is new."""

import random
from collections import Counter

from leaksieve.operators import ledger as lg
from leaksieve.operators import matching
from leaksieve.operators.rules import RuleSet
from leaksieve.options import MatchOptions
from leaksieve.streaming.stream import scan_stream_new

import pytest

WORDS = ["alpha1", "beta2", "gamma3", "delta4", "fine", "x", "\n"]


def rules(*ids, allow=()):
    return RuleSet.from_dict(
        {"rules": [{"id": i, "regex": f"{i}[0-9]", "example": f"<{i}>", **({"allowlists": [{"regexes": ["fine"]}]} if i in allow else {})} for i in ids]}
    )


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [("p", f"u{k}", " ".join(rng.choices(WORDS, k=rng.randint(0, 4)))) for k in range(200)]
    rows += [("p", "copy", rows[0][2]), ("q", "copy2", rows[0][2]), ("p", "null", None), ("p", "empty", "")]
    return spark.createDataFrame(rows, "platform string, url string, text string").repartition(3)


COLUMNS = ["platform", "url", "rule_id", "rule_ord", "begin", "end", "secret", "line_number", "sanitized_secret", "snippet_text", "mocked_secret"]


def same(frame, table, some, options=MatchOptions()):
    got = Counter(map(tuple, frame.select(*COLUMNS).collect()))
    want = Counter(map(tuple, matching.scan_texts(table, some, options).select(*COLUMNS).collect()))
    assert got == want and got


def tried(ledger, spark, run):
    return Counter(r.tried for r in ledger.answers(spark).where(f"run = '{run}'").collect())


def test_runs(spark, table, tmp_path):
    ledger = lg.Ledger(f"{tmp_path}/ledger")
    first = rules("alpha", "beta", "gamma", "delta")
    same(lg.scan_new(table, first, ledger, run="1"), table, first)
    texts = {r.text for r in table.collect() if r.text is not None}
    assert sum(tried(ledger, spark, "1").values()) == len(texts)  # copies once, null not at all

    # the same again: no row at all
    same(lg.scan_new(table, first, ledger, run="2"), table, first)
    assert not tried(ledger, spark, "2")

    # one rule changed: it alone is tried, but for texts that it had accepted
    second = rules("alpha", "beta", "gamma", "delta", allow=["beta"])
    same(lg.scan_new(table, second, ledger, run="3"), table, second)
    by = tried(ledger, spark, "3")
    had = {t for t in texts if "beta2" in t and "alpha1" not in t}
    again = ledger.answers(spark).where("run = '3' AND tried > 1").count()
    assert again <= len(had) and by[0] == len({t for t in texts if "alpha1" in t}) and sum(by.values()) == len(texts)
    assert by[1] + again == len(texts) - by[0]

    # rules moved: what stands before the answer is known, what is new in front is tried
    third = rules("delta", "gamma", "beta", "alpha", "x")
    same(lg.scan_new(table, third, ledger, run="4"), table, third)

    # back to the first set: nothing to do
    same(lg.scan_new(table, first, ledger, run="5"), table, first)
    assert not tried(ledger, spark, "5")


def test_new_texts(spark, table, tmp_path):
    ledger, some = lg.Ledger(f"{tmp_path}/ledger"), rules("alpha", "beta")
    lg.scan_new(table.where("platform = 'q'"), some, ledger, run="1")
    same(lg.scan_new(table, some, ledger, run="2"), table, some)
    old = {r.text for r in table.where("platform = 'q'").collect()}
    assert sum(tried(ledger, spark, "2").values()) == len({r.text for r in table.collect() if r.text is not None} - old)


def test_other_options_are_other_versions(spark, table, tmp_path):
    ledger, some = lg.Ledger(f"{tmp_path}/ledger"), rules("alpha", "beta")
    lg.scan_new(table, some, ledger)
    options = MatchOptions(mock_all=True)
    same(lg.scan_new(table, some, ledger, options), table, some, options)
    with pytest.raises(ValueError):
        lg.scan_new(table, some, ledger, MatchOptions(path_filter=True))


def test_a_repeated_run_replaces_itself(spark, table, tmp_path):
    ledger, some = lg.Ledger(f"{tmp_path}/ledger"), rules("alpha", "beta")
    lg.scan_new(table.where("platform = 'p'"), some, ledger, run="1")
    n = ledger.answers(spark).count()
    lg.Ledger.write(ledger, spark, "1", "v", ["r"], ledger.answers(spark).where("false").drop("run"))
    assert n > 0 and ledger.answers(spark).count() == 0


def test_no_texts(spark, table, tmp_path):
    ledger = lg.Ledger(f"{tmp_path}/ledger")
    assert lg.scan_new(table.where("false"), rules("alpha"), ledger).count() == 0
    assert lg.scan_new(table, RuleSet(()), ledger).count() == 0


def test_work_table():
    """Each answer of an old set under a new one."""
    work = {w.k: (w.yes, w.unknown, w.settled) for w in lg.work_table({"v": ["a", "b", "c"]}, ["b", "n", "c"])}
    assert work == {None: (None, [1], False), 0: (None, [0, 1, 2], False), 1: (0, [], True), 2: (2, [1], False)}


def test_stream(spark, table, tmp_path):
    """Batches of a stream share the ledger."""
    some, ledger = rules("alpha", "beta"), lg.Ledger(f"{tmp_path}/ledger")
    table.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = scan_stream_new(stream, some, ledger, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    same(spark.read.parquet(f"{tmp_path}/out/*"), table, some)
    answers = ledger.answers(spark)
    assert answers.count() == answers.select("text_hash").distinct().count()
