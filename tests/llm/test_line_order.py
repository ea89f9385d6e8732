"""Later lines go, whatever ids look like and however long texts are."""

import random

import cases
import pytest

from leaksieve.llm import lines


def corpus(rng, ids):
    """Lines that are similar to earlier ones, in random order of documents."""
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 30))) for _ in range(12)]
    rows = []
    for one in ids:
        own = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split()
            words[rng.randrange(len(words))] = f"n{rng.randrange(60)}"
            own.append(" ".join(words))
        rows.append((one, "\n".join(own)))
    return rows


@pytest.mark.parametrize(
    ("kind", "ids"),
    [
        ("bigint", [2**50 + k for k in range(40)]),
        ("bigint", [-(2**62) + 7 * k for k in range(40)]),
        ("bigint", [2**63 - 1 - k for k in range(20)] + [-k for k in range(20)]),
        ("int", list(range(-20, 20))),
        ("string", [f"{'doc' * (k % 3)}-{k}" for k in range(40)] + [None, ""]),
        ("double", [k / 7 - 3 for k in range(30)]),
    ],
)
def test_order_of_ids(spark, kind, ids):
    rng = random.Random(len(ids))
    rows = corpus(rng, rng.sample(ids, len(ids)))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    number = {r: k for k, r in enumerate(order)}
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    want = {r[0]: r[3] for r in cases.line_report([(number[r], r[1]) for r in rows], least=1)}
    got = {r.doc_id: r.removed for r in lines.line_report(frame, lines.WHOLE).collect()}
    assert got == {r[0]: want[number[r]] for r in rows} and sum(map(len, got.values())) > 10


def test_lines_far_down(spark):
    """The earlier of two similar lines stays, beyond a million lines too."""
    far = "\n" * (1 << 21)
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine zen"
    rows = [(1, far + a + "\n" + b), (2, "x\n" + b)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.removed for r in lines.line_report(frame, lines.WHOLE).collect()}
    assert got == {1: [(1 << 21) + 1], 2: [1]}


def test_a_word_in_many_lines(spark):
    """Crowded words are settled in blocks, and every set finds its earlier partner."""
    rng = random.Random(9)
    rows = [(k, " ".join(["rare"] + [f"v{rng.randrange(9)}" for _ in range(9)])) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    old, lines.BLOCK_SETS = lines.BLOCK_SETS, 20
    try:
        got = lines.line_report(frame, lines.LineOptions(1, first_asked=1)).collect()
    finally:
        lines.BLOCK_SETS = old
    cases.same(got, cases.line_report(rows, least=1))
