"""Formatted conversations read back as they were, whatever their texts hold."""

import hashlib
import random

import cases
from pyspark.sql import functions as F

from leaksieve.llm import chatformat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segments string, formatted string, _range string, `range` string, loss string"
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[NEXT]", "\\", "<", "[", ">", "]", "a", "\n", "é😀", "<\\/s>", "$1"]
BITS += [b[:1] + "\\" + b[1:] for b in BITS[:10]]


def conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "[ROLE]", "a[TEXT]b", "", None, "user "]
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choices(BITS, k=rng.randint(0, 6)))
    table = [(c, t, rng.choice(roles), text()) for c in range(150) for t in range(rng.randint(1, 9))]
    table += [(500, t * 3 - 2000, rng.choice(roles[:5]), text()) for t in range(3000)]
    table += [(None, 4, "user", "x"), (None, None, "assistant", "y"), (3, None, "user", "z"), (3, 0, "user", "z")]
    return table + table[:7]


def frame(spark, table):
    return spark.createDataFrame([(*r, *"abcde") for r in table], SCHEMA).repartition(3)


def turns_of(table):
    held = {}
    for conv, turn, role, text in table:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(rows)] for c, rows in held.items()}


def expected(table):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in turns_of(table).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return out


def test_round_trip(spark):
    table = conversations()
    got = chatformat.format_digest(frame(spark, table)).collect()
    cases.same([tuple(r)[:5] for r in got], expected(table))


def test_turns_and_mask(spark):
    table = conversations()
    made = chatformat.format_conversations(frame(spark, table))
    back = made.select("conv_id", "formatted", "segments", chatformat.parse_formatted(F.col("formatted")).alias("turns")).collect()
    want = turns_of(table)
    assert len(back) == len(want)
    for row in back:
        assert [tuple(t) for t in row.turns] == want[row.conv_id]
        assert "".join(s.text for s in row.segments) == row.formatted
        assert len([s for s in row.segments if s.loss]) == sum(r == "assistant" for r, _ in want[row.conv_id])


def test_blocks(spark):
    table = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "<s>"), (1, 3, "assistant", "b"), (1, 600, "assistant", "c"), (1, 601, "tool", "d")]
    made = chatformat.format_conversations(frame(spark, table)).first()
    assert made.formatted == "<<SYS>>s<</SYS>>[INST]a[NEXT]<\\s>[/INST]<s>b[NEXT]c</s>[ROLE]tool[TEXT]d[/ROLE]"
    assert [s.text for s in made.segments if s.loss] == ["b", "c"]


def test_probe(spark):
    none = frame(spark, conversations()).where("false")
    assert chatformat.format_digest(none).count() == 0
    text = "</s>[INST] ok [/INST]"
    got = chatformat.format_digest(chatformat.with_probe(none)).collect()
    cases.same([tuple(r)[:5] for r in got], expected([(-7, 0, "user", text), (-7, 1, "assistant", text)]))


def test_no_python_and_no_whole_conversation(spark):
    """A third of all rows in one conversation: its turns are formatted by ranges."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    made = chatformat.format_digest(rows)
    assert made.where("n_turns = 3000").count() == 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
