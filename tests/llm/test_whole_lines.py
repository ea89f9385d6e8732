"""Lines that are unlike all others stay, and repeats go whatever their length."""

import cases

import corpus_pipeline
from cases import docs  # noqa: F401
from leaksieve.llm import lines, queries


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").repartition(3)


def test_unlike_lines_survive(spark):
    """A document stays as long as a line with a word is left, and keeps every line that is not marked."""
    licence = "this text is free for all to use and share"
    rows = [(1, licence), (2, "\n".join([*(f"x{k} = {k}" for k in range(50)), licence])), (3, licence + "\n \n"), (4, f"{licence}\n")]
    left = {r.doc_id: r.text for r in lines.drop_repeated_lines(corpus(spark, rows)).collect()}
    gone = {r[0]: set(r[3]) for r in cases.line_report(rows)}
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in rows}
    assert left == {k: t for k, t in want.items() if t.split()} and set(left) == {1, 2}


def test_lines_of_all_sizes(docs):
    got = lines.line_report(docs, lines.WHOLE).collect()
    cases.same(got, cases.line_report(cases.pairs(docs), least=1))


def test_queries_see_short_lines(spark, tmp_path):
    rows = [(1, "all rights reserved.\na b c d\nfirst"), (2, "ALL rights reserved.\na b c d e\nsecond"), (3, "second\nfirst\n\nthird\nthird")]
    corpus(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = cases.line_report(rows, least=1)
    cases.same(queries.op6_line_dedup(spark, str(tmp_path)).collect(), want)
    assert [r[3] for r in want] == [[], [0, 1], [0, 1, 4]]
    left = dict(corpus_pipeline.STAGES)["line_dedup"](spark, corpus(spark, rows), "").collect()
    assert {r.doc_id: r.text for r in left} == {1: rows[0][1], 2: "second", 3: "\nthird"}
