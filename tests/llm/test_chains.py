"""Long chains of links."""

import random

import cases
import pytest

from leaksieve.llm import exchange, jaccard


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string").repartition(3)


@pytest.mark.parametrize("shape", ["path", "ordered path", "star of paths"])
def test_long_chains_connect(spark, shape):
    rng = random.Random(3)
    n = 600
    names = sorted(rng.sample(range(1 << 40), n))
    if shape != "ordered path":
        rng.shuffle(names)
    edges = [(names[k], names[k + 1 if shape != "star of paths" or k % 50 else 0]) for k in range(n - 1)]
    want = {frozenset(names)} if shape != "star of paths" else None
    if want is None:
        parent = {x: x for x in names}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        groups = {}
        for x in {x for a, b in edges for x in (a, b) if a != b}:
            groups.setdefault(root(x), set()).add(x)
        want = set(map(frozenset, groups.values()))
    got = {r.node: r.component for r in exchange.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: min(group) for group in want for x in group if len(group) > 1}


def test_chain_of_versions(spark):
    """Several hundred versions of a text, each similar to its neighbours alone."""
    words = [f"w{k}" for k in range(40 + 2 * 300)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 40])) for k in range(300)]
    assert not cases.similar(cases.shingles(rows[0][1]), cases.shingles(rows[3][1]))
    cases.same(jaccard.link_report(corpus(spark, rows)).collect(), cases.linked(rows))
