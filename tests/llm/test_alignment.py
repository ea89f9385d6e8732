"""Links, groups and counts of two tokenizers against plain loops."""

import hashlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest

from cases import docs, no_docs  # noqa: F401
from leaksieve.llm import alignment, csr

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁", "a▁b", " ", "  x", "<|endoftext|>", "a <|endoftext|> b</s><s>", "<0x41>", "\u0000a", "é́", "漢字かな交じり文", "\r\n\t", "🙂🙃", "ﬁ ½ Å", "​﻿x", "", "nbsp x"]


def sparse(dense):
    dense = np.asarray(dense)
    rows = [np.flatnonzero(r) for r in dense]
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return csr.CSR(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), flat.astype(np.int64), dense.shape[1])


def dense(m):
    out = np.zeros((m.rows, m.columns), dtype=np.int64)
    out[m.row_of(), m.indices] = 1 if m.values is None else m.values
    return out


@pytest.mark.parametrize("terms", [1, 5, 1 << 20])
def test_products(terms):
    rng = np.random.default_rng(2)
    for n, k, m in [(0, 3, 2), (4, 0, 3), (1, 1, 1), (9, 7, 8), (30, 20, 25)]:
        x, y = rng.random((n, k)) < 0.2, rng.random((k, m)) < 0.3
        got = csr.product(sparse(x), sparse(y), terms)
        assert (dense(got) == x.astype(int) @ y.astype(int)).all()
        assert (dense(csr.transpose(sparse(x))) == x.T).all()
        assert csr.row_work(sparse(x), sparse(y)).tolist() == (x.astype(int) @ y.astype(int)).sum(axis=1).tolist()


def plain(model, text):
    """Byte ranges by loops: a tokens, b tokens, groups and links by places."""
    if not text:
        return None
    made = []
    for tokenizer in (model.first, model.second):
        [ids], at, out = tokenizer.encode([text]), 0, []
        for i in ids:
            out.append((i, at, at + len(tokenizer.pieces[i])))
            at = out[-1][2]
        if b"".join(tokenizer.pieces[i] for i in ids) != b" " + text.encode():
            return None
        made.append(out)
    a, b = made
    links = [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
    ends = sorted({x[2] for x in a} & {y[2] for y in b})
    groups = [([i for i, x in enumerate(a) if low < x[2] <= high], [j for j, y in enumerate(b) if low < y[2] <= high]) for low, high in zip([0, *ends], ends)]
    return a, b, groups, links


@pytest.fixture(scope="module")
def model():
    return alignment.aligner(A, B)


@pytest.fixture(scope="module")
def texts():
    return [t if t is None or len(t) < 3000 else t[:3000] for t in cases.texts()[::3]] + ODD + [None, "", "z" * 700, "\\" * 300 + "é"]


def test_alignment(model, texts):
    made = model.align(texts)
    first, second = made.groups()
    links = made.overlap_links()
    spelled = made.spelled_groups(model.digits)
    shared = {(low + i, j) for low, block in made.group_links() for i, j in zip(block.row_of().tolist(), block.indices.tolist())}
    assert made.group_link_counts().sum() == len(shared)
    for k, text in enumerate(texts):
        want = plain(model, text)
        a0, a1, b0, b1 = made.a_at[k], made.a_at[k + 1], made.b_at[k], made.b_at[k + 1]
        if want is None:
            assert a0 == a1 and b0 == b1 and spelled[k] == b""
            continue
        a, b, groups, pairs = want
        assert made.a[a0:a1].tolist() == [x[0] for x in a] and made.b[b0:b1].tolist() == [x[0] for x in b]
        rows = range(links.indptr[a0], links.indptr[a1])
        row_of = links.row_of()
        assert [(row_of[r] - a0, links.indices[r] - b0, links.values[r]) for r in rows] == pairs
        assert {(i - a0, j - b0) for i, j in shared if a0 <= i < a1} == {(i, j) for x, y in groups for i in x for j in y}
        said = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in groups)
        assert spelled[k].decode() == said


def test_odd_texts(model):
    """What comes back otherwise has no tokens; names of special tokens are text."""
    made = model.align(ODD)
    n = dict(zip(ODD, np.diff(made.a_at).tolist()))
    assert n["▁"] == n["a▁b"] == 0
    assert all(n[t] > 1 for t in ("<|endoftext|>", "<0x41>", "漢字かな交じり文", "\r\n\t", "🙂🙃"))
    special = {model.first.tokenizer.token_to_id("<|endoftext|>")}
    assert not special & set(made.a.tolist())


def report(model, rows):
    found = [(key, plain(model, text)) for key, text in rows]
    counts = Counter()
    for _, want in found:
        if want:
            counts.update({(want[0][i][0], want[1][j][0]) for i, j, _ in want[3]})
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for key, want in found:
        if want is None:
            out.append((key, *[0] * 6, ""))
            continue
        a, b, groups, links = want
        own = [(a[i][0], counts[a[i][0], b[j][0]]) for i, j, _ in links]
        said = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest()
        out.append((key, len(a), len(b), len(groups), len(links), sum(n == highest[x] for x, n in own), sum(n for _, n in own), sha))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [1, 700, 10**9])
def test_report(spark, model, texts, most):
    rows = [(k if k % 9 else None, t, f"x{k}", k) for k, t in enumerate(texts)] + [(1, texts[1], "y", 0)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, pair bigint").repartition(3)
    got = alignment.alignment_report(frame, A, B, most=most).select(*COLUMNS).collect()
    cases.same(got, report(model, [r[:2] for r in rows]))


def test_link_rows(spark, model, texts):
    rows = [(f"k{k}", t) for k, t in enumerate(texts[-22:])]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    links = alignment.overlap_links(frame, A, B).select("doc_id", "a", "b", "bytes").collect()
    groups = alignment.group_links(frame, A, B).select("doc_id", "a", "b").collect()
    want = [(key, plain(model, text)) for key, text in rows]
    cases.same(links, [(key, *link) for key, w in want if w for link in w[3]])
    cases.same(groups, [(key, i, j) for key, w in want if w for x, y in w[2] for i in x for j in y])


def test_whole_table(spark, docs, no_docs):
    got = alignment.alignment_report(docs, A, B)
    assert got.count() == docs.count() and got.columns[0] == "doc_id"
    assert alignment.alignment_report(no_docs, A, B).count() == 0


def test_long_run_forms_no_pairs(model):
    """A group without common ends for long: its pairs are counted, not formed."""
    made = model.align(["é" * 200_000 + "Ā" * 10])
    assert made.group_link_counts().sum() >= len(made.a) and max(len(b.indices) for _, b in [next(iter(made.group_links()))]) <= (1 << 20) + len(made.b)


def test_fast_merges_give_the_same_ids(model, texts):
    """The two ways through the first tokenizer, also on blanks that only one of them takes."""
    rows = [t for t in texts if t] + [" " * 3000, "a" + "\n" * 1200 + "b", "x " * 900, " " * 1100]
    assert model.first.fast is not None
    assert model.first.encode(rows) == model.first._encode(rows)
    letters = [f" {c}{c}a {c} 1{c}  {c}.{c}\n{c}'s" for c in map(chr, range(0, 0x3400, 7)) if c.isprintable() or c.isspace()]
    assert model.first.encode(letters) == model.first._encode(letters)


def test_a_file_that_is_not_plain_merges(tmp_path):
    """With a space put before texts by the file itself, the library runs it."""
    import json

    form = json.loads(open(A, encoding="utf-8").read())
    form["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(form))
    other = alignment.ByteLevel(str(path))
    assert other.fast is None and other.encode(["a b"]) == alignment.ByteLevel(A).encode(["a b"])
