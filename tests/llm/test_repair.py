"""Repaired conversations against every list of edits, ties, collisions and stretches of any length."""

import hashlib
import itertools
import random
import re
import zlib

import cases
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import repair
from leaksieve.llm.audittree import AuditTree

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies string, digest string, fault string, part string"
LEGAL = re.compile(r"(s?(ua)+)?")


def edit_lists(rows):
    """Every list of edits with at most two insertions in a place: cost, audit, turns."""
    gap = [(3 * n, "I" * n, [(name, "") for name in names]) for n in range(3) for names in itertools.product(("user", "assistant"), repeat=n)]
    ways = list(gap)
    for role, text, fault in rows:
        own = [(4, "D", [])]
        if fault not in ("b", "d"):
            more = 3 if fault == "t" else 0
            own.append((more, "K", [(role, text)]))
            own += [(3 + more, "R", [(new, text)]) for new in ("user", "assistant")]
        ways = [(a + b + c, x + y + z, p + q + r) for a, x, p in ways for b, y, q in own for c, z, r in gap]
    return ways


def brute(rows):
    good = [(c, e, t) for c, e, t in edit_lists(rows) if LEGAL.fullmatch("".join(r[:1] for r, _ in t)) and all(r for r, _ in t)]
    return min(good, key=lambda w: (w[0], w[1]))


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_and_first(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", " ", "tool", ""]
    rows = [(rng.choice(roles), str(k), rng.choice(["", "", "t", "d", "b"])) for k in range(rng.randint(0, 3))]
    cost, edits, turns = brute(rows)
    assert repair.audit((r, f) for r, _, f in rows) == (cost, edits)
    made, _ = repair._repaired([(None, *r) for r in rows], edits, repair.NOTHING)
    assert [(t["role"], t["text"]) for t in made] == turns


def simple(rows):
    """The same by texts instead of nodes."""
    best = {0: (0, "")}

    def insert(b):
        b = dict(b)
        for s in (0, 1, 3, 2):
            if s in b:
                new = (b[s][0] + 3, b[s][1] + "I")
                b[repair._WANTED[s]] = min(b.get(repair._WANTED[s], new), new)
        return b

    for role, fault in rows:
        after = {}
        for s, (c, e) in insert(best).items():
            ways = [(s, c + 4, "D")]
            if fault not in ("b", "d"):
                c += 3 * (fault == "t")
                ways.append((repair._WANTED[s], c + 3, "R"))
                if s in repair._KEPT.get(role[:1], {}).keys():
                    ways.append((repair._KEPT[role[:1]][s], c, "K"))
            for to, cost, letter in ways:
                after[to] = min(after.get(to, (cost, e + letter)), (cost, e + letter))
        best = after
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def expected(table):
    """Rows of the digest by plain Python."""
    one = lambda v: " " if v is None else v
    held = {}
    for conv, turn, role, text in table:
        rows = held.setdefault(conv, [])
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, edits = simple([(r, f) for r, _, f in marked])
        turns, _ = repair._repaired([(None, *r) for r in marked], edits, repair.NOTHING)
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [f for *_, f in marked]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, edits, digest))
    return out


def conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut of", "", " \n", None, "Why?", "Long. " * 40, "a\tb? \r\n"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, ""]
    table = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 12)) if rng.random() < 0.9]
    table += [(99, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "user", f"{t % 50}{'.' if t % 7 else ''}") for t in range(700)]
    table += [(None, 1, "user", "Hm."), (None, None, None, None), (7, None, "user", "x."), (7, None, "user", "x."), (8, 3, "user", "Yes."), (8, 3, "assistant", "No.")]
    return table + table[:5]


def frame(spark, table):
    return spark.createDataFrame([(*r, "x", "y", "z", "p") for r in table], SCHEMA).repartition(3)


def test_digest(spark):
    table = conversations()
    cases.same(repair.repair_digest(frame(spark, table)).collect(), expected(table))


@pytest.mark.parametrize(("most", "letters"), [(1, 1 << 20), (7, 1 << 20), (100, 50)])
def test_stretches_join(spark, most, letters):
    table = conversations()
    made = repair.repair_conversations(repair.damage(frame(spark, table)), most, letters)
    last = made.where("sha256 IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256")
    want = [r for r in expected(table) if r[6] or r[7]]
    cases.same(last.collect(), want)
    turns = made.orderBy("part", "number").select("conv_id", F.explode("turns").alias("t")).collect()
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append(f"{r.t.role}:{r.t.text}")
    assert {r[0]: hashlib.sha256("\n".join(by.get(r[0], [])).encode()).hexdigest() for r in want} == {r[0]: r[8] for r in want}


def test_copies_in_bulk(spark):
    """One row doubled many times over is one row until its stretches are laid out."""
    rows = spark.createDataFrame([(1, 0, "user", "Go on.", 5000), (1, 1, "assistant", "So.", 1)], "conv_id long, turn long, role string, text string, copies long")
    got = repair.repair_conversations(rows).where("audit IS NOT NULL").first()
    assert (got.audit, got.cost, got.duplicate) == ("K" + "D" * 4999 + "K", 4 * 4999, 4999)


def test_a_third_of_all_rows_in_one_conversation(spark):
    table = [(1, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(2, 3000)]
    rows = frame(spark, table).withColumn("copies", F.lit(1).cast("long"))
    made = repair.repair_conversations(rows, most=100)
    got = made.where("conv_id = 1")
    assert got.count() >= 30 and got.where("audit IS NOT NULL").first().audit == "K" * 3000


def test_no_rows(spark):
    none = frame(spark, conversations()).where("false")
    assert repair.repair_digest(none).count() == 0
    # 1:12 is a row that the damage drops
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair.repair_digest(frame(spark, [(1, dropped, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 5])
def test_tree(modulus):
    """Order of texts, also where most hashes collide."""
    rng = random.Random(1)
    tree, texts = AuditTree(modulus), {0: b""}
    for _ in range(300):
        parent = rng.choice([0, *range(max(0, len(texts) - 6), len(texts))])
        label = bytes(rng.choices(b"DIKR", k=rng.choice([1, 1, 1, 9])))
        node = tree.grow(parent, label)
        texts[node] = texts[parent] + label
    for _ in range(3000):
        x, y = rng.choice(list(texts)), rng.choice(list(texts))
        assert tree.less(x, y) == (texts[x] < texts[y])
        n = rng.randint(0, len(texts[x]))
        assert tree.prefix_hash(x, n) == tree._extend(0, texts[x][:n])
    assert all(tree.text(k) == v for k, v in texts.items())
    assert (tree.collisions > 0) == (modulus == 5)
