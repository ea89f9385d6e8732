"""Repair of the order of speakers in conversations by the cheapest edits.

Each row of a conversation, by turn, is kept (0), given another role (3) or deleted (4), and empty turns may be put in
anywhere (3), so that the initials of the roles read ``(s?(ua)+)?``. Blank and duplicate rows have to be deleted, a truncated
row that stays costs 3 more. Of the cheapest lists of edits the one whose initials ``D I K R`` come first is the *audit*.

What was read before a row matters only by one of four states: nothing kept, system, user or assistant last. So a stretch of
rows is a small table: for each state before it and each behind it the least cost and the first such audit. Stretches
of one conversation join like links of a chain, and none needs the others: rows are laid out by ranges of (conversation,
turn), cut into stretches of at most ``ROWS`` rows, and only the tables meet. A conversation may hold any share of
the rows. Two edits lists of equal cost that lead to the same state never are prefixes of each other, as what is
longer by insertions costs more; that is why the first one stays the first whatever follows.

Edits lists are nodes of an ``AuditTree``; ties are decided by the longest common prefix.

Defined cases: nulls are one space, but a null ``conv_id`` is a conversation and a null turn comes first and counts for no
gap; rows of equal turn go by role, then by the SHA-256 of the text; repeated rows are duplicates after the first; an empty role
has no initial and cannot stay; a conversation without rows has an empty audit; an empty table gives none; extra columns are
ignored. The audit of one conversation has to fit a cell of Spark (2 GB), its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaksieve.llm.audittree import AuditTree
from leaksieve.session import materialise

ROWS = 1024  # rows of a stretch
LETTERS = 1 << 20  # and characters of its texts
WHITE = " \t\n\x0b\f\r"

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
# Where an initial leads from a state.
_KEPT = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
# Where a turn of whatever role is wanted leads to.
_WANTED = (USER, USER, ASSISTANT, USER)
_LEGAL = {"su", "ua", "au"}
_NAMES = {USER: "user", ASSISTANT: "assistant"}

Best = dict[int, tuple[int, int]]  # state: cost, node


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by a hash of their place: dropped, emptied, without ends of sentences, doubled (``copies``), or the user's."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(place.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def find_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, digest, fault``: equal rows are one with the number of its ``copies``.

    ``fault`` is that of the first copy: ``b``\\ lank, ``d``\\ uplicate, ``t``\\ runcated or empty. Copies are counted before
    they move; only what a conversation says twice, at different turns, is looked up again.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    said = said.where(F.col("first") != F.col("last"))
    said = said.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_t"), F.lit(True).alias("_twice"))
    rows = rows.groupBy("conv_id", "turn", "role", "text", "digest").agg(F.sum("copies").alias("copies"))
    rows = rows.join(said, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    bare = F.rtrim("text", F.lit(WHITE))
    later = F.col("_twice").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_t"))
    fault = F.when(bare == "", "b").when(later, "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.select("conv_id", "turn", "role", "text", "copies", "digest", fault.alias("fault"))


def _better(tree: AuditTree, best: Best, state: int, cost: int, node: int, letter: bytes) -> None:
    known = best.get(state)
    if known is None or cost < known[0]:
        best[state] = cost, tree.grow(node, letter)
    elif cost == known[0]:
        new = tree.grow(node, letter)
        if tree.less(new, known[1]):
            best[state] = cost, new


def _inserted(tree: AuditTree, best: Best) -> Best:
    """With empty turns put in; two at most can be worth it, the user's before the assistant's."""
    best = dict(best)
    for state in (NOTHING, SYSTEM, ASSISTANT, USER):
        if state in best:
            cost, node = best[state]
            _better(tree, best, _WANTED[state], cost + INSERT, node, b"I")
    return best


def _step(tree: AuditTree, best: Best, initial: str, fault: str) -> Best:
    best, after = _inserted(tree, best), {}
    for state, (cost, node) in best.items():
        _better(tree, after, state, cost + DELETE, node, b"D")
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            kept = _KEPT.get(initial, {}).get(state)
            if kept is not None:
                _better(tree, after, kept, cost + KEEP + more, node, b"K")
            _better(tree, after, _WANTED[state], cost + REROLE + more, node, b"R")
    return after


def _finish(tree: AuditTree, best: Best) -> tuple[int, int]:
    """Cost and node of the best end: nothing is left, or the assistant spoke last."""
    best = _inserted(tree, best)
    ends = [best[s] for s in (NOTHING, ASSISTANT) if s in best]
    least = min(cost for cost, _ in ends)
    nodes = [node for cost, node in ends if cost == least]
    return least, nodes[1] if len(nodes) > 1 and tree.less(nodes[1], nodes[0]) else nodes[0]


def audit(rows: Iterable[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of a conversation's rows ``(role, fault)``."""
    tree = AuditTree()
    best: Best = {NOTHING: (0, tree.root)}
    for role, fault in rows:
        best = _step(tree, best, role[:1], fault)
    cost, node = _finish(tree, best)
    return cost, tree.text(node).decode()


def _table(rows: list[tuple]) -> list[dict]:
    """For each state before and behind a stretch the cost and the audit."""
    out = []
    for begin in STATES:
        tree = AuditTree()
        best: Best = {begin: (0, tree.root)}
        for _, role, _, fault in rows:
            best = _step(tree, best, role[:1], fault)
        out += [{"begin": begin, "end": s, "cost": c, "audit": tree.text(n).decode()} for s, (c, n) in best.items()]
    return out


def _repaired(rows: list[tuple], edits: str, state: int) -> tuple[list[dict], int]:
    """The turns that the edits leave of a stretch, and the state behind it."""
    turns, at = [], iter(rows)
    for edit in edits:
        if edit != "I":
            _, role, text, _ = next(at)
            if edit == "D":
                continue
        if edit in "IR":
            role = _NAMES[_WANTED[state]]
        turns.append({"edit": edit, "role": role, "text": "" if edit == "I" else text})
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
    return turns, state


def _said(turns: list[dict], first: bool) -> bytes:
    said = "\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()
    return said if first or not turns else b"\n" + said


def _counts(rows: list[tuple]) -> dict:
    """What a stretch tells of its faults; ``joins`` are its outer initials, ``turns`` its outer known turns."""
    faults = [r[3] for r in rows]
    initials = [r[1][:1] for r in rows]
    known = [r[0] for r in rows if r[0] is not None]
    return {
        "rows": len(rows),
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "joins": [initials[0], initials[-1]],
        "turns": [known[0], known[-1]] if known else [],
        "distinct": len(set(known)),
    }


def _together(parts: list[dict]) -> dict:
    """The counts of a conversation from those of its stretches."""
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["joins"][1] + b["joins"][0] not in _LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["turns"]]
    gaps = 0
    if known:
        distinct = sum(p["distinct"] for p in known) - sum(a["turns"][1] == b["turns"][0] for a, b in zip(known, known[1:]))
        gaps = known[-1]["turns"][1] - known[0]["turns"][0] + 1 - distinct
    return {"gaps": gaps, **total}


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_TURNS = "array<struct<edit:string,role:string,text:string>>"
_STRETCH = f"""part int, number int, {_COUNTS}, turns {_TURNS}, sha256 string,
 rows array<struct<turn:bigint,role:string,text:string,fault:string>>,
 counts struct<rows:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,joins:array<string>,turns:array<bigint>,`distinct`:bigint>,
 `table` array<struct<begin:int,end:int,cost:bigint,audit:string>>"""


def _schema(key: T.StructField, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key.dataType, True), *T._parse_datatype_string(f"struct<{rest}>").fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _stretches(most: int, letters: int, schema: T.StructType):
    """A function over sorted rows of a partition: whole conversations repaired, the others in stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, form = TaskContext.get().partitionId(), _arrow(schema)
        names = form.names
        ready: list[dict] = []
        number = size = 0
        rows: list[tuple] = []
        at, cut, first = None, False, True

        def put(last: bool) -> None:
            """A stretch ends; ``last``: and its conversation may go on elsewhere."""
            nonlocal number, size, rows, cut
            row = dict.fromkeys(names) | {"conv_id": at, "part": part, "number": number}
            if cut or first or last:
                keys = ("turn", "role", "text", "fault")
                row |= {"rows": [dict(zip(keys, r)) for r in rows], "counts": _counts(rows), "table": _table(rows)}
            else:
                cost, edits = audit((r[1], r[3]) for r in rows)
                turns, _ = _repaired(rows, edits, NOTHING)
                digest = hashlib.sha256(_said(turns, True)).hexdigest()
                row |= _together([_counts(rows)]) | {"cost": cost, "audit": edits, "turns": turns, "sha256": digest}
            ready.append(row)
            number, size, rows = number + 1, 0, []

        started = False
        for batch in batches:
            for key, turn, role, text, copies, fault in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if not started:
                    at, started = key, True
                elif key != at:
                    if rows:
                        put(False)
                    at, cut, first = key, False, False
                while copies:
                    if len(rows) >= most or size > letters:
                        cut = True
                        put(False)
                    if fault in ("b", "d"):
                        text = ""  # it goes in any case
                    rows.append((turn, role, text, fault))
                    size, copies = size + len(text), copies - 1
                    fault = "b" if fault == "b" else "d"
                    if len(ready) >= 64 or ready and ready[-1]["rows"]:
                        yield pa.RecordBatch.from_pylist(ready, schema=form)
                        ready = []
        if rows:
            put(True)
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=form)

    return run


def _joined(schema: T.StructType):
    """A function over the tables of one conversation's stretches: the edits of each."""

    def run(tables: pa.Table) -> pa.Table:
        parts = sorted(tables.to_pylist(), key=lambda p: (p["part"], p["number"]))
        tree = AuditTree()
        best: Best = {NOTHING: (0, tree.root)}
        for p in parts:
            after: Best = {}
            for way in p["table"]:
                if way["begin"] in best:
                    cost, node = best[way["begin"]]
                    _better(tree, after, way["end"], cost + way["cost"], node, way["audit"].encode())
            best = after
        cost, node = _finish(tree, best)
        edits = tree.text(node).decode()
        # a stretch takes its rows' edits and the insertions before them; the last one those at the end too
        out, low = [], 0
        for k, p in enumerate(parts):
            high, left = low, p["counts"]["rows"]
            while left or (k + 1 == len(parts) and high < len(edits)):
                left -= edits[high] != "I"
                high += 1
            out.append({"conv_id": p["conv_id"], "part": p["part"], "number": p["number"], "edits": edits[low:high]})
            low = high
        for row in out:
            row |= dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
        out[-1] |= _together([p["counts"] for p in parts]) | {"cost": cost, "audit": edits}
        return pa.Table.from_pylist(out, schema=_arrow(schema))

    return run


def _told(schema: T.StructType):
    """A function over sorted stretches with their edits: the turns of each, the hash with a conversation's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = _arrow(schema)
        state, fresh, digest = NOTHING, True, hashlib.sha256()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = [(r["turn"], r["role"], r["text"], r["fault"]) for r in row.pop("rows")]
                turns, state = _repaired(rows, row.pop("edits"), state)
                digest.update(_said(turns, fresh))
                fresh = fresh and not turns
                row["turns"] = turns
                row["sha256"] = None
                if row["audit"] is not None:  # the conversation's last
                    row["sha256"] = digest.hexdigest()
                    state, fresh, digest = NOTHING, True, hashlib.sha256()
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=form)

    return run


def repair_conversations(rows: DataFrame, most: int = ROWS, letters: int = LETTERS) -> DataFrame:
    """The repaired turns of conversations, in pieces.

    ``conv_id, part, number`` order the pieces, ``turns`` are their ``(edit, role, text)``. The last piece of each conversation
    also has the counts of its faults, ``cost``, ``audit`` and the ``sha256`` of its turns; in the others these are null.
    ``rows`` need ``conv_id, turn, role, text, copies``.
    """
    key = rows.schema["conv_id"]
    laid = find_faults(rows).repartitionByRange("conv_id", "turn", "role", "digest")
    laid = laid.sortWithinPartitions("conv_id", "turn", "role", "digest")
    laid = laid.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", "fault")
    schema = _schema(key, _STRETCH)
    stretches = materialise(laid.mapInArrow(_stretches(most, letters, schema), schema), "stretches")

    whole = stretches.where("sha256 IS NOT NULL")
    pieces = ["conv_id", "part", "number", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    split = stretches.where("sha256 IS NULL")
    schema = _schema(key, f"part int, number int, edits string, {_COUNTS}")
    edits = split.select("conv_id", "part", "number", "counts", "table").groupBy("conv_id").applyInArrow(_joined(schema), schema)
    edits = edits.withColumnsRenamed({"part": "_p", "number": "_n"}).drop("conv_id")
    schema = _schema(key, f"part int, number int, {_COUNTS}, turns {_TURNS}, sha256 string")
    joined = split.select("conv_id", "part", "number", "rows").join(edits, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n")))
    joined = joined.select(*pieces, "rows", "edits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return whole.select(*pieces, "turns", "sha256").unionByName(joined.mapInArrow(_told(schema), schema))


def repair_digest(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the input, also for those of which the damage left nothing."""
    made = repair_conversations(damage(conversations)).where("sha256 IS NOT NULL").drop("part", "number", "turns")
    made = made.withColumnRenamed("conv_id", "_c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(made, F.col("conv_id").eqNullSafe(F.col("_c")), "left")

    def filled(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value).alias(name)

    counts = [filled(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return joined.select("conv_id", *counts, filled("audit", F.lit("")), F.coalesce("sha256", nothing).alias("repaired_sha256"))
