"""Maps and scopes of file trees at any depth, and running values by ranges, against plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import findings as fi
from leaksieve.operators import scope as sc
from leaksieve.operators import tree as tr
from leaksieve.operators.ordered import as_of, laid_out, running
from leaksieve.operators.rules import RuleSet, load_patterns, validate_rules
from leaksieve.options import ScanOptions
from leaksieve.plans.scan import read_platform
from leaksieve.sources.maps import read_map, read_tree_map, write_map_documents, write_tree_map

PATHS = [
    "a/b/c.txt", "a/b/d.txt", "a/x.txt", "a/b/e/f/g.txt", "a/b2/z", "a/b!/z", "b/1", 'a b/ü"/q\n.txt', "top", "/abs/f", "/f",
    "a/b/e/h", "deep" + "/n" * 25 + "/f", "a/\\u/{}[]", "c/" + "x" * 300,
] + [f"big/{k:04d}.txt" for k in range(60)]


def files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)


def nodes(paths, levels=-1):
    """path: (name, kind, depth, empty)"""
    out = {}
    for path in paths:
        parts = path.split("/")
        for k in range(1, len(parts)):
            if levels >= 0 and k - 1 > levels:
                break
            name = "/".join(parts[:k]) or "/"
            out[name] = (parts[k - 1], "directory", k - 1, levels == k - 1)
        if levels < 0 or len(parts) - 1 <= levels:
            out[path] = (parts[-1], "file", len(parts) - 1, False)
    return out


def read(frame):
    rows = frame.collect()
    assert len(rows) == len({r.path for r in rows})
    return {r.path: (r.name, r.kind, r.depth, r.empty) for r in rows}


@pytest.mark.parametrize(("most", "levels"), [(1, -1), (3, -1), (50_000, -1), (50_000, 0), (2, 2), (50_000, 3)])
def test_tree_maps_go_both_ways(spark, tmp_path, most, levels):
    path = write_tree_map(files(spark, PATHS), f"{tmp_path}/map", levels, most)
    lines = [r.value for r in spark.read.text(path).collect()]
    tops = {json.loads(line)["path"] for line in lines}
    assert tops == {p.split("/")[0] or "/" for p in PATHS if p != "top"} | {"top"}
    assert len(lines) >= len(tops)
    if most == 1 and levels < 0:
        assert len(lines) == len(PATHS)  # none gathers more than it may
    assert read(read_tree_map(spark, path)) == nodes(PATHS, levels)


def test_one_document_over_many_lines(spark, tmp_path):
    """The form that a whole directory's map has as a file."""
    nested = {
        "type": "directory", "name": "r", "path": "/r", "files": [{"name": "f", "path": "/r/f"}],
        "subdirectories": [{"type": "directory", "name": "e", "path": "/r/e", "files": [], "subdirectories": []}],
    }
    file = tmp_path / "map.json"
    file.write_text(json.dumps(nested, indent=2))
    got = read(read_tree_map(spark, str(file), lines=False))
    assert got == {"/r": ("r", "directory", 0, False), "/r/f": ("f", "file", 1, False), "/r/e": ("e", "directory", 1, True)}


def test_empty_map(spark, tmp_path):
    path = write_tree_map(files(spark, PATHS).where("false"), f"{tmp_path}/map")
    assert read_tree_map(spark, path).count() == 0


def covered(path, listed):
    for name, kind, empty in listed:
        name = name if name == "/" else name.rstrip("/")
        if kind == "file" and path == name:
            return True
        below = path.startswith("/") if name == "/" else not name or path.startswith(name + "/")
        if kind == "directory" and empty and below:
            return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_scope_at_any_depth(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "ab", "a!", "a0", "é", "a.b", "0"]
    paths = sorted({("/" if rng.random() < 0.2 else "") + "/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(400)})
    listed = []
    for _ in range(25):
        path = rng.choice(paths)
        parts = path.split("/")
        if rng.random() < 0.4:
            listed.append((path, "file", False))
        else:
            listed.append(("/".join(parts[: rng.randint(1, len(parts))]) or "/", "directory", rng.random() < 0.7))
    listed = [x for x in listed if rng.random() < 0.8 or x[1] == "file"] + [("a/", "directory", seed == 1)] * (seed > 1)
    # a directory counts as empty only if no row says otherwise
    whole = {p for p, k, e in listed if k == "directory" and e} - {p for p, k, e in listed if k == "directory" and not e}
    want = [p for p in paths if covered(p, [(p2, k, k == "directory" and p2 in whole) for p2, k, _ in listed])]
    content = files(spark, paths + paths[:5]).withColumn("stop", F.lit("x"))
    scope = spark.createDataFrame(listed, "path string, kind string, empty boolean")
    got = sorted(r.path for r in tr.tree_scope_join(content, scope).collect())
    assert got == sorted(want + [p for p in paths[:5] if p in want])
    only = [p for p in paths if covered(p, [x for x in listed if x[1] == "file"])]
    got = sorted({r.path for r in tr.tree_scope_join(content, scope, empty_means_all=False).collect()})
    assert got == only


def test_scope_edge_cases(spark):
    content = spark.createDataFrame([("x/y",), (None,), ("z",)], "path string")
    none = spark.createDataFrame([], "path string, kind string, empty boolean")
    assert tr.tree_scope_join(content, none).count() == 0
    everything = spark.createDataFrame([("", "directory", True)], none.schema)
    assert sorted(r.path for r in tr.tree_scope_join(content, everything).collect()) == ["x/y", "z"]
    assert tr.tree_scope_join(content.where("false"), everything).count() == 0


def test_local_scan_of_a_mapped_tree(spark, tmp_path):
    """A folder's own map limits its scan, whole or in parts."""
    for path in ("a/b/c.txt", "a/b/d/e.txt", "a/x.txt", "b/y.txt"):
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text("x")
    base = f"{tmp_path}/in"
    listed = spark.createDataFrame([(f"{base}/a/b", "directory", True), (f"{base}/b/y.txt", "file", False)], "path string, kind string, empty boolean")
    urls = lambda scope=None: {r.url for r in read_platform(spark, "local", ScanOptions(scan_path=base, scope=scope), scope_map=listed).collect()}
    want = {f"{base}/a/b/c.txt", f"{base}/a/b/d/e.txt", f"{base}/b/y.txt"}
    assert urls() == want and urls("1/2") | urls("2/2") == want and not urls("1/2") & urls("2/2")


def test_directory_with_most_of_the_content_is_spread(spark):
    content = spark.range(4000).select(F.concat(F.lit("hot/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"))
    scope = spark.createDataFrame([("hot", "directory", True)], "path string, kind string, empty boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one range
    try:
        laid = laid_out(content.withColumn("_kind", F.lit(1)), ["path", "_kind"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r.n for r in laid.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert tr.tree_scope_join(content, scope).count() == 4000


ASANA = [("w", "p1", "t", "s1"), ("w", "p1", "t", 's"2'), ("w", "p1", "u", None), ("w", "p2", None, None), ("v", None, None, None), ("é", "p", "t", "s")]
GITHUB = [("r", "main", "a/b.txt", None), ("r", "main", "c", None), ("r", "dev", None, None), ("q", None, None, None)]
JIRA = [("P", "P-1", None, None), ("P", "P-2", None, None), ("X", None, None, None)]


@pytest.mark.parametrize(("platform", "rows"), [("asana", ASANA), ("github", GITHUB), ("jira", JIRA)])
@pytest.mark.parametrize("most", [1, 2, 1000])
def test_map_documents(spark, tmp_path, platform, rows, most):
    table = spark.createDataFrame([(platform, *r) for r in rows], "platform string, l1 string, l2 string, l3 string, l4 string")
    path = write_map_documents(table.unionByName(table), f"{tmp_path}/map", platform, most)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(len(next(iter(d.values()))) == 1 for d in lines)  # one top container each
    assert len(lines) == len(rows) if most == 1 else len(lines) >= len({r[0] for r in rows})
    got = read_map(spark, path, platform, lines=True).select("l1", "l2", "l3", "l4").distinct()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("how", ["max", "sum"])
def test_running(spark, how):
    rng = random.Random(1)
    rows = [(k, None if rng.random() < 0.2 else rng.randint(-5, 50)) for k in rng.sample(range(1000), 300)]
    laid = laid_out(spark.createDataFrame(rows, "k int, v bigint").repartition(5), ["k"])
    got = {r.k: r.r for r in running(laid, "v", "r", how).collect()}
    best = None
    for k, v in sorted(rows):
        if v is not None:
            best = v if best is None else max(best, v) if how == "max" else best + v
        assert got[k] == best


def test_as_of(spark):
    rng = random.Random(2)
    history = [(rng.choice("aab"), rng.randint(0, 60), f"v{rng.randint(0, 9)}") for _ in range(80)] + [(None, 3, "n"), ("a", None, "n")]
    rows = [(rng.choice("aaaabc"), rng.randint(-2, 70), k) for k in range(200)] + [(None, 5, 900), ("a", None, 901)]
    frame = spark.createDataFrame(rows, "id string, t int, n int").repartition(3)
    got = {r.n: r.v for r in as_of(frame, spark.createDataFrame(history, "id string, t int, v string"), "id", "t", ["v"]).collect()}
    assert len(got) == len(rows)
    for i, t, n in rows:
        known = [(a, v) for j, a, v in history if j == i and a is not None and t is not None and i is not None and a <= t]
        assert got[n] == (max(known)[1] if known else None), (i, t)


VERDICTS = [("x", "live", "d1", 1, 1), ("x", "invalid", None, 5, 2), ("x", "live", "d0", 5, 9), ("y", "invalid", "d", 7, 7), ("z", "live", "d", None, 1)]


def verdict_table(spark):
    rows = [(i, s, d, None if a is None else dt.datetime(2024, 1, a), dt.datetime(2024, 1, e)) for i, s, d, a, e in VERDICTS]
    return spark.createDataFrame(rows, "id string, status string, detail string, at timestamp, seen timestamp")


def test_verdicts_over_time(spark):
    found = spark.createDataFrame(
        [("x", dt.datetime(2024, 1, d), d, "own") for d in (1, 4, 6)] + [("y", dt.datetime(2024, 1, 6), 16, "own"), ("z", dt.datetime(2024, 1, 6), 26, None)],
        "id string, ts timestamp, n int, detail string",
    )
    verdicts = verdict_table(spark)
    at = fi.apply_verdicts_at(found, verdicts.drop("seen"), "2024-01-04")
    assert {r.n: (r.detail, r.status) for r in at.collect()} == {1: ("d1", "live"), 4: ("d1", "live"), 6: ("d1", "live"), 16: ("own", None), 26: (None, None)}
    of = fi.verdicts_as_of(found, verdicts.drop("seen"))
    # of two at one moment the larger status counts, and its own detail
    assert {r.n: (r.detail, r.status) for r in of.collect()} == {1: ("d1", "live"), 4: ("d1", "live"), 6: ("d0", "live"), 16: ("own", None), 26: (None, None)}
    late = fi.late_verdicts(found, verdicts, "2024-01-05").collect()
    assert [(r.n, r.detail, r.status) for r in late] == [(6, "d0", "live")]
    assert fi.late_verdicts(found, verdicts, "2024-02-01").count() == 0


def test_contiguous_parts(spark):
    rows = [("hot", f"{k:05d}") for k in range(1800)] + [(f"c{k:03d}", "x") for k in range(200)] + [(None, "y")]
    table = spark.createDataFrame(rows, "l1 string, l2 string").repartition(4)
    got = [tuple(r) for r in sc.scope_parts_contiguous(table, 7).collect()]
    assert sorted(r[:2] for r in got if r[0]) == sorted(r for r in rows if r[0])
    by = sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    parts = [r[2] for r in by]
    assert parts == sorted(parts) and set(parts) == set(range(1, 8))
    sizes = [sum(len(r[0] or "") + len(r[1]) + 2 for r in by if r[2] == p) for p in range(1, 8)]
    assert max(sizes) < 1.2 * sum(sizes) / 7
    third = sc.scope_chunk_contiguous(table, 3, 7)
    assert third.columns == table.columns and third.count() == parts.count(3)
    with pytest.raises(ValueError):
        sc.scope_chunk_contiguous(table, 8, 7)


def plain_windows(days, now, most):
    today, counts = dt.date.fromisoformat(now), {}
    for day in days:
        counts[day] = counts.get(day, 0) + 1
    first = today - dt.timedelta(days=most)
    rows, width, start, end, used = [], 1, today - dt.timedelta(days=1), today + dt.timedelta(days=1), 0
    while used < most:
        n = sum(c for day, c in counts.items() if start < day < end and first < day <= today)
        rows.append((len(rows), start, end, n))
        width = 1 if n else width * 2
        end, start = start + dt.timedelta(days=1), start - dt.timedelta(days=width)
        used += width
    later, before = (sum(c for day, c in counts.items() if test(day)) for test in (lambda x: x > today, lambda x: x <= first))
    rows += [(-1, today, None, later)] * bool(later) + [(-2, None, first + dt.timedelta(days=1), before)] * bool(before)
    return sorted(rows)


@pytest.mark.parametrize("most", [36500, 400, 7, 1])
@pytest.mark.parametrize("n", [0, 5, 300])
def test_day_windows(spark, most, n):
    rng = random.Random(n)
    now = dt.date(2024, 2, 10)
    days = [now - dt.timedelta(days=rng.choice([rng.randint(-3, 20), rng.randint(0, 300), rng.randint(100, 130), rng.randint(0, 40000)])) for _ in range(n)]
    found = sc.day_windows(spark.createDataFrame([(d,) for d in days], "ts date"), str(now), max_days=most)
    assert sorted(tuple(r) for r in found.collect()) == plain_windows(days, str(now), most)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_rules_are_validated_in_columns(spark):
    rules = spark.createDataFrame(
        [("ok", "(?P<n>a+)b", "aab"), ("no", "x{2}", "x"), ("bad", "(", "x"), ("none", "", "x"), ("empty", "a", None), ("twice", "x{2}", "xx"), ("cond", "(a)?(?(1)b|c)", "ab")],
        "id string, regex string, example string",
    )
    got = validate_rules(rules)
    assert {r.rule_id: r.status for r in got.collect()} == {
        "ok": "ok", "no": "mismatch", "bad": "invalid", "none": "missing", "empty": "missing", "twice": "ok", "cond": "invalid",
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        load_patterns(rules, max_patterns=2)
    assert validate_rules(RuleSet.from_df(rules)).where("status = 'ok'").count() == 2
