"""Sources, flattening, scope, findings, comments."""

import hashlib

from pyspark.sql import functions as F

from leaksieve import ScanOptions, scan, scan_platform
from leaksieve.functions import text as tx
from leaksieve.operators import comments as cm
from leaksieve.operators import findings as fi
from leaksieve.operators import flatten as fl
from leaksieve.operators import matching as mt
from leaksieve.operators import scope as sc
from leaksieve.operators.rules import RuleSet
from leaksieve.sources import files
from leaksieve.sources.union import platform_key, union_sources

RULES = RuleSet.from_dict({"rules": [{"id": "r", "description": "d", "regex": "AB[0-9]{4}", "example": "AB0000"}]})


def tickets(spark):
    rows = [
        ("Jira", "1", "u/1", "a title", "leak AB1234 here"),
        ("Jira", "2", "u/2", "", None),
        ("Jira", "3", "u/3", "AB7777", "BOT-Label AB8888"),
    ]
    return spark.createDataFrame(rows, "platform string, issue_id string, url string, title string, description string")


def comments(spark):
    rows = [
        ("Jira", "1", 0, "a AB1111 b"),
        ("Jira", "1", 1, "a AB2222 b"),
        ("Jira", "2", 0, ""),
        ("Jira", "2", 5, "second AB5555"),
        ("Jira", "3", 0, "seen: bot-LABEL"),
    ]
    return spark.createDataFrame(rows, "platform string, issue_id string, item_ord bigint, text string")


def test_flatten_keeps_order_and_drops_empty(spark):
    texts = fl.flatten_fields(tickets(spark), comments(spark)).orderBy("issue_id", "field_ord", "item_ord")
    got = [(r.issue_id, r.field, r.text) for r in texts.collect()]
    assert got == [
        ("1", "title", "a title"),
        ("1", "description", "leak AB1234 here"),
        ("1", "comments", "a AB1111 b"),
        ("1", "comments", "a AB2222 b"),
        ("2", "comments", "second AB5555"),
        ("3", "title", "AB7777"),
        ("3", "description", "BOT-Label AB8888"),
        ("3", "comments", "seen: bot-LABEL"),
    ]


def test_label_skips_text_and_empty_label_skips_all(spark):
    texts = fl.flatten_fields(tickets(spark), comments(spark))
    assert fl.drop_labelled_text(texts, "bot-label").count() == texts.count() - 2
    assert fl.drop_labelled_text(texts, "").count() == 0


def test_nested_comments_become_rows(spark):
    df = spark.createDataFrame([("Linear", "x", ["one", "two"])], "platform string, issue_id string, comments array<string>")
    assert [(r.item_ord, r.text) for r in fl.explode_comments(df).collect()] == [(0, "one"), (1, "two")]


def test_scan_redacts_dedups_and_keeps_secrets_out(spark):
    options = ScanOptions(config_label="bot-label", post_comment=True)
    result = scan(tickets(spark), comments(spark), RULES, options)
    found = {(r.url, r.secret): r for r in result.findings.collect()}
    # both comments of ticket 1 read the same once redacted: one finding, the first one
    assert set(found) == {
        ("u/1", "leak <REDACTED> here"),
        ("u/1", "a <REDACTED> b"),
        ("u/2", "second <REDACTED>"),
        ("u/3", "<REDACTED>"),
    }
    first = found["u/1", "a <REDACTED> b"]
    assert first.id == hashlib.sha256(b"u/1_a <REDACTED> b").hexdigest()
    assert not any(s in str(r) for r in found.values() for s in ("AB1234", "AB1111", "AB2222", "AB5555", "AB7777"))
    sensitive = {r.sensitive_secret for r in result.sensitive_findings.collect()}
    assert sensitive == {"AB1234", "AB1111", "AB5555", "AB7777"}
    # comments are posted per match, also for copies, but not on the ticket that was warned before
    posted = sorted(r.issue_id for r in result.outbox.collect())
    assert posted == ["1", "1", "1", "2"]


def test_comment_texts_are_not_shuffled(spark):
    result = scan(tickets(spark), comments(spark), RULES)
    plan = result.matches._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "Generate explode" in plan[join:], "matching happens below the join with the tickets"


def test_skipping_comments_drops_their_scan(spark):
    result = scan(tickets(spark), comments(spark), RULES, ScanOptions(skip_comment=True))
    plan = result.matches._jdf.queryExecution().optimizedPlan().toString()
    assert "item_ord#" not in plan.split("LogicalRDD")[-1]
    assert result.matches.where("field = 'comments'").count() == 0


def test_line_anchor_only_on_file_platforms(spark):
    df = spark.createDataFrame([("GitHub", 3), ("Jira", 3), ("LocalFilesystem", 0)], "platform string, line int")
    got = [r.u for r in df.select(fi.source_url(F.lit("x"), F.col("platform"), F.col("line")).alias("u")).collect()]
    assert got == ["x#L3", "x", "x"]


def test_verdicts_replace_only_what_they_answer(spark):
    f = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, secret string")
    v = spark.createDataFrame([("a", "live", None), ("a", "live", None), ("z", "invalid", None)], "id string, status string, secret string")
    got = {r.id: (r.secret, r.status) for r in fi.apply_verdicts(f, v).collect()}
    assert got == {"a": ("s1", "live"), "b": ("s2", None)}


def test_comment_template(spark):
    df = spark.createDataFrame(
        [("Slack", "file", "r", "d", "AB", "s <REDACTED>", "link")],
        "platform string, field string, rule_id string, rule_description string, rule_regex string, sanitized_secret string, url string",
    )
    text = cm.compose_comment(df, ScanOptions(message_template="{label}! {finding_info} {other}", label="L")).first().comment
    assert text.startswith("L! Platform:[Slack] Field:[file] ID:[r] Description:[d] Regex: AB\n")
    assert "{other}\nbot_name: leaksieve bot\nsecret_manager: " in text
    assert text.endswith("\nLeak source: link")


def test_encoding_per_platform(spark):
    rows = [(p, "https://x/archives/C1/p1234567890123456", "#1 <REDACTED>\n'q'") for p in ("Jira", "Confluence", "Wrike", "Linear", "Slack", "GitHub", "LocalFilesystem")]
    rows.append(("Slack", "no link", "text"))
    df = spark.createDataFrame(rows, "platform string, issue_id string, comment string")
    got = {r.platform: r for r in cm.encode_comment(df).collect()}
    assert set(got) == {"Jira", "Confluence", "Wrike", "Linear", "Slack"}
    assert '"text":"01 <REDACTED>\\n' in got["Jira"].payload and got["Jira"].payload.startswith('{"body":{"type":"doc"')
    assert got["Confluence"].payload == "01 &lt;REDACTED&gt;\n&#x27;q&#x27;"
    assert got["Wrike"].payload == "#1 **********<br>'q'"
    assert got["Linear"].payload == "#1 <REDACTED>\\n'q'"
    assert (got["Slack"].channel_id, got["Slack"].thread_ts) == ("C1", "1234567890.123456")


def test_message_link_without_match(spark):
    df = spark.createDataFrame([("nope",), (None,)], "l string")
    assert [tuple(r) for r in df.select(tx.parse_message_link(df.l).alias("x")).select("x.*").collect()] == [("", "")] * 2


def test_read_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("é\r\nAB1234\rz".encode())
    (tmp_path / "sub" / "b.bin").write_bytes(b"\xff\xfe AB1234")
    (tmp_path / "sub" / "c.txt").write_bytes(b"AB9999")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {r.url: r.file for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {f"{tmp_path}/a.txt": "é\nAB1234\nz", f"{tmp_path}/sub/c.txt": "AB9999"}


def test_code_host_bytes(spark):
    df = spark.createDataFrame(
        [("h", "w", "main", "p/x", b"a\xffb")], "html_url string, web_url string, branch string, path string, content binary"
    )
    a, b = files.norm_github(df).first(), files.norm_gitlab(df).first()
    assert (a.url, a.file) == ("h/blob/main/p/x", "ab")
    assert (b.url, b.file) == ("w/-/blob/main/p/x", "a�b")


def test_jira_comments_find_their_ticket(spark):
    """Comments know the internal id, findings the key."""
    issues = spark.createDataFrame(
        [("10", "P-1", "https://j/rest/api/2/issue/10", "s", "d"), ("12", "P-2", "https://j/rest/api/2/issue/12", "s", "d")],
        "id string, key string, self string, summary string, description string",
    )
    notes = spark.createDataFrame(
        [("10", 0, "x AB1234"), ("11", 0, "lost AB9999"), ("12", 0, "warned: LABEL")], "issue_id string, ord int, body string"
    )
    options = ScanOptions(config_label="label", post_comment=True)
    result = scan_platform(spark, "jira_scan", RULES, options, issues, notes)
    assert [(r.url, r.secret) for r in result.findings.collect()] == [("https://j/browse/P-1", "x <REDACTED>")]
    assert [r.issue_id for r in result.outbox.collect()] == ["P-1"]
    long = fl.attach_comments(result.tickets, result.comments)
    assert sorted((r.issue_id, r.comment) for r in long.collect()) == [("P-1", "x AB1234"), ("P-2", "warned: LABEL")]


def test_ticket_without_comments_keeps_a_row(spark):
    long = fl.attach_comments(tickets(spark), comments(spark).where("issue_id <> '1'"))
    got = sorted((r.issue_id, r.title, r.comment or "-") for r in long.collect())
    assert got == [("1", "a title", "-"), ("2", "", "-"), ("2", "", "second AB5555"), ("3", "AB7777", "seen: bot-LABEL")]


def test_scan_platform_scopes(spark, tmp_path):
    rows = [("Own", f"Repo{i}", "h", "w", "main", "main", f"p{i}", b"AB%04d" % i) for i in range(4)]
    export = spark.createDataFrame(
        rows, "owner string, repo string, html_url string, web_url string, branch string, default_branch string, path string, content binary"
    )
    urls = lambda **o: sorted(
        r.url for r in scan_platform(spark, "github", RULES, ScanOptions(**o), export).findings.collect()
    )
    assert urls(owner="own", repo="REPO2", branch="default") == ["h/blob/main/p2#L1"]
    assert urls(scope="query: path = 'p1'") == ["h/blob/main/p1#L1"]
    assert len(urls(scope="query: path = 'none'")) == 4 and urls(branch="dev") == []
    listed = spark.createDataFrame([("Repo1", None), ("Repo3", "p3")], "repo string, path string")
    parts = [
        r.url
        for i in (1, 2)
        for r in scan_platform(spark, "github", RULES, ScanOptions(scope=f"{i}/2"), export, None, listed).findings.collect()
    ]
    assert sorted(parts) == ["h/blob/main/p1#L1", "h/blob/main/p3#L1"]
    assert scan_platform(spark, "nowhere", RULES, ScanOptions(), export).findings.count() == 0
    (tmp_path / "f.txt").write_text("\nAB1234")
    local = scan_platform(spark, "local", RULES, ScanOptions(scan_path=str(tmp_path), tasks=2)).materialise()
    assert [r.url for r in local.findings.collect()] == [f"{tmp_path}/f.txt#L2"]


def test_platform_names(spark):
    assert platform_key("") == "jira" and platform_key("slack_scan") == "slack" and platform_key("x") is None
    own = lambda df: df.select(F.lit("Mine").alias("platform"), F.col("k").alias("issue_id"))
    df = spark.createDataFrame([("1",)], "k string")
    got = union_sources(spark, {"mine": df, "unknown": df}, extra={"mine": own}).collect()
    assert [(r.platform, r.issue_id) for r in got] == [("Mine", "1")]


def test_scope_queries():
    assert sc.scope_query("JQL : a = 1") == ("jql", "a = 1")
    assert sc.scope_query("query:x") == ("query", "x")
    assert sc.scope_query("a query: x") is None and sc.scope_query(None) is None


def test_scope_filter_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sc.scope_filter(docs, "search: lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = sc.time_window_filter(events, "2024-01-02", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in plan and "LessThan(ts,2024-01-05T00:00)" in plan


def test_branches(spark):
    df = spark.createDataFrame([("main", "main"), ("dev", "main"), (" x", "main")], "branch string, default_branch string")
    names = lambda spec: [r.branch for r in sc.branch_filter(df, spec).collect()]
    assert names("DEFAULT") == ["main"] and names("main,dev") == ["main", "dev"]
    assert names("main, x") == ["main", " x"] and names("") == ["main", "dev", " x"]
    assert names("default,dev") == ["dev"]


def test_map_container_without_children_means_all(spark):
    content = spark.createDataFrame([(c, i) for c in "abc" for i in "123"], "container string, item string")
    scope = spark.createDataFrame([("a", None), ("b", "2"), ("b", None)], "container string, item string")
    got = sorted(tuple(r) for r in sc.scope_semi_join(content, scope, ["container", "item"]).collect())
    assert got == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "2")]


def test_a_small_map_leaves_the_content_in_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "lang", "text")
    scope = docs.where("lang = 'en'").groupBy("source").agg(F.max("lang").alias("lang"))
    plan = sc.scope_semi_join(docs, scope, ["source", "lang"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_a_hot_key_reduces_before_the_shuffle(spark):
    """Most rows share one id: tasks hand over one row each, not the copies."""
    rows = spark.range(0, 20_000, 1, 4).selectExpr(
        "'Jira' as platform",
        "if(id % 3 = 0, cast(id as string), 'hot') as issue_id",
        "if(id % 3 = 0, concat('u', id), 'hot') as url",
        "'title' as field",
        "0 as field_ord",
        "id as item_ord",
        "concat('a AB', lpad(id % 10000, 4, '0')) as text",
    )
    found = fi.dedup_findings(fi.build_findings(mt.scan_texts(rows, RULES)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")
    assert found.count() == 6_667 + 1
    assert found.where("url = 'hot'").first().mocked_secret == "a AB0000"


def test_chunks_are_disjoint_and_complete(spark):
    m = spark.range(500).selectExpr("concat('p', id % 37) as l1", "cast(id as string) as l2")
    whole = sorted(tuple(r) for r in m.collect())
    for cut in (sc.scope_chunk, sc.scope_chunk_balanced):
        parts = [tuple(r) for i in (1, 2, 3, 4) for r in cut(m, i, 4).collect()]
        assert sorted(parts) == whole
    sizes = [sc.scope_chunk_balanced(m, i, 4).count() for i in (1, 2, 3, 4)]
    assert min(sizes) > 60


def test_file_tree_levels(spark):
    df = spark.createDataFrame([("r/a/x",), ("r/a/y",), ("r/b/c/z",), ("r/q",)], "path string")
    tree = lambda n: sorted(tuple(r) for r in sc.file_tree_map(df, n).collect())
    assert tree(-1) == [("r", 0, 1), ("r/a", 1, 2), ("r/b", 1, 0), ("r/b/c", 2, 1)]
    assert tree(0) == [("r", 0, 0)]
    assert tree(1) == [("r", 0, 1), ("r/a", 1, 0), ("r/b", 1, 0)]


def test_levels_zero_differs_per_platform(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, i string")
    assert sc.scope_map(df, "Jira", ["p", "i"], 0).count() == 1
    assert sc.scope_map(df, "GitHub", ["p", "i"], 0).count() == 2


def test_windows_double_while_empty(spark):
    df = spark.createDataFrame([("2024-01-10 05:00:00",), ("2024-01-07 05:00:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(str(r.start_day), str(r.end_day), r.n) for r in sc.day_windows(df, "2024-01-10").orderBy("window_id").limit(4).collect()]
    assert got == [
        ("2024-01-09", "2024-01-11", 1),
        ("2024-01-08", "2024-01-10", 0),
        ("2024-01-06", "2024-01-09", 1),
        ("2024-01-05", "2024-01-07", 0),
    ]
