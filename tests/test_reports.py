import json

import pytest
from documents import read_document

from leaksieve import ScanOptions, default_rules, load_rules, save_report, scan, validate_rules
from leaksieve.operators.rules import RuleSet
from leaksieve.sinks import reports as rp

RULES = RuleSet.from_dict(
    {"rules": [{"id": "First", "description": "one", "regex": "zz"}, {"id": "r", "description": "d", "regex": "AB[0-9]{4}"}]}
)


@pytest.fixture(scope="module")
def found(spark):
    rows = [("LocalFilesystem", f"f{i}", f"f{i}", f'say "x"\n AB{i:04d} end') for i in range(40)]
    tickets = spark.createDataFrame(rows, "platform string, issue_id string, url string, file string")
    return scan(tickets, None, RULES).findings.cache()


def test_native_report_is_one_document(spark, found, tmp_path):
    path = save_report(found, RULES.to_df(spark), f"{tmp_path}/native")
    doc = json.loads(read_document(spark, path).first().document)
    assert len(doc["findings"]) == 40 and [r["id"] for r in doc["regex_config"]["rules"]] == ["First", "r"]
    key, one = next(iter(doc["findings"].items()))
    assert one["id"] == key and one["details"]["matched_regex_config"]["regex"] == "AB[0-9]{4}"
    assert one["details"]["platform"] == "LocalFilesystem" and one["url"].endswith("#L2")
    assert doc["tool"]["scan_arguments"]["scan_comment"] is True


def test_native_report_reads_back_and_converts(spark, found, tmp_path):
    path = save_report(found, RULES.to_df(spark), f"{tmp_path}/n")
    single = tmp_path / "report.json"
    single.write_text(read_document(spark, path).first().document)
    want = sorted(map(tuple, found.select("id", "url", "secret", "mocked_secret", "rule_id", "ticket_field").collect()))
    for source in (path, str(single)):
        findings, rules = rp.read_report(spark, source)
        got = findings.select("id", "url", "secret", "mocked_secret", "rule_id", "ticket_field")
        assert sorted(map(tuple, got.collect())) == want
        assert [(r.rule_ord, r.id, r.regex) for r in rules.orderBy("rule_ord").collect()] == [
            (0, "First", "zz"), (1, "r", "AB[0-9]{4}"),
        ]
    options = ScanOptions(report_format="sarif")
    rp.convert_report(spark, path, f"{tmp_path}/converted", options)
    doc = json.loads(read_document(spark, f"{tmp_path}/converted/document").first().document)
    assert len(doc["runs"][0]["results"]) == 40 and {r["ruleIndex"] for r in doc["runs"][0]["results"]} == {2}


def test_gitlab_report(spark, found, tmp_path):
    path = save_report(found, RULES.to_df(spark), f"{tmp_path}/gl", ScanOptions(report_format="My-GitLab"))
    doc = json.loads(read_document(spark, path).first().document)
    assert doc["version"] == "15.0.6" and len(doc["vulnerabilities"]) == 40
    v = doc["vulnerabilities"][0]
    assert v["severity"] == "Info" and "xxxxxxxxxxxx" in v["evidence"]["summary"]
    assert [o["name"] for o in doc["scan"]["options"]] == ["scan_target", "label", "contact_help", "report_format"]


def test_sarif_runs_append(spark, found, tmp_path):
    rules = RULES.to_df(spark)
    rp.sarif_append_runs(found, rules, f"{tmp_path}/s1")
    # the second scan knows only the first rule, so the other is added once per finding
    rp.sarif_append_runs(found, rules.where("rule_ord = 0"), f"{tmp_path}/s2", old_path=f"{tmp_path}/s1")
    doc = json.loads(read_document(spark, f"{tmp_path}/s2/document").first().document)
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 2
    first, second = doc["runs"]
    assert [r["id"] for r in first["tool"]["driver"]["rules"]] == ["First", "r"]
    assert {r["ruleIndex"] for r in first["results"]} == {2} and len(first["results"]) == 40
    assert len(second["tool"]["driver"]["rules"]) == 41 and {r["ruleIndex"] for r in second["results"]} == {-1}
    assert "Potential Secret Leak on [LocalFilesystem](" in first["results"][0]["message"]["text"]


def test_format_names():
    assert rp.report_kind("GITHUB-SARIF") == "sarif" and rp.report_kind("GitLab") == "gitlab" and rp.report_kind("x") == "native"


def test_empty_report(spark, found, tmp_path):
    path = rp.gitlab_report(found.limit(0), f"{tmp_path}/none")
    assert json.loads(read_document(spark, path).first().document)["vulnerabilities"] == []


def test_builtin_rules_match_their_examples(spark):
    got = validate_rules(default_rules().to_df(spark)).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in got] == [("ok", len(default_rules()))]


RULE_FILE = """
rules:
  - id: one
    regex: 'ab(?i)c'
    example: abc
    entropy: 2
    secretGroup: 1
    allowlists: [{regexes: [x], regexTarget: match}]
  - id: dead
    regex: '(('
"""


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(RULE_FILE)
    (tmp_path / "r.toml").write_text(
        "[[rules]]\nid='one'\nregex='ab(?i)c'\nexample='abc'\nentropy=2\nsecretGroup=1\n"
        "[[rules.allowlists]]\nregexes=['x']\nregexTarget='match'\n[[rules]]\nid='dead'\nregex='(('\n"
    )
    a, b = load_rules(spark, str(tmp_path / "r.yaml")), load_rules(spark, str(tmp_path / "r.toml"))
    assert a == b
    a.to_df(spark).write.parquet(str(tmp_path / "r.parquet"))
    assert load_rules(spark, str(tmp_path / "r.parquet")) == a
    table = {r.id: (r.live, r.reason) for r in a.to_df(spark).collect()}
    assert table["one"] == (True, "") and not table["dead"][0] and "invalid" in table["dead"][1]
    (tmp_path / "bad.json").write_text('{"patterns": []}')
    with pytest.raises(ValueError):
        load_rules(spark, str(tmp_path / "bad.json"))


def test_validation_statuses(spark):
    rules = spark.createDataFrame(
        [("a", "x+", "xx"), ("b", "x+", "y"), ("c", "(", "y"), ("d", "", "y"), ("e", "x", None)],
        "id string, regex string, example string",
    )
    got = {r.rule_id: r.status for r in validate_rules(rules).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "invalid", "d": "missing", "e": "missing"}


def test_stacked_findings_are_valid_json(spark, found, tmp_path):
    twice = found.unionByName(found)
    path = save_report(twice, RULES.to_df(spark), f"{tmp_path}/stacked", ScanOptions(report_format="gitlab"))
    assert len(json.loads(read_document(spark, path).first().document)["vulnerabilities"]) == 80
    path = save_report(twice, RULES.to_df(spark), f"{tmp_path}/stacked-native")
    assert len(json.loads(read_document(spark, path).first().document)["findings"]) == 40


def test_runs_of_another_tool_stay(spark, found, tmp_path):
    other = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "other"}}, "results": []}, {"tool": {"driver": {"name": "é"}}}]}
    file = tmp_path / "old.sarif"
    file.write_text(json.dumps(other, indent=1))
    rp.sarif_append_runs(found, RULES.to_df(spark), f"{tmp_path}/more", old_path=str(file))
    doc = json.loads(read_document(spark, f"{tmp_path}/more/document").first().document)
    assert doc["runs"][:2] == other["runs"] and len(doc["runs"][2]["results"]) == 40
    assert "informationUri" not in doc["runs"][2]["tool"]["driver"] and "helpUri" not in doc["runs"][2]["tool"]["driver"]["rules"][0]
    empty = tmp_path / "none.json"
    empty.write_text('{"runs": []}')
    rp.sarif_append_runs(found, RULES.to_df(spark), f"{tmp_path}/first", old_path=str(empty))
    assert len(json.loads(read_document(spark, f"{tmp_path}/first/document").first().document)["runs"]) == 1


def test_scan_date_reaches_gitlab(spark, found, tmp_path):
    path = save_report(found, RULES.to_df(spark), f"{tmp_path}/dated")
    date = json.loads(read_document(spark, path).first().document)["scan_date"]["date_utc"]
    single = tmp_path / "dated.json"
    single.write_text(read_document(spark, path).first().document)
    for i, source in enumerate((path, str(single))):
        target = rp.convert_report(spark, source, f"{tmp_path}/dated-gitlab{i}", ScanOptions(report_format="gitlab"))
        doc = json.loads(read_document(spark, target).first().document)
        assert doc["scan"]["start_time"] == date and doc["scan"]["end_time"] >= date
        assert [x["name"] for x in doc["vulnerabilities"][0]["links"]] == ["LocalFilesystem file"]
