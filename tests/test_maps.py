import json

import pytest
from documents import read_document

from leaksieve.options import ScanOptions
from leaksieve.sources.maps import read_map, write_map

ASANA = {"workspaces": {"w1": {"gid": "w1", "name": "x", "projects": {"p1": {"tasks": {"t": {"stories": {"s": {}, "é\"": {}}}}}, "p2": {"tasks": {}}}}, "w": {"projects": {}}}}
GITHUB = {"owner": "o", "repos": {"git://a": {"gid": "git://a", "branches": {"main": {"files": ["a/b.txt", "c"]}, "dev": {"files": {}}}}, "git://ab": {"branches": {}}}}
JIRA = {"projects": {"P": {"P-1": {}, "P-2": {}}, "PX": {}}}


def flat(table):
    return sorted((tuple(r)[1:] for r in table.collect()), key=repr)


@pytest.mark.parametrize(
    "platform,nested,want",
    [
        ("asana", ASANA, [("w", None, None, None), ("w1", "p1", "t", "s"), ("w1", "p1", "t", 'é"'), ("w1", "p2", None, None)]),
        ("github_scan", GITHUB, [("git://a", "main", "a/b.txt", None), ("git://a", "main", "c", None), ("git://a", "dev", None, None), ("git://ab", None, None, None)]),
        ("jira", JIRA, [("P", "P-1", None, None), ("P", "P-2", None, None), ("PX", None, None, None)]),
    ],
)
def test_maps_go_both_ways(spark, tmp_path, platform, nested, want):
    file = tmp_path / "map.json"
    file.write_text(json.dumps(nested, indent=2))
    table = read_map(spark, str(file), platform)
    assert flat(table) == sorted(want, key=repr)
    path = write_map(table, f"{tmp_path}/written", platform)
    again = tmp_path / "again.json"
    again.write_text(read_document(spark, path).first().document)
    json.loads(again.read_text())
    assert flat(read_map(spark, str(again), platform)) == sorted(want, key=repr)


def test_unknown_platform(spark, tmp_path):
    with pytest.raises(ValueError):
        read_map(spark, str(tmp_path), "slack")


def test_config_files(tmp_path):
    config = {"general_params": {"report_format": "sarif", "post_comment": True, "timeout": None}, "comment_params": {"label": "L", "bot_name": "b"}}
    file = tmp_path / "c.json"
    file.write_text(json.dumps(config))
    options = ScanOptions.load(str(file))
    assert (options.report_format, options.post_comment, options.label, options.config_label, options.bot_name) == ("sarif", True, "L", "L", "b")
    toml = tmp_path / "c.toml"
    toml.write_text('[general_params]\nskip_comment = true\n')
    assert ScanOptions.load(str(toml)).skip_comment
