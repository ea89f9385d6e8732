"""Files read in pieces: the same findings as if each were one row."""

import random
import re

import pytest

from leaksieve.functions.reach import Reach, pattern_reach
from leaksieve.operators.flatten import flatten_fields
from leaksieve.operators.matching import scan_texts
from leaksieve.operators.rules import RuleSet
from leaksieve.options import MatchOptions
from leaksieve.plans.files import scan_files, scan_pieces, unbounded_rules
from leaksieve.sources.files import read_text_files
from leaksieve.sources.ranges import list_files, read_pieces, read_range, task_count

RULES = RuleSet.from_dict(
    {
        "rules": [
            {"id": "line-start", "regex": r"(?m)^TOP[0-9]{2}$", "example": "TOP11"},
            {"id": "behind", "regex": r"(?<!no)key-[a-f0-9]{4,8}\b", "example": "key-ffff", "allowlists": [{"regexes": ["ALLOW[0-9]"]}]},
            {"id": "file-start", "regex": r"\Astart", "example": "x"},
            {"id": "wide", "regex": r"é{2}\s{1,3}z(?=!)", "example": ""},
            {"id": "nests", "regex": r"(?:ab?){2,5}c", "example": "abac"},
            {"id": "open", "regex": r"open[a-z]+", "example": "openx"},
            {"id": "last", "regex": r"end\Z", "example": "END"},
        ]
    }
)
BITS = ["TOP12", "key-abcd", "nokey-abcd", "key-0123456789", "ALLOW1", "start", "éé  z!", "éé\r\nz!", "ababac", "opening", "end", "\r\n", "\r", "\n", " ", "x", "漢字🙂"]
OPTIONS = MatchOptions(mock_limit=-1)  # mocked texts are windows, as for large files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(6)
    base = tmp_path_factory.mktemp("files")
    for k in range(30):
        weights = [rng.random() ** 3 for _ in BITS]
        text = "".join(rng.choices(BITS, weights, k=rng.randint(1, 150)))
        (base / f"d{k % 3}").mkdir(exist_ok=True)
        (base / f"d{k % 3}" / f"f {k}.txt").write_bytes(text.encode())
    (base / "bad.txt").write_bytes("key-abcd ".encode() * 30 + b"\xff" + b" x" * 300)
    (base / "empty.txt").write_bytes(b"")
    return str(base)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_ranges_cover_a_file(tmp_path, size):
    rng = random.Random(size)
    raw = "".join(rng.choices(["a", "é", "漢", "🙂", "\r\n", "\r", "\n"], k=200)).encode()
    path = tmp_path / "f"
    path.write_bytes(raw)
    whole = raw.decode().replace("\r\n", "\n").replace("\r", "\n")
    parts = [read_range(f"file:{path}", a, min(a + size, len(raw)), 5, 9) for a in range(0, len(raw), size)]
    at = 0
    for part in parts:
        own = part["text"][part["before"] : part["before"] + part["chars"]]
        assert whole[at : at + part["chars"]] == own and own.count("\n") == part["lines"]
        assert part["text"][: part["before"]] == whole[max(0, at - 5) : at]
        behind = part["text"][part["before"] + part["chars"] :]
        assert behind == whole[at + part["chars"] : at + part["chars"] + 9]
        at += part["chars"]
    assert at == len(whole)


def rows(frame):
    columns = ["url", "rule_id", "rule_ord", "begin", "end", "secret", "line_number", "sanitized_secret", "snippet_text", "mocked_secret", "field", "platform"]
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("size", [64, 257])
def test_pieces_find_what_whole_files_do(spark, folder, size):
    """All bounded rules, at every place of a border."""
    bounded = RuleSet(tuple(r for r in RULES.rules if r.id != "open"))
    want = rows(scan_texts(flatten_fields(read_text_files(spark, folder)), bounded, OPTIONS))
    got = rows(scan_pieces(list_files(spark, folder), bounded, OPTIONS, size))
    assert len({r[1] for r in want}) >= 5 and got == want


def test_unbounded_rules_are_told(spark, folder):
    assert [tuple(r) for r in unbounded_rules(spark, RULES).collect()] == [(5, "open")]
    assert "open" not in {r[1] for r in rows(scan_pieces(list_files(spark, folder), RULES, OPTIONS, 64))}
    assert unbounded_rules(spark, RULES, longest_run=20).count() == 0
    want = rows(scan_texts(flatten_fields(read_text_files(spark, folder)), RULES, OPTIONS))
    assert rows(scan_pieces(list_files(spark, folder), RULES, OPTIONS, 64, longest_run=40)) == want


def test_folder_of_all_sizes(spark, folder):
    bounded = RuleSet(tuple(r for r in RULES.rules if r.id != "open"))
    want = rows(scan_texts(flatten_fields(read_text_files(spark, folder)), bounded, OPTIONS))
    got = scan_files(spark, folder, bounded, OPTIONS, whole=400, size=100)
    assert rows(got) == want


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "big.txt"
    with open(path, "wb") as file:
        file.truncate(3 << 20)
        file.seek((1 << 20) - 4)
        file.write(b" key-abcd\n")
    pieces = read_pieces(list_files(spark, str(path)), 10, 10, 1 << 18)
    assert pieces.rdd.getNumPartitions() > 1 and pieces.count() == 12
    [found] = scan_pieces(list_files(spark, str(path)), RULES, OPTIONS, 1 << 18).collect()
    assert (found.secret, found.begin, found.line_number) == ("key-abcd", (1 << 20) - 3, 1)


def test_many_small_pieces_share_tasks(spark, tmp_path):
    path = tmp_path / "small.txt"
    path.write_bytes(b"x" * (1 << 16) + b" key-abcd\n")
    files = list_files(spark, str(path))
    pieces = read_pieces(files, 10, 10, 1 << 8)
    assert 1 < pieces.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and pieces.count() == 257
    [found] = scan_pieces(files, RULES, OPTIONS, 1 << 8).collect()
    assert (found.secret, found.begin) == ("key-abcd", (1 << 16) + 1)
    # large inputs: by their bytes, up to a bound
    assert task_count(5_000_000, 160 << 30, 12) == 5120 and task_count(1 << 40, 1 << 60, 12) == 20_000 and task_count(0, 0, 12) == 1


def test_options(spark, folder):
    with pytest.raises(ValueError):
        scan_pieces(list_files(spark, folder), RULES, MatchOptions(entropy_filter=True))


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("abc", (0, 3)), ("a{2,5}", (0, 5)), ("a+", None), ("(?<=xyz)a", (3, 1)), ("a(?=bcd)", (0, 4)), ("(ab|c){3}", (0, 6)),
        (r"(ab)\1", (0, 4)), (r"\bx$", (0, 1)), ("(?:a*)b", None), ("[^x]", (0, 1)), ("(?i)a.?", (0, 2)), ("(?:){5,}x", (0, 1)), ("x(?!a+)", None),
    ],
)
def test_reach(pattern, want):
    assert re.compile(pattern)
    assert pattern_reach(pattern) == (None if want is None else Reach(want[0] + 1, want[1] + 1))


def test_reach_with_runs():
    assert pattern_reach("a+b{3,}", 50) == Reach(1, 101) and pattern_reach("(ab)+", 50) is None
