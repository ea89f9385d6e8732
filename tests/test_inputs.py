"""Queries whose tables are folders, and files written one for each row."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leaksieve.sources import ranges
from leaksieve.sources.files import pack_texts, read_text_files, unpack_text, write_text_files

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    rows = [(k, f"call (555) 555-{k:04d}", "en", "src1", 19) for k in range(6)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["scan_stream"](spark, str(tmp_path))
    assert sorted((r.url, r.secret) for r in found.collect()) == [(f"doc/{k}", f"(555) 555-{k:04d}") for k in range(6)]
    assert len(entry.queries()["stream_dedup"](spark, str(tmp_path)).collect()) == 1


@pytest.mark.parametrize("folder", [False, True])
def test_a_stream_of_a_file_or_a_folder(spark, tmp_path, folder):
    frame = spark.range(5).coalesce(1)
    if folder:
        frame.write.parquet(f"{tmp_path}/t.parquet")
    else:
        import pyarrow.parquet as pq

        pq.write_table(frame.toArrow(), f"{tmp_path}/t.parquet")
    frame.write.parquet(f"{tmp_path}/other.parquet")
    assert entry._run_stream(spark, entry._table_stream(spark, str(tmp_path), "t")).count() == 5


def test_a_file_for_each_document_in_few_folders(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k}\r\nend", "en", "src1", 1) for k in range(400)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    path = lambda _, name: made.append(f"{tmp_path}/{name}") or made[-1]
    monkeypatch.setattr(entry, "scratch_path", path)
    got = {r.doc_id: (r.digest, r.n_chars) for r in entry.queries()["read_text_files_each"](spark, str(tmp_path)).collect()}
    assert got == {k: (hashlib.sha256(t := f"text {k}\nend".encode()).hexdigest(), len(t)) for k in range(400)}
    folders = list(os.walk(made[0]))
    assert len(folders) <= 257 and sum(len([x for x in names if not x.endswith(".crc")]) for _, _, names in folders) == 400


def test_written_files_are_read_again(spark, tmp_path):
    rows = [("a/1.txt", "é\n"), ("a/b/2.txt", "x"), ("3 %.txt", "z\x00")]
    write_text_files(spark.createDataFrame(rows, "name string, text string"), f"file:{tmp_path}/out")
    got = {r.url.rpartition("/out/")[2]: r.file for r in read_text_files(spark, f"{tmp_path}/out").collect()}
    assert got == dict(rows) or {k.replace("%20", " ").replace("%25", "%"): v for k, v in got.items()} == dict(rows)


def test_the_driver_knows_no_file_of_a_folder(spark, tmp_path):
    rows = [(f"{k % 7}/{k}.txt", f"text {k}") for k in range(200)]
    write_text_files(spark.createDataFrame(rows, "name string, text string"), f"{tmp_path}/out")
    read = read_text_files(spark, f"{tmp_path}/out")
    assert {r.url.rpartition("/out/")[2]: r.file for r in read.collect()} == dict(rows)
    assert not [x for x in read.inputFiles() if "/out/" in x]  # what its plan is made of
    assert not [x for x in ranges.list_files(spark, f"{tmp_path}/out").inputFiles() if "/out/" in x]


@pytest.fixture
def odd_folder(tmp_path):
    top = tmp_path / "top 1%"
    names = ["a.txt", "b 1%.txt", "c+[1].txt", "_x.txt", "_x=1.txt", ".x.txt", "y._COPYING_", "_metadata", "empty.txt", "é.bin"]
    folders = ["", "s/", "s/t=1/", "_hid/", "_k=1/", ".hid/", "_metadata_d/", "s/_common_metadata/", "z._COPYING_/"]
    for k, folder in enumerate(folders):
        (top / folder).mkdir(parents=True)
        for name in names:
            (top / folder / name).write_text("" if name == "empty.txt" else f"{k} {name}")
    (top / "none").mkdir()
    (top / "link.txt").symlink_to(top / "a.txt")
    (top / "dangling.txt").symlink_to(top / "missing.txt")
    (top / "linked").symlink_to(top / "s" / "t=1")
    return top


@pytest.mark.parametrize("pattern", [None, "*.txt", "{a,b}*", "[!a]?*.txt", "[a-c]*.t?t", "c\\+\\[1\\].txt", "nothing"])
def test_tasks_list_what_sparks_reader_lists(spark, odd_folder, pattern, monkeypatch):
    monkeypatch.setattr(ranges, "LISTED", 5)  # several rounds
    path = str(odd_folder)
    want = {(r.path, r.length): bytes(r.content) for r in ranges.binary_files(spark, path, pattern).collect() if r.path.isascii()}
    files = ranges.list_files(spark, path, pattern)
    got = [tuple(r) for r in files.collect() if r.path.isascii()]  # Java needs a locale for others
    assert sorted(got) == sorted(want) and bool(got) == (pattern != "nothing")
    assert {r.path: bytes(r.content) for r in ranges.read_files(files).collect() if r.path.isascii()} == {k: v for (k, _), v in want.items()}


def test_what_tasks_cannot_list_is_listed_by_spark(spark, odd_folder, tmp_path):
    path = str(odd_folder)
    assert ranges.task_folder(spark, path) == f"file:{path}"
    assert ranges.task_folder(spark, f"file://{path}/") == f"file:{path}"
    for other in (f"{path}/a.txt", f"{path}/s*", f"{path}/missing"):
        assert ranges.task_folder(spark, other) is None
    assert {r.file for r in read_text_files(spark, f"{path}/a.txt").collect()} == {"0 a.txt"}
    assert {r.file for r in read_text_files(spark, f"{path}/s*", "a.txt").collect()} == {"1 a.txt", "2 a.txt", "7 a.txt"}


def test_folders_of_other_stores(odd_folder):
    from pyarrow import fs

    local, top = fs.LocalFileSystem(), str(odd_folder)
    assert sorted(ranges.entries(fs.SubTreeFileSystem(top, local), "s")) == sorted(
        (name, folder, 0 if folder else size) for name, folder, size in ranges.entries(local, f"{top}/s")
    )


def test_whole_files_go_in_small_batches_and_many_tasks(spark, tmp_path, monkeypatch):
    sizes = [1, 50, 99, 1000, 3, 120] * 5
    for k, size in enumerate(sizes):
        (tmp_path / f"{k}.txt").write_bytes(bytes([65 + k % 26]) * size)
    monkeypatch.setattr(ranges, "BATCH", 100)
    monkeypatch.setattr(ranges, "TASK_FILES", 1)
    read = ranges.read_files(ranges.list_files(spark, str(tmp_path)))
    assert read.rdd.getNumPartitions() == len(sizes)
    monkeypatch.setattr(ranges, "TASK_FILES", 4096)
    read = ranges.read_files(ranges.list_files(spark, str(tmp_path)))
    assert read.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    got = {r.path.rpartition("/")[2]: bytes(r.content) for r in read.collect()}
    assert got == {f"{k}.txt": bytes([65 + k % 26]) * size for k, size in enumerate(sizes)}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "999")
    try:
        with pytest.raises(Exception, match="999 at most"):
            ranges.read_files(ranges.list_files(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_texts_that_are_packed_come_back(spark):
    texts = ["", "a", "é\x00\r\n漢字🙂", "many words " * 10_000, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    packed = {r.k: r.p for r in rows.select("k", pack_texts(F.col("text")).alias("p")).collect()}
    assert len(packed[3]) < 1000 and packed.pop(4) is None
    assert [unpack_text(bytes(packed[k])).decode() for k in range(4)] == texts[:4]


def test_documents_that_share_a_number_share_a_file(spark, tmp_path):
    rows = [(1, "one", "en", "s", 3), (1, "one", "en", "s", 3), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, "x\r\ny", "en", "s", 4)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_chars) for r in entry.queries()["read_text_files_each"](spark, str(tmp_path)).collect())
    assert got == [(1, 3), (2, 0), (3, 0), (4, 3)]
