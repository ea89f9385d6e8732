"""Files: local or shared folders, and files of code hosts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions import text as tx
from leaksieve.sources.ranges import binary_files, list_files, place_of, read_files, task_folder

REPLACEMENT = "\ufffd"
KEPT = "\ufdd0\ufdd1"  # noncharacters that stand for a genuine replacement character during the repair


def _file_tickets(rows: DataFrame, platform: str, url: Column, text: Column) -> DataFrame:
    return rows.select(
        F.lit(platform).alias("platform"), url.alias("issue_id"), url.alias("url"), text.alias("file")
    )


def read_text_files(spark: SparkSession, path: str, pattern: str | None = None, most: int | None = None) -> DataFrame:
    """All UTF-8 files below a path, one row per file.

    Other files are skipped before any decoding, empty ones too, and line ends become ``\\n``. The
    url is the file's path without the ``file:`` scheme. Files of more than ``most`` bytes are left out:
    ``plans.files.scan_files`` reads them in pieces. Folders are listed, and files opened, by tasks where these
    can; else Spark's reader does it, with all paths on the driver.
    """
    by_tasks = task_folder(spark, path) is not None
    files = list_files(spark, path, pattern) if by_tasks else binary_files(spark, path, pattern).where(F.col("length") > 0)
    if most is not None:
        files = files.where(F.col("length") <= most)
    files = read_files(files) if by_tasks else files.select("path", "content")
    texts = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    url = F.regexp_replace("path", "^file:(//)?", "")
    return _file_tickets(texts, "LocalFilesystem", url, tx.unix_newlines(F.decode("content", "UTF-8")))


def pack_texts(texts: Column) -> Column:
    """Texts compressed one by one, for exchanges of texts that files are made of; ``unpack_text`` has their bytes again."""

    def pack(text: str) -> bytes:
        raw = text.encode()
        return len(raw).to_bytes(8) + pa.compress(raw, "zstd", asbytes=True)  # the length is asked for again

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([pack(x.as_py()) if x.is_valid else None for x in texts], pa.binary())

    return packed(texts)


def unpack_text(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8]), "zstd", asbytes=True)


def write_text_files(rows: DataFrame, path: str, encode: Callable[[Any], bytes] = lambda text: (text or "").encode()) -> None:
    """Write ``name, text`` rows as files below a path, one each, whose names may hold folders.

    Tasks write the files themselves, wherever ``pyarrow`` can: for many small files Spark's writers take most of their time to
    make, permit and move each of them. A task that is repeated writes the same files again. Names must differ. Texts may be
    anything that ``encode`` makes a file's bytes of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place_of(path)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = f"{top}/{name}"
                system.create_dir(file.rpartition("/")[0], recursive=True)
                with system.open_output_stream(file, compression=None) as out:
                    out.write(encode(text.as_py()))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows.select("name", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def norm_github(files: DataFrame) -> DataFrame:
    """Files of branches; bytes that are not UTF-8 are dropped from the text, genuine U+FFFD stays."""
    url = F.concat("html_url", F.lit("/blob/"), "branch", F.lit("/"), "path")
    repaired = F.make_valid_utf8(F.replace(F.col("content").cast("string"), F.lit(REPLACEMENT), F.lit(KEPT)))
    text = F.replace(F.replace(repaired, F.lit(REPLACEMENT), F.lit("")), F.lit(KEPT), F.lit(REPLACEMENT))
    return _file_tickets(files, "GitHub", url, text)


def norm_gitlab(files: DataFrame) -> DataFrame:
    """Files of branches; bytes that are not UTF-8 become replacement characters."""
    url = F.concat("web_url", F.lit("/-/blob/"), "branch", F.lit("/"), "path")
    return _file_tickets(files, "GitLab", url, F.make_valid_utf8(F.col("content").cast("string")))
