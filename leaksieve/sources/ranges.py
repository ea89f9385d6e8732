"""Files of a folder, listed and read by many tasks: whole, or in pieces if they are large.

A piece is a range of bytes with some characters of its neighbours on both sides. Tasks list the folders, so that no process
holds a row for each file. Files are cut by arithmetic; every task opens the file itself and reads its own range, wherever
``pyarrow`` can open it (local and shared folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import codecs
import errno
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, islice
from stat import S_ISDIR
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.session import scratch_path

PIECE = 8 << 20
BATCH = 4 << 20  # bytes of whole files that go to Spark together, unless a single one is larger
TASK_FILES = 4096  # whole files that one task reads, however small
TASK_FOLDERS = 256  # folders that one task lists
LISTED = 10_000  # files and folders that a task lists below a folder, before other tasks take the folders that are left
TASK = 32 << 20  # bytes of small pieces that one task reads: a task takes far longer to begin than such a piece to search
MOST_TASKS = 20_000
_FIELDS = "path string, piece bigint, last boolean, valid boolean, before int, chars bigint, lines bigint, text string"
_FORM = pa.schema(
    [
        ("path", pa.string()), ("piece", pa.int64()), ("last", pa.bool_()), ("valid", pa.bool_()), ("before", pa.int32()),
        ("chars", pa.int64()), ("lines", pa.int64()), ("text", pa.string()),
    ]
)


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files below a path by Spark's own reader, which lists them on the driver."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def task_folder(spark: SparkSession, path: str) -> str | None:
    """The full name of a folder that tasks can list.

    None for what only Spark can: single files, paths with wildcards, stores that ``pyarrow`` cannot open, and sessions that have
    no shared scratch space.
    """
    from pyarrow import fs

    if set("{}[]*?\\") & set(path):
        return None
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(name).toString()
    try:
        scratch_path(spark, "files")
        system, top = place_of(full)
        listable = full.endswith(top) and system.get_file_info(top).type == fs.FileType.Directory
    except (OSError, RuntimeError, ValueError):
        return None
    return full if listable else None


def _skipped(name: str, folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder for its name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(system, folder: str) -> Iterator[tuple[str, bool, int]]:
    """What lies in a folder: names, whether they are folders, sizes."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type != fs.FileType.NotFound:
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(folder) as found:  # one after another: there may be millions
        for entry in found:
            try:
                entry.name.encode()
                info = entry.stat()
            except UnicodeEncodeError:  # Spark has no path for such a name
                continue
            except OSError as e:
                if e.errno not in (errno.ENOENT, errno.ELOOP):  # a link that leads nowhere
                    raise
                continue
            yield entry.name, S_ISDIR(info.st_mode), info.st_size


def _list_folders(spark: SparkSession, top: str, pattern: str | None) -> DataFrame:
    """``path, length`` of all files below a folder, as its tasks have stored them.

    A task that has listed enough leaves the folders below to the next round, where others share them.
    """
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern() if pattern else ".*", re.DOTALL)
    form = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def below(folder: str) -> Iterator[tuple[str, int | None]]:
        """Files with their sizes, and folders that are left with none."""
        system, name = place_of(folder)
        start, left, seen = folder[: len(folder) - len(name)], [name.rstrip("/")], 0
        while left and seen < LISTED:
            at = left.pop()
            for entry, inner, size in entries(system, at or "/"):
                seen += 1
                if _skipped(entry, inner):
                    continue
                if inner and seen < LISTED:
                    left.append(f"{at}/{entry}")
                elif inner:
                    yield f"{start}{at}/{entry}", None
                elif size > 0 and wanted.fullmatch(entry):
                    yield f"{start}{at}/{entry}", size
        for at in left:
            yield f"{start}{at}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for folder in batch.column(0).to_pylist() for row in below(folder))
        while some := list(islice(rows, LISTED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some), form)], schema=form)

    fields, folders, rounds = "path string, length bigint", spark.createDataFrame([(top,)], "path string"), []
    store = scratch_path(spark, "_files")  # not listed itself, should it lie below the folder
    while True:
        at = f"{store}/{len(rounds)}"
        folders.mapInArrow(run, fields).write.parquet(at)
        rounds.append(spark.read.schema(fields).parquet(at))
        folders = rounds[-1].where("length IS NULL").select("path")
        if not (left := folders.count()):
            return reduce(DataFrame.unionAll, rounds).where("length IS NOT NULL")
        cores = spark.sparkContext.defaultParallelism
        folders = folders.repartition(min(left, max(4 * cores, left // TASK_FOLDERS), MOST_TASKS))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, length`` of all files below a path that are not empty; none is opened."""
    top = task_folder(spark, path)
    if top is None:
        return binary_files(spark, path, pattern).select("path", "length")
    return _list_folders(spark, top, pattern)


def read_files(files: DataFrame) -> DataFrame:
    """``path, content`` of files ``path, length`` of one file system, a file in a row."""
    spark = files.sparkSession
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    total = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    tasks = task_count(total.files, total.bytes or 0, spark.sparkContext.defaultParallelism)
    tasks = min(max(tasks, -(-total.files // TASK_FILES)), MOST_TASKS)
    form = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def batch_of(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        ends = pa.array(accumulate(map(len, contents), initial=0), pa.int32()).buffers()[1]
        # of a single content this makes no copy
        content = pa.Array.from_buffers(pa.binary(), len(contents), [None, ends, pa.py_buffer(b"".join(contents))])
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), content], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, start, size = None, 0, 0
        paths: list[str] = []
        contents: list[bytes] = []
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                if length > most:
                    raise ValueError(f"{path} has {length} bytes, a row holds {most} at most")
                if paths and size + length > BATCH:
                    yield batch_of(paths, contents)
                    paths, contents, size = [], [], 0
                if system is None:
                    system, name = place_of(path)
                    start = len(path) - len(name)
                with system.open_input_file(path[start:]) as file:
                    contents.append(file.read())
                paths.append(path)
                size += len(contents[-1])
        if paths:
            yield batch_of(paths, contents)

    return files.repartition(tasks).mapInArrow(run, "path string, content binary")


def place_of(path: str) -> tuple:
    """The file system that a path lies in, and its name there."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def open_file(path: str):
    """A file that can be read from any place, and its size."""
    system, name = place_of(path)
    file = system.open_input_file(name)
    return file, file.size()


def _aligned(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _lines(text: str, after_return: bool) -> str:
    """Unix line ends; a line feed that belongs to a carriage return before the text is left out."""
    if after_return and text.startswith("\n"):
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n")


def read_range(path: str, begin: int, end: int, left: int, right: int) -> dict:
    """The text of a range of bytes, with up to ``left`` and ``right`` characters around it.

    A range begins and ends with the first character from its borders on, so that ranges side by side share no character
    and leave none out. A range that is no UTF-8 is not ``valid`` and has no text.
    """
    file, size = open_file(path)
    with file:
        low, high = max(0, begin - 4 * left - 8), min(size, end + 4 * right + 8)
        file.seek(low)
        raw = file.read(high - low)
    first = 0 if low == 0 else _aligned(raw, 4)
    a, b = _aligned(raw, begin - low), _aligned(raw, min(end, size) - low)
    try:
        core = raw[a:b].decode("utf-8")
        # what is cut at the outer borders belongs to other ranges
        head = raw[first:a].decode("utf-8") if a >= first else ""
        tail = codecs.getincrementaldecoder("utf-8")("ignore").decode(raw[b:])
    except UnicodeDecodeError:
        return {"valid": False, "before": 0, "chars": 0, "lines": 0, "text": None}
    ahead = _lines(head, False)
    own = _lines(core, head.endswith("\r"))
    rest = _lines(tail, (core or head).endswith("\r"))
    ahead, rest = ahead[len(ahead) - min(left, len(ahead)) :], rest[:right]
    return {"valid": True, "before": len(ahead), "chars": len(own), "lines": own.count("\n"), "text": ahead + own + rest}


def task_count(pieces: int, size: int, cores: int) -> int:
    """How many tasks read so many pieces, of ``size`` bytes in all."""
    return max(1, min(pieces, max(4 * cores, -(-size // TASK)), MOST_TASKS))


def read_pieces(files: DataFrame, left: int, right: int, size: int = PIECE) -> DataFrame:
    """``path, piece, last, valid, before, chars, lines, text`` of files ``path, length``.

    The piece itself are ``chars`` characters of ``text`` behind the first ``before``, with ``lines`` line ends.
    """
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size)))
    files = files.where("length > 0")
    pieces = files.select("path", "length", number.alias("piece"))
    # rows are small but their work is not: tasks by the bytes that they read, enough for all cores, and not fewer by the rows' size
    total = files.agg(F.sum(F.ceil(F.col("length") / size)).alias("pieces"), F.sum("length").alias("bytes")).first()
    tasks = task_count(int(total.pieces or 0), int(total.bytes or 0), files.sparkSession.sparkContext.defaultParallelism)
    pieces = pieces.repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end = row["piece"] * size, min(row["length"], (row["piece"] + 1) * size)
                made = {"path": row["path"], "piece": row["piece"], "last": end == row["length"]}
                made |= read_range(row["path"], begin, end, left, right)
                yield pa.RecordBatch.from_pylist([made], schema=_FORM)

    return pieces.mapInArrow(run, _FIELDS)
