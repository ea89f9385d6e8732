"""File trees: their nodes, and scopes that list files and directories at any depth.

A directory's files and those below it are neighbours in the order of paths: all of them lie between ``directory/`` and
``directory0``, as ``0`` follows ``/``. A listed directory is that interval, a listed file the interval of its own path, and a
path is in scope if the largest end of all intervals that begin at or before it lies behind it. So one pass in
path order decides, whatever the depth, and no path is taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.ordered import laid_out, running

FILE, DIRECTORY = "file", "directory"
_LAST = "\U0010ffff"  # behind any path


def _without_slash(path: Column) -> Column:
    return F.regexp_replace(path, "(?<=.)/+$", "")


def tree_entries(files: DataFrame, levels: int = -1, path: str = "path") -> DataFrame:
    """``dirs, name``: the directories on the way to each file, from the top, and its name.

    With ``levels`` the walk stops: a directory at that depth, the top being 0, is an entry of its own, with a null name,
    in place of what is below it.
    """
    parts = F.split(F.col(path), "/")
    rows = files.select(parts.alias("_parts")).where(F.col("_parts").isNotNull())
    rows = rows.select(F.slice("_parts", F.lit(1), F.size("_parts") - 1).alias("dirs"), F.element_at("_parts", -1).alias("name"))
    if levels >= 0:
        cut = F.size("dirs") > levels
        rows = rows.select(
            F.when(cut, F.slice("dirs", 1, levels + 1)).otherwise(F.col("dirs")).alias("dirs"), F.when(~cut, F.col("name")).alias("name")
        )
    return rows.distinct()


def whole_directories(nodes: DataFrame) -> DataFrame:
    """Listed directories of which nothing is listed: they stand for all that is below them."""
    empty = nodes.where(F.col("kind") == DIRECTORY).groupBy("path").agg(F.bool_and(F.coalesce("empty", F.lit(False))).alias("_empty"))
    return empty.where("_empty").select("path")


def scope_intervals(nodes: DataFrame, empty_means_all: bool = True) -> DataFrame:
    """``start, stop`` of what a map lists, ``stop`` not included."""
    files = nodes.where(F.col("kind") == FILE).select(F.col("path").alias("start"), F.concat("path", F.lit("\x00")).alias("stop"))
    if not empty_means_all:
        return files
    top = _without_slash(F.col("path"))
    below = whole_directories(nodes).select(
        F.when(top == "", "").when(top == "/", "/").otherwise(F.concat(top, F.lit("/"))).alias("start"),
        F.when(top == "", _LAST).when(top == "/", "0").otherwise(F.concat(top, F.lit("0"))).alias("stop"),
    )
    return files.unionByName(below)


def tree_scope_join(content: DataFrame, nodes: DataFrame, path: str = "path", empty_means_all: bool = True) -> DataFrame:
    """Content that a map of a file tree lists; a directory listed without children stands for all below it.

    ``nodes`` have ``path, kind, empty`` as ``read_tree_map`` gives them. Only distinct paths and intervals are put in order, by
    ranges of paths: a directory with most of the content is spread over as many tasks as it fills. The content then
    meets its own paths once. With ``empty_means_all=False`` only listed files count.
    """
    intervals = scope_intervals(nodes, empty_means_all).groupBy("start").agg(F.max("stop").alias("stop"))
    starts = intervals.select(F.col("start").alias("key"), F.lit(0).alias("_kind"), "stop")
    paths = content.where(F.col(path).isNotNull()).select(F.col(path).alias("key")).distinct()
    paths = paths.select("key", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("stop"))
    laid = laid_out(starts.unionByName(paths), ["key", "_kind"], "tree-scope")
    kept = running(laid, "stop", "_reach").where("_kind = 1 AND _reach > key").select(F.col("key").alias("_key"))
    return content.join(kept, F.col(path) == F.col("_key"), "left_semi")
