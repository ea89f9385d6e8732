"""Map files: the containers of a platform as nested JSON, and as a flat table.

The flat table has a row for each innermost container, ``platform, l1, l2, l3, l4``; levels below the last
known one are null. It is what ``scope_semi_join`` and ``scope_chunk`` take.

Large maps are folders of documents, one a line, each a map of its own with a bounded part of the containers: read one
after another they list what the whole does. A file tree has directories of any depth; its flat table has a
row for each file and directory, ``path, name, kind, depth, empty``, which ``tree_scope_join`` takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.operators.ordered import PLACE, RANGE, laid_out
from leaksieve.operators.scope import LEVELS
from leaksieve.operators.tree import tree_entries
from leaksieve.session import materialise
from leaksieve.sources.union import PLATFORMS, platform_key

# Fixed values of the files: the field that holds each level, from the top. An empty name: the level lies
# directly in the one above. A name in brackets: a list of names instead of an object.
SHAPES = {
    "jira": ("projects", ""),
    "confluence": ("workspaces", ""),
    "asana": ("workspaces", "projects", "tasks", "stories"),
    "github": ("repos", "branches", "[files]"),
    "gitlab": ("projects", "branches", "[files]"),
}
_OBJECT = "map<string,string>"
DOCUMENT = 50_000  # most entries of one document
DEPTH = 1000  # deepest directory that a map is read to


def _shape(platform: str) -> tuple[str, tuple[str, ...]]:
    key = platform_key(platform)
    if key not in SHAPES:
        raise ValueError(f"maps of {platform!r} have no nested form")
    return key, SHAPES[key]


def read_map(spark: SparkSession, path: str, platform: str, lines: bool = False) -> DataFrame:
    """The flat table of map files: a document a file, or with ``lines`` a document a line."""
    key, shape = _shape(platform)
    rows = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("_v"))
    for level, name in zip(LEVELS, shape):
        field = name.strip("[]")
        inner = F.from_json("_v", _OBJECT)[field] if field else F.col("_v")
        done = [c for c in rows.columns if c != "_v"]
        if name.startswith("["):
            rows = rows.select(*done, F.explode_outer(F.from_json(inner, "array<string>")).alias(level), F.lit("").alias("_v"))
        else:
            rows = rows.select(*done, F.explode_outer(F.from_json(inner, _OBJECT)).alias(level, "_v"))
    missing = [F.lit(None).cast("string").alias(level) for level in LEVELS[len(shape) :]]
    found = rows.drop("_v").where("l1 is not null")
    return found.select(F.lit(PLATFORMS[key][0]).alias("platform"), *LEVELS[: len(shape)], *missing)


def write_map(scope: DataFrame, path: str, platform: str) -> str:
    """Write a flat table as a folder of text parts that, one after another, are the nested document.

    Every container is a line that opens and one that closes it; lines are sorted by all tasks, so a container
    with most of the map is never gathered.
    """
    _, shape = _shape(platform)
    spark = scope.sparkSession
    # a child sorts after its parent's opening and before its closing, whatever characters names hold
    below, end = "\x01", "\x02"
    parts = [spark.createDataFrame([("", "", '{"' + shape[0] + '": {', False), (end, "", "}}", False)], "key string, up string, json string, child boolean")]
    for depth, name in enumerate(shape):
        levels = LEVELS[: depth + 1]
        nodes = scope.select(*levels).where(" and ".join(f"{c} is not null" for c in levels)).distinct()
        up = F.concat(*[F.concat(F.lit(below), F.col(c)) for c in levels[:-1]]) if depth else F.lit("")
        key = F.concat(up, F.lit(below), F.col(levels[-1]))
        label = F.regexp_replace(F.to_json(F.array(levels[-1])), r"^\[|\]$", "")
        if name.startswith("["):
            parts.append(nodes.select(key.alias("key"), up.alias("up"), label.alias("json"), F.lit(True).alias("child")))
            continue
        deeper = shape[depth + 1] if depth + 1 < len(shape) else ""
        field, brackets = deeper.strip("[]"), "[]" if deeper.startswith("[") else "{}"
        head = f': {{"{field}": {brackets[0]}' if field else ": {"
        tail = f"{brackets[1]}}}" if field else "}"
        parts.append(nodes.select(key.alias("key"), up.alias("up"), F.concat(label, F.lit(head)).alias("json"), F.lit(True).alias("child")))
        parts.append(nodes.select(F.concat(key, F.lit(end)).alias("key"), up.alias("up"), F.lit(tail).alias("json"), F.lit(False).alias("child")))
    lines = materialise(reduce(lambda a, b: a.unionByName(b), parts), "map")
    first = lines.where("child").groupBy("up").agg(F.min("key").alias("_first")).select(F.col("_first"), F.lit(True).alias("_is"))
    marked = lines.join(first, lines["key"] == first["_first"], "left")
    comma = F.when(F.col("child") & F.col("_is").isNull(), ",").otherwise("")
    marked.orderBy("key").select(F.concat(comma, F.col("json"))).write.text(path)
    return path


def _label(name: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")


def _documents(entries: DataFrame, keys: list[str], top: Column, most: int) -> DataFrame:
    """Entries in order of their keys, with the document of each in ``_doc``: neighbours below one top, at most ``most``."""
    laid = laid_out(entries, keys, "map")
    return laid.withColumn("_doc", F.struct(top.alias("top"), F.col(RANGE).alias("range"), F.floor(F.col(PLACE) / most).alias("part")))


def write_map_documents(scope: DataFrame, path: str, platform: str, most: int = DOCUMENT) -> str:
    """Write a flat table as a folder of documents, one a line, each below one top container.

    A container with most of the map is cut: it opens in as many documents as it fills. Levels fold from the
    innermost one up, all within a document, so its rows move once.
    """
    _, shape = _shape(platform)
    levels = list(LEVELS[: len(shape)])
    rows = scope.where("l1 is not null").select(*levels).distinct()
    folded = _documents(rows, levels, F.col("l1"), most).select("_doc", *levels).repartition("_doc")
    folded = folded.withColumn("_json", F.lit(None).cast("string"))
    for depth in range(len(shape) - 1, -1, -1):
        name, key = shape[depth], F.col(levels[depth])
        if name.startswith("["):
            entry, begin, end = _label(key), "[", "]"
        else:
            deeper = shape[depth + 1] if depth + 1 < len(shape) else ""
            none = ("[]" if deeper.startswith("[") else "{}") if deeper.strip("[]") else ""
            field = F.lit(f'"{deeper.strip("[]")}": ') if deeper.strip("[]") else F.lit("")
            inner = F.coalesce("_json", F.lit(none))
            if depth + 1 < len(shape) and not deeper:  # the next level lies directly in this one
                body = F.coalesce("_json", F.lit("{}"))
            else:
                body = F.concat(F.lit("{"), field, inner, F.lit("}"))
            entry, begin, end = F.concat(_label(key), F.lit(": "), body), "{", "}"
        above = levels[:depth]
        listed = F.sort_array(F.collect_list(F.when(key.isNotNull(), entry)))
        folded = folded.groupBy("_doc", *above).agg(listed.alias("_all"))
        joined = F.concat(F.lit(begin), F.array_join("_all", ", "), F.lit(end))
        folded = folded.select("_doc", *above, F.when(F.size("_all") > 0, joined).alias("_json"))
    folded.select(F.concat(F.lit('{"' + shape[0] + '": '), F.col("_json"), F.lit("}"))).write.text(path)
    return path


def write_tree_map(files: DataFrame, path: str, levels: int = -1, most: int = DOCUMENT, column: str = "path") -> str:
    """Write the tree of some files' paths as a folder of documents, one a line, each below one top directory.

    Entries are put in order of their directories, so that a document is a run of neighbours: what stands between two of
    them closes and opens the directories that differ. A directory with most of the files opens in as many documents as
    it fills; nothing is gathered beyond a document's ``most`` entries.
    """
    entries = tree_entries(files, levels, column).select("dirs", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNotNull().alias("_file"))
    docs = _documents(entries, ["dirs", "name"], F.coalesce(F.get("dirs", F.lit(0)), F.concat(F.lit("/"), F.col("name"))), most)
    order = Window.partitionBy("_doc").orderBy(PLACE)
    docs = docs.withColumn("_before", F.lag("dirs").over(order)).withColumn("_last", F.lead(F.lit(False), 1, True).over(order))
    dirs, before = F.col("dirs"), F.col("_before")
    depth, was = F.size(dirs), F.size(before)

    def joined(upto: Column) -> Column:
        text = F.array_join(F.slice(dirs, F.lit(1), upto), "/")
        return F.when(text == "", "/").otherwise(text)

    shared = F.aggregate(
        F.sequence(F.lit(0), F.least(depth, was) - 1),
        F.lit(0),
        lambda n, i: F.when((n == i) & (F.get(dirs, i) == F.get(before, i)), n + 1).otherwise(n),
    )
    to_children = F.lit('],"subdirectories":[')

    def opened(since: Column) -> Column:
        heads = F.transform(
            F.sequence(since, depth - 1),
            lambda i: F.concat(
                F.lit('{"type":"directory","name":'), _label(F.get(dirs, i)), F.lit(',"path":'), _label(joined(i + 1)), F.lit(',"files":[')
            ),
        )
        return F.array_join(heads, '],"subdirectories":[')

    up = F.lit('],"subdirectories":[]}')
    docs = docs.withColumn("_shared", F.when(before.isNotNull(), shared))
    same = F.col("_shared")
    step = (
        F.when(before.isNull(), opened(F.lit(0)))
        .when((same == was) & (same == depth), ",")
        .when(same == was, F.concat(to_children, opened(same)))
        .otherwise(F.concat(up, F.expr("repeat(']}', size(_before) - _shared - 1)"), F.lit(","), opened(same)))
    )
    place = F.when(depth == 0, F.col("name")).otherwise(F.concat(F.array_join(dirs, "/"), F.lit("/"), F.col("name")))
    named = F.concat(F.lit('"name":'), _label(F.col("name")), F.lit(',"path":'), _label(place), F.lit("}"))
    file = F.when(F.col("_file"), F.concat(F.lit("{"), named)).otherwise("")
    close = F.when(F.col("_last"), F.concat(up, F.expr("repeat(']}', size(dirs) - 1)"))).otherwise("")
    text = F.when(depth == 0, F.concat(F.lit('{"type":"file",'), named)).otherwise(F.concat(step, file, close))
    told = docs.select("_doc", F.struct(F.col(PLACE).alias("place"), text.alias("text")).alias("_t"))
    told = told.groupBy("_doc").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    told.select(F.array_join(F.transform("_t", lambda t: t["text"]), "")).write.text(path)
    return path


def read_tree_map(spark: SparkSession, path: str, lines: bool = True, depth: int = DEPTH) -> DataFrame:
    """``path, name, kind, depth, empty`` of all files and directories of map documents.

    Directories are followed to any depth up to ``depth`` by a recursive query over the documents as variants. A directory is
    ``empty`` if no document lists anything in it. A document a line, or with ``lines=False`` a document a file.
    """
    docs = spark.read.text(path, wholetext=not lines).where(F.length(F.trim("value")) > 0)
    nodes = spark.sql(
        f"""WITH RECURSIVE tree(node, depth) MAX RECURSION LEVEL {int(depth)} AS (
          SELECT parse_json(value), 0 FROM {{docs}}
          UNION ALL
          SELECT s.value, depth + 1 FROM tree, LATERAL variant_explode(try_variant_get(node, '$.subdirectories', 'variant')) s)
        SELECT node, depth FROM tree""",
        docs=docs,
    )

    def text(field: str) -> Column:
        return F.try_variant_get("node", f"$.{field}", "string")

    def listed(field: str) -> Column:
        return F.size(F.coalesce(F.try_variant_get("node", f"$.{field}", "array<variant>"), F.array().cast("array<variant>")))

    own = nodes.select(
        text("path").alias("path"),
        text("name").alias("name"),
        F.coalesce(text("type"), F.lit("directory")).alias("kind"),
        "depth",
        ((listed("files") == 0) & (listed("subdirectories") == 0)).alias("empty"),
        F.expr("try_variant_get(node, '$.files', 'array<variant>')").alias("_files"),
    )
    inner = own.select((F.col("depth") + 1).alias("depth"), F.explode("_files").alias("node"))
    files = inner.select(text("path").alias("path"), text("name").alias("name"), F.lit("file").alias("kind"), "depth", F.lit(False).alias("empty"))
    found = own.drop("_files").unionByName(files).where("path is not null")
    return found.groupBy("path", "name", "kind", "depth").agg(F.bool_and(F.col("empty") & (F.col("kind") == "directory")).alias("empty"))
