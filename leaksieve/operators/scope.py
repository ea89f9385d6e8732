"""What is scanned: predicates, owners and branches, time windows, maps of containers and parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaksieve.operators.ordered import laid_out, running

# Names a scope query may be introduced with.
QUERY_TERMS = ("jql", "cql", "search", "query")
LEVELS = ("l1", "l2", "l3", "l4")
ONE_LEVEL_AT_ZERO = ("jira", "confluence")  # level 0 means the top level here, all levels elsewhere
MAX_DAYS = 365 * 100  # how far time windows reach back unless told otherwise


def scope_query(scope: str | None) -> tuple[str, str] | None:
    """(term, predicate) of a scope such as ``query: lang = 'en'``; case and blanks are ignored."""
    for term in QUERY_TERMS:
        if scope and scope.lower().replace(" ", "").startswith(term + ":"):
            return term, scope[len(term) + 1 :].lstrip(" :")
    return None


def _predicate(scope: str) -> Column:
    query = scope_query(scope)
    return F.expr(query[1] if query else scope)


def scope_filter(content: DataFrame, scope: str) -> DataFrame:
    """Keep what satisfies a Spark SQL predicate; the predicate reaches the file scan."""
    return content.where(_predicate(scope))


def scope_filter_or_all(content: DataFrame, scope: str) -> DataFrame:
    """Like :func:`scope_filter`, but everything when nothing satisfies the predicate.

    Whether anything does is a scalar subquery that stops at the first hit: the source is planned twice.
    """
    hit = _predicate(scope)
    first = content.where(hit).select(F.lit(1).alias("_hit")).limit(1)
    nothing = first.agg(F.count(F.lit(1)).alias("_n")).scalar() == 0
    return content.where(F.coalesce(hit, F.lit(False)) | nothing)


def owner_repo_filter(files: DataFrame, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """Files of one owner and repository, names compared ignoring case.

    A table with ``path_with_namespace`` is matched on ``owner/repo`` or the numeric project id.
    """
    if "path_with_namespace" in files.columns:
        if owner:
            files = files.where(F.startswith(F.lower("path_with_namespace"), F.lit(owner.lower() + "/")))
        if repo:
            full = f"{owner}/{repo}".lower() if owner else repo.lower()
            files = files.where(
                (F.lower("path_with_namespace") == full) | (F.col("project_id").cast("string") == repo)
            )
        return files
    if owner:
        files = files.where(F.lower("owner") == owner.lower())
    if repo:
        files = files.where(F.lower("repo") == repo.lower())
    return files


def branch_filter(files: DataFrame, spec: str | None = None) -> DataFrame:
    """Files of the listed branches; ``default`` alone means each repository's default branch."""
    if not spec:
        return files
    names = spec.split(",")
    if len(names) == 1 and names[0].lower() == "default":
        return files.where(F.col("branch") == F.col("default_branch"))
    return files.where(F.col("branch").isin(*names))


def time_window_filter(messages: DataFrame, after: str, before: str, ts: str = "ts") -> DataFrame:
    """Messages strictly after one day and strictly before another.

    Written as bounds on the timestamp itself, so that the scan can skip row groups.
    """
    start = dt.date.fromisoformat(after) + dt.timedelta(days=1)
    kind = messages.schema[ts].dataType
    return messages.where(
        (F.col(ts) >= F.lit(str(start)).cast(kind)) & (F.col(ts) < F.lit(before).cast(kind))
    )


def day_windows(messages: DataFrame, now: str, ts: str = "ts", max_days: int = MAX_DAYS) -> DataFrame:
    """(window_id, start_day, end_day, n): windows from ``now`` back, both end days exclusive.

    The width doubles while windows are empty and falls back to one day on a hit. Messages are reduced to counts
    per day and days to runs of neighbours, at most ``max_days`` of them; what a gap takes follows from its length:
    windows of 1, 2, 4 … days end with the first that reaches the next run. Messages outside the reach are counted in two rows
    of their own: window -1 after ``now`` and -2 before the reach, each with one null end; they are there only if not empty.
    """
    today = dt.date.fromisoformat(now)
    back = F.datediff(F.lit(today), F.to_date(ts))
    days = messages.where(back.isNotNull()).groupBy(F.greatest(F.least(back, F.lit(max_days)), F.lit(-1)).alias("day"))
    days = days.agg(F.count(F.lit(1)).alias("n"))
    # days in a row have the same difference to their number
    numbered = days.where(f"day BETWEEN 0 AND {max_days - 1}").withColumn("_k", F.row_number().over(Window.orderBy("day")))
    runs = numbered.groupBy((F.col("day") - F.col("_k")).alias("_r")).agg(F.min("day").alias("begin"), F.max("day").alias("end"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))

    segment = "struct<first:bigint,day:bigint,windows:bigint,doubles:boolean>"

    def log2(n: Column) -> Column:
        """Whole part of the binary logarithm, without rounding errors."""
        return F.length(F.bin(n)) - 1

    def add(state: Column, run: Column) -> Column:
        """``day``: where the next window of one day begins, counted back from today; ``id``: its number."""
        day, number = state["day"], state["id"]
        doubled = log2(run["begin"] - day + 1) + 1  # windows until one reaches the run
        waits = run["begin"] > day
        after = F.when(waits, day + F.pow(F.lit(2), doubled).cast("bigint") - 1).otherwise(day)
        singles = F.greatest(run["end"] - after + 1, F.lit(0))
        counted = F.when(waits, doubled).otherwise(0)
        gap = F.array(F.struct(number.alias("first"), day.alias("day"), doubled.cast("bigint").alias("windows"), F.lit(True).alias("doubles")))
        each = F.array(
            F.struct((number + counted).alias("first"), after.alias("day"), singles.cast("bigint").alias("windows"), F.lit(False).alias("doubles"))
        )
        none = F.expr(f"cast(array() as array<{segment}>)")
        passed = run["end"] < day  # a long window has taken the whole run
        return F.when(passed, state).otherwise(
            F.struct(
                (after + singles).alias("day"),
                (number + counted + singles).cast("bigint").alias("id"),
                F.concat(state["segments"], F.when(waits, gap).otherwise(none), F.when(singles > 0, each).otherwise(none)).alias("segments"),
            )
        )

    start = F.expr(f"named_struct('day', 0L, 'id', 0L, 'segments', cast(array() as array<{segment}>))")
    state = runs.select(F.aggregate("runs", start, add).alias("s"))
    last = F.struct(F.col("s.id").alias("first"), F.col("s.day").alias("day"), F.lit(64 - 1).cast("bigint").alias("windows"), F.lit(True).alias("doubles"))
    segments = state.select(F.explode(F.concat("s.segments", F.array(last))).alias("g"))
    laid = segments.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("g.windows"), F.lit(max_days)) - 1)).alias("k"))
    step = F.when(F.col("g.doubles"), F.expr("shiftleft(1L, cast(least(k, 40) as int))")).otherwise(1)
    skipped = F.when(F.col("g.doubles"), step - 1).otherwise(F.col("k"))
    windows = laid.select((F.col("g.first") + F.col("k")).alias("window_id"), (F.col("g.day") + skipped).alias("_day"), step.alias("_width"))
    windows = windows.where(f"_day + _width - 1 < greatest({max_days}, 1)")
    covered = windows.select("window_id", F.explode(F.sequence(F.col("_day"), F.col("_day") + F.col("_width") - 1)).alias("day"))
    counted = covered.join(days, "day").groupBy("window_id").agg(F.sum("n").alias("n"))
    found = windows.join(counted, "window_id", "left").select(
        "window_id",
        F.greatest(F.expr("DATE '0001-01-01'"), F.date_sub(F.lit(today), (F.col("_day") + F.col("_width")).cast("int"))).alias("start_day"),
        F.date_sub(F.lit(today), (F.col("_day") - 1).cast("int")).alias("end_day"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    no_day = F.lit(None).cast("date")
    reach = today - dt.timedelta(days=max_days - 1)
    outside = days.where(f"day < 0 OR day >= {max_days}").select(
        F.when(F.col("day") < 0, -1).otherwise(-2).cast("bigint").alias("window_id"),
        F.when(F.col("day") < 0, F.lit(today)).otherwise(no_day).alias("start_day"),
        F.when(F.col("day") < 0, no_day).otherwise(F.lit(reach)).alias("end_day"),
        "n",
    )
    return found.unionByName(outside)


# --- maps of containers ------------------------------------------------------------------------


def scope_map(content: DataFrame, platform: str, keys: list[str], levels: int = -1) -> DataFrame:
    """Inventory of containers: the distinct values of the first ``levels`` key columns."""
    depth = len(keys) if levels < 1 else min(levels, len(keys))
    if levels == 0 and platform.lower() in ONE_LEVEL_AT_ZERO:
        depth = 1
    columns = [F.col(k).cast("string") for k in keys[:depth]]
    columns += [F.lit(None).cast("string")] * (len(LEVELS) - depth)
    named = [c.alias(name) for c, name in zip(columns, LEVELS)]
    return content.select(F.lit(platform).alias("platform"), *named).distinct()


def file_tree_map(files: DataFrame, levels: int = -1, path: str = "path") -> DataFrame:
    """(directory, depth, n_files) for every directory on the way to a file, the top being depth 0.

    With ``levels`` the walk stops there: a directory at that depth is listed without its files.
    """
    parts = F.split(F.col(path), "/")
    depth = F.size(parts) - 1
    at = F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0)))
    rows = files.select(
        parts.alias("_parts"), depth.alias("_depth"), F.explode(at).alias("_at")
    ).select(
        F.array_join(F.slice("_parts", 1, F.col("_at") + 1), "/").alias("directory"),
        F.col("_at").alias("depth"),
        (F.col("_at") == F.col("_depth") - 1).cast("bigint").alias("_own"),
    )
    if levels >= 0:
        rows = rows.where(F.col("depth") <= levels).withColumn(
            "_own", F.when(F.col("depth") == levels, F.lit(0)).otherwise(F.col("_own"))
        )
    return rows.groupBy("directory", "depth").agg(F.sum("_own").cast("bigint").alias("n_files"))


def scope_semi_join(content: DataFrame, scope: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Content that a map lists; a container listed without children stands for all of it.

    ``keys`` are the container levels from the top, in both tables. One pass over the content,
    with one flag per level. Joins above the last level are salted by a hash of the whole row: a container
    may hold a third of the content, and its few rows in the map are simply repeated for every salt.
    Nothing is written: a map stored beforehand has a size that the planner knows.
    """
    scope = scope.select(*keys).distinct()
    marked = content.withColumn("_salt", F.pmod(F.xxhash64(*content.columns), F.lit(salts)).cast("int"))
    flags = []
    for depth in range(1, len(keys) + 1):
        path, flag = keys[:depth], f"_in{depth}"
        listed = scope.where(F.col(path[-1]).isNotNull())
        if depth < len(keys):
            listed = (
                listed.groupBy(*path)
                .agg(F.count(keys[depth]).alias("_children"))
                .where("_children = 0")
                .select(*path, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
            )
            on = [*path, "_salt"]
        else:
            listed, on = listed.select(*path), path
        marked = marked.join(listed.withColumn(flag, F.lit(True)), on, "left")
        flags.append(flag)
    return marked.where(F.coalesce(*flags)).select(*content.columns)


def scope_chunk(scope: DataFrame, index: int, parts: int, keys: list[str] | None = None) -> DataFrame:
    """Part ``index`` (from 1) of ``parts`` of a map: disjoint, complete, the same on every run."""
    if not 1 <= index <= parts:
        raise ValueError("the part must lie between 1 and the number of parts")
    keys = keys or scope.columns
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % parts
    return scope.where(bucket == index - 1)


def scope_parts_balanced(scope: DataFrame, parts: int, keys: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """Add ``part`` (from 1): parts of about equal size in characters, whatever containers hold.

    Rows fall into hash buckets of their whole key, nulls included; buckets are dealt to parts in order by a
    running total of their sizes, a table of at most ``buckets`` rows.
    """
    keys = keys or scope.columns
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets
    rows = scope.withColumn("_b", bucket).withColumn("_size", F.length(key) + 1)
    sizes = rows.groupBy("_b").agg(F.sum("_size").alias("_size"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0))
    part = F.floor(start * parts / F.sum("_size").over(Window.partitionBy())) + 1
    placed = sizes.select("_b", part.cast("int").alias("part"))
    return rows.join(F.broadcast(placed), "_b").drop("_b", "_size")


def scope_chunk_balanced(scope: DataFrame, index: int, parts: int, keys: list[str] | None = None) -> DataFrame:
    """Part ``index`` (from 1) of a map cut into ``parts`` parts of about equal size."""
    if not 1 <= index <= parts:
        raise ValueError("the part must lie between 1 and the number of parts")
    return scope_parts_balanced(scope, parts, keys).where(F.col("part") == index).select(*scope.columns)


def scope_parts_contiguous(scope: DataFrame, parts: int, keys: list[str] | None = None) -> DataFrame:
    """Add ``part`` (from 1): neighbours in key order share a part, parts are of about equal size in characters.

    The running size over the whole map is put together from ranges of keys, so a container with most of the map is cut
    into parts by many tasks.
    """
    keys = keys or scope.columns
    named = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    laid = laid_out(scope.withColumn("_size", (F.length(named) + 1).cast("bigint")), keys, "parts")
    total = laid.agg(F.sum("_size").alias("_all")).scalar()
    summed = running(laid, "_size", "_until", "sum")
    part = F.floor((F.col("_until") - F.col("_size")) * parts / total) + 1
    return summed.select(*scope.columns, part.cast("int").alias("part"))


def scope_chunk_contiguous(scope: DataFrame, index: int, parts: int, keys: list[str] | None = None) -> DataFrame:
    """Part ``index`` (from 1) of a map cut into ``parts`` runs of neighbours of about equal size."""
    if not 1 <= index <= parts:
        raise ValueError("the part must lie between 1 and the number of parts")
    return scope_parts_contiguous(scope, parts, keys).where(F.col("part") == index).select(*scope.columns)
