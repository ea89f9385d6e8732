"""Reports of findings: native JSON, SARIF, GitLab."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.options import ScanOptions
from leaksieve.session import materialise

# Fixed values of the report formats.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "http://json.schemastore.org/sarif-2.1.0-rtm.4"
GITLAB_VERSION = "15.0.6"
SARIF_REDACTED = "xxxxxxxxxxxx"
RULER = "000000000000000 Sensitive data found (redacted) 000000000000000"
ADVICE = (
    "conduct a thorough search for any sensitive data. If a data leak is confirmed, proceed to rotate "
    "the data and eliminate any sensitive information from the ticket."
)


# What SARIF and GitLab reports say of a finding.
SARIF_MESSAGE = (
    "Potential Secret Leak on [{platform}]({url})."
    "\nDetails:\nSensitive data type: [{rule}] - Description: [{description}]\nPlatform: [{platform}]"
    " - Field: [ticket {field}]\nSource: {url}"
    f"\n{RULER}\n" + "{secret}" + f"\n{RULER}"
    "\nPlease verify the [{platform} ticket]({url}) and " + ADVICE
)
GITLAB_NAME = "Potential Secret Leak on {platform} {field}."
GITLAB_DESCRIPTION = (
    "\nSensitive data type: [{rule}] - Sensitive data description: [{description}] - Platform: [{platform}]"
    " - Field: [ticket {field}] - Source: {url}"
)
GITLAB_EVIDENCE = "Potential leaked secret (sanitized): [{secret}]"
GITLAB_SOLUTION = "\nPlease verify the {platform} ticket and " + ADVICE + " Ticket URL: {url}"


def report_kind(report_format: str) -> str:
    """``sarif`` or ``gitlab`` if the format's name contains it, else ``native``."""
    name = report_format.lower()
    return "sarif" if "sarif" in name else "gitlab" if "gitlab" in name else "native"


def _fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled by columns."""
    parts: list[Column] = []
    for piece in template.split("{"):
        name, brace, rest = piece.partition("}")
        parts += [values[name], F.lit(rest)] if brace else [F.lit(piece)]
    return F.concat(*parts)


def _redact(col: Column) -> Column:
    return F.replace(col, F.lit("<REDACTED>"), F.lit(SARIF_REDACTED))


# --- documents -----------------------------------------------------------------------------------
#
# A report is one JSON document, but its findings may be many. It is written by all tasks as a
# folder of text parts in document order: the parts, one after another, are the document.

_LAST = 2**31 - 1


def _text_row(findings: DataFrame, run: int, section: int, text: str) -> DataFrame:
    row = (F.lit(run).alias("run"), F.lit(section).alias("section"), F.lit("").alias("key"))
    return findings.sparkSession.range(1).select(*row, F.lit(text).alias("json"))


def _entries(rows: DataFrame, run: int, section: int, key: Column, entry: Column) -> DataFrame:
    return rows.select(
        F.lit(run).alias("run"), F.lit(section).alias("section"), key.alias("key"), entry.alias("json")
    )


def _stack(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_document(document: DataFrame, path: str) -> str:
    """Write (run, section, key, json) rows as text parts in order, entries parted by commas.

    Finding the first entries and sampling the order read the rows again, so they are stored first, each
    with a number that tells rows of equal keys apart.
    """
    document = materialise(document.withColumn("_at", F.monotonically_increasing_id()), "document")
    place = F.struct("key", "_at")
    first = document.where("key <> ''").groupBy("run", "section").agg(F.min(place).alias("_first"))
    later = ((F.col("key") != "") & (place != F.col("_first"))) | (
        (F.col("key") == "") & (F.col("section") == 0) & F.col("run").between(1, _LAST - 1)
    )
    (
        # one row per run and section, a handful however many entries there are
        document.join(F.broadcast(first), ["run", "section"], "left")
        .orderBy("run", "section", "key", "_at")
        .select(F.concat(F.when(later, ",").otherwise(""), "json"))
        .write.text(path)
    )
    return path


# --- native --------------------------------------------------------------------------------------


def report_records(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, finding): each finding as nested JSON, with the rule that made it."""
    config = rules.groupBy(F.col("id").alias("rule_id")).agg(
        F.min_by(F.to_json(F.struct(*_rule_fields(rules))), "rule_ord").alias("_config")
    )
    fallback = F.to_json(F.struct(F.col("rule_id").alias("id"), F.col("rule_description").alias("description")))
    head = F.to_json(F.struct("id", "url", "secret", "mocked_secret"))
    tail = F.to_json(F.struct("platform", "ticket_field"))
    finding = F.concat(
        F.regexp_replace(head, r"\}\z", ',"details":{"matched_regex_config":'),
        F.coalesce("_config", fallback),
        F.regexp_replace(tail, r"\A\{", ","),
        F.lit("}"),
    )
    return findings.join(config, "rule_id", "left").select("id", finding.alias("finding"))


def _rule_fields(rules: DataFrame) -> list[str]:
    wanted = ("id", "description", "regex", "example", "entropy", "keywords", "path", "secret_group", "allowlists")
    return [c for c in wanted if c in rules.columns]


def report_json(findings: DataFrame, rules: DataFrame, path: str, options: ScanOptions = ScanOptions()) -> str:
    """Write the native report: tool, date, rules, and the findings keyed by id."""
    findings = materialise(findings, "findings")
    now = dt.datetime.now(dt.timezone.utc)
    tool = {
        "name": options.tool_name,
        "version": options.tool_version,
        "author": options.tool_author,
        "scan_arguments": options.arguments(),
    }
    date = {"timestamp": now.timestamp(), "date_utc": now.strftime("%Y-%m-%dT%H:%M:%S")}
    head = json.dumps({"tool": tool, "scan_date": date})[:-1] + ', "regex_config": {"rules": ['
    records = report_records(findings, rules)
    document = _stack(
        _text_row(findings, 0, 0, head),
        _entries(rules, 0, 1, _order_key(), F.to_json(F.struct(*_rule_fields(rules)))),
        _text_row(findings, 0, 2, ']}, "findings": {'),
        _entries(records, 0, 3, F.col("id"), F.concat(F.lit('"'), "id", F.lit('":'), "finding")),
        _text_row(findings, 0, 4, "}}"),
    )
    return write_document(document, path)


_RULE = "struct<id:string,description:string,regex:string,example:string>"
_FINDING = (
    "struct<id:string,url:string,secret:string,mocked_secret:string,details:struct<"
    f"matched_regex_config:{_RULE},platform:string,ticket_field:string>>"
)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, rules) of a native report: a document folder, or one JSON file ending in ``.json``."""
    if path.endswith(".json"):
        shape = f"findings map<string,{_FINDING}>, regex_config struct<rules:array<{_RULE}>>"
        report = spark.read.schema(shape).option("multiLine", "true").json(path)
        found = report.select(F.explode("findings").alias("_k", "f"))
        rules = report.select(F.posexplode("regex_config.rules").alias("rule_ord", "r"))
    else:
        # every entry stands on a line of its own
        entry = F.regexp_replace("value", r'^,?("[0-9a-f]{64}":)?', "")
        lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))
        found = lines.where(F.col("value").rlike('^,?"[0-9a-f]{64}":')).select(F.from_json(entry, _FINDING).alias("f"))
        # the rules' order is that of the lines; a report holds at most MAX_RULES of them
        place = Window.orderBy("_file", "_at")
        listed = lines.where(F.col("value").rlike(r'^,?\{"id":')).select(
            "_file", F.monotonically_increasing_id().alias("_at"), F.from_json(entry, _RULE).alias("r")
        )
        rules = listed.select((F.row_number().over(place) - 1).alias("rule_ord"), "r")
    config = "f.details.matched_regex_config"
    findings = found.select(
        "f.id",
        "f.url",
        "f.secret",
        "f.mocked_secret",
        F.coalesce(f"{config}.id", F.lit("")).alias("rule_id"),
        F.coalesce(f"{config}.description", F.lit("")).alias("rule_description"),
        F.col("f.details.platform").alias("platform"),
        F.col("f.details.ticket_field").alias("ticket_field"),
    )
    return findings, rules.select(F.col("rule_ord").cast("int").alias("rule_ord"), "r.*")


def report_date(spark: SparkSession, path: str) -> str | None:
    """When the scan of a native report ran, as it says itself."""
    if path.endswith(".json"):
        rows = spark.read.schema("scan_date struct<date_utc:string>").option("multiLine", "true").json(path)
        row = rows.select("scan_date.date_utc").first()
    else:  # the head is the only line that begins the document
        date = F.regexp_extract("value", r'"scan_date": \{.*?"date_utc": "([^"]*)"', 1).alias("date")
        row = spark.read.text(path).where(F.col("value").startswith('{"tool": ')).select(date).first()
    return row[0] if row and row[0] else None


def convert_report(spark: SparkSession, path: str, target: str, options: ScanOptions) -> str:
    """Turn a native report into the format the options name."""
    findings, rules = read_report(spark, path)
    return save_report(findings, rules, target, options, report_date(spark, path))


def _order_key() -> Column:
    return F.format_string("%010d", F.col("rule_ord"))


# --- SARIF -----------------------------------------------------------------------------------------


def sarif_rules(rules: DataFrame, findings: DataFrame, help_url: str = "") -> DataFrame:
    """SARIF rule objects, flat; a rule that only findings know is listed once per such finding.

    ``rule_ord`` and ``origin`` (the finding, for such a rule) give the order.
    """
    columns = lambda order, origin, name, text: [
        order.alias("rule_ord"),
        origin.alias("origin"),
        F.col("id"),
        name.alias("name"),
        text.alias("short_description"),
        text.alias("full_description"),
        F.lit("note").alias("level"),
        F.lit(help_url).alias("help_uri"),
    ]
    description = F.coalesce(F.col("description"), F.lit(""))
    known = rules.select(*columns(F.col("rule_ord"), F.lit(""), description, description))
    unknown = (
        findings.select(F.col("id").alias("origin"), F.col("rule_id").alias("id"))
        .join(rules.select("id"), "id", "left_anti")
        .select(
            *columns(F.lit(_LAST), F.col("origin"), F.concat(F.lit("Secret Leak - "), F.col("id")), F.col("id"))
        )
    )
    return known.unionByName(unknown)


def sarif_rule_index(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_index``: the 1-based place of the finding's rule, case ignored, or -1."""
    places = rules.groupBy(F.lower("id").alias("_rid")).agg((F.min("rule_ord") + 1).cast("bigint").alias("_place"))
    joined = findings.join(places, F.lower("rule_id") == F.col("_rid"), "left")
    return joined.withColumn("rule_index", F.coalesce("_place", F.lit(-1).cast("bigint"))).drop("_rid", "_place")


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """SARIF results, flat."""
    message = _fill(
        SARIF_MESSAGE,
        platform=F.col("platform"),
        url=F.col("url"),
        rule=F.col("rule_id"),
        description=F.col("rule_description"),
        field=F.col("ticket_field"),
        secret=F.col("secret"),
    )
    return sarif_rule_index(findings, rules).select(
        "rule_id",
        "rule_index",
        _redact(message).alias("message"),
        F.lit("note").alias("level"),
        F.col("id").alias("uri"),
        F.lit("ROOTPATH").alias("uri_base_id"),
        F.col("url").alias("location_message"),
    )


def sarif_run(
    findings: DataFrame, rules: DataFrame, options: ScanOptions = ScanOptions(), run: int = 0
) -> DataFrame:
    """One SARIF run as document rows."""
    position = F.struct(*[F.lit(1).alias(k) for k in ("startLine", "startColumn", "endLine", "endColumn")])
    artifact = F.struct(F.col("uri").alias("uri"), F.col("uri_base_id").alias("uriBaseId"))
    location = F.struct(
        F.struct(artifact.alias("artifactLocation"), position.alias("region")).alias("physicalLocation"),
        F.struct(F.col("location_message").alias("text")).alias("message"),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.col("level"),
        F.array(location).alias("locations"),
    )
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct(
        "id",
        "name",
        text("short_description").alias("shortDescription"),
        text("full_description").alias("fullDescription"),
        F.struct("level").alias("defaultConfiguration"),
        F.nullif("help_uri", F.lit("")).alias("helpUri"),
    )
    driver = {
        "name": options.tool_name,
        "version": options.tool_version,
        "fullName": _full_name(options),
    } | ({"informationUri": options.info_url} if options.info_url else {})
    rule_rows = sarif_rules(rules, findings, options.info_url)
    rule_key = F.concat(_order_key(), F.lit("/"), F.col("origin"))
    return _stack(
        _text_row(findings, run, 0, '{"tool": {"driver": ' + json.dumps(driver)[:-1] + ', "rules": ['),
        _entries(rule_rows, run, 1, rule_key, F.to_json(rule)),
        _text_row(findings, run, 2, ']}}, "results": ['),
        _entries(sarif_results(findings, rules), run, 3, F.col("uri"), F.to_json(result)),
        _text_row(findings, run, 4, "]}"),
    )


def _full_name(options: ScanOptions) -> str:
    return f"{options.tool_name} secret scanner by {options.tool_author} - version: [{options.tool_version}]"


def sarif_file_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a SARIF file as document rows, one each."""
    whole = spark.read.text(path, wholetext=True)
    runs = F.from_json(F.regexp_replace("value", "^\ufeff", ""), "runs array<string>")["runs"]
    return whole.select(F.posexplode(runs).alias("run", "json")).select(
        "run", F.lit(0).alias("section"), F.lit("").alias("key"), "json"
    )


def sarif_append_runs(
    findings: DataFrame,
    rules: DataFrame,
    path: str,
    options: ScanOptions = ScanOptions(),
    old_path: str | None = None,
) -> str:
    """Write a SARIF document that holds the runs of an older one followed by this scan's run.

    ``path/rows`` keeps the document's rows for the next append, ``path/document`` is the text. The
    older folder is only read, so that a lost task can be repeated. ``old_path`` may also be a SARIF file
    of any tool, ending in ``.sarif`` or ``.json``: its runs are kept as they are.
    """
    spark = findings.sparkSession
    findings = materialise(findings, "findings")
    old = None
    if old_path:
        own = not old_path.endswith((".sarif", ".json"))
        old = spark.read.parquet(f"{old_path}/rows") if own else sarif_file_runs(spark, old_path)
    number = (old.agg(F.max("run")).first()[0] if old_path else -1)
    number = 0 if number is None else number + 1
    rows = sarif_run(findings, rules, options, number)
    rows = old.unionByName(rows) if old_path else rows
    rows.write.parquet(f"{path}/rows")
    envelope = json.dumps({"version": SARIF_VERSION, "$schema": SARIF_SCHEMA})[:-1] + ', "runs": ['
    write_document(
        _stack(
            _text_row(findings, -1, 0, envelope),
            spark.read.parquet(f"{path}/rows"),
            _text_row(findings, _LAST, 0, "]}"),
        ),
        f"{path}/document",
    )
    return path


# --- GitLab ----------------------------------------------------------------------------------------


def gitlab_vulns(findings: DataFrame) -> DataFrame:
    """GitLab vulnerabilities, flat."""
    c = {
        "platform": F.col("platform"),
        "field": F.col("ticket_field"),
        "url": F.col("url"),
        "rule": F.col("rule_id"),
        "description": F.col("rule_description"),
        "secret": _redact(F.col("secret")),
    }
    name = _fill(GITLAB_NAME, **c)
    description = _fill(GITLAB_DESCRIPTION, **c)
    return findings.select(
        "id",
        F.concat(name, description).alias("description"),
        _fill("{field} field on {platform}", **c).alias("discovered_at"),
        _fill("[{secret}]", **c).alias("sanitized_secret"),
        _fill(GITLAB_EVIDENCE, **c).alias("evidence_summary"),
        F.col("url").alias("url"),
        F.col("rule_description").alias("identifier_name"),
        F.col("rule_id").alias("identifier_value"),
        _fill("{platform} {field}", **c).alias("link_name"),
        name.alias("name"),
        F.lit("Info").alias("severity"),
        _fill(GITLAB_SOLUTION, **c).alias("solution"),
    )


def gitlab_records(findings: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The vulnerabilities as nested JSON, one per row."""
    text = lambda name, col: F.struct(F.lit(name).alias("name"), F.lit("text").alias("type"), F.col(col).alias("value"))
    no_headers = F.array().cast("array<string>")
    urls = F.struct(
        F.array(F.struct(F.col("url").alias("href"), F.lit("url").alias("type"))).alias("items"),
        F.lit("URLs").alias("name"),
        F.lit("list").alias("type"),
    )
    details = F.struct(
        text("Discovered at:", "discovered_at").alias("discovered_at"),
        text("Sensitive data found (redacted):", "sanitized_secret").alias("sanitized_secret"),
        urls.alias("urls"),
    )
    evidence = F.struct(
        F.col("evidence_summary").alias("summary"),
        F.struct(no_headers.alias("headers"), F.lit("GET").alias("method"), F.col("url")).alias("request"),
        F.struct(
            no_headers.alias("headers"), F.lit("OK").alias("reason_phrase"), F.lit(200).alias("status_code")
        ).alias("response"),
    )
    identifier = F.struct(
        F.lit("regex").alias("type"),
        F.col("identifier_name").alias("name"),
        F.nullif(F.lit(options.info_url), F.lit("")).alias("url"),
        F.col("identifier_value").alias("value"),
    )
    links = F.array(
        F.struct(F.col("link_name").alias("name"), F.col("url").alias("url")),
        F.struct(F.lit("Documentation").alias("name"), F.lit(options.info_url).alias("url")),
    )
    links = F.filter(links, lambda x: x["url"] != "")
    location = F.struct(
        F.col("url").alias("hostname"), *[F.lit("").alias(k) for k in ("method", "param", "path")]
    )
    vulnerability = F.struct(
        "id",
        "description",
        details.alias("details"),
        evidence.alias("evidence"),
        F.array(identifier).alias("identifiers"),
        links.alias("links"),
        location.alias("location"),
        "name",
        "severity",
        "solution",
    )
    return gitlab_vulns(findings).select("id", F.to_json(vulnerability).alias("vulnerability"))


def gitlab_report(
    findings: DataFrame, path: str, options: ScanOptions = ScanOptions(), start: str | None = None
) -> str:
    """Write the GitLab report: an envelope around one vulnerability per finding.

    ``start`` is when the scan ran; without one it is the time of writing.
    """
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    vendor = {"name": options.tool_author}
    tool = {
        "id": options.tool_name,
        "name": _full_name(options),
        "version": options.tool_version,
        "vendor": vendor,
    }
    named = ("scan_target", "label", "contact_help", "report_format")
    scan_part = {
        "analyzer": tool,
        "end_time": now,
        "messages": [],
        "options": [{"name": n, "value": getattr(options, n)} for n in named],
        "scanned_resources": [],
        "scanner": tool | ({"url": options.info_url} if options.info_url else {}),
        "start_time": start or now,
        "status": "success",
        "type": "dast",
    }
    document = _stack(
        _text_row(findings, 0, 0, json.dumps({"version": GITLAB_VERSION})[:-1] + ', "vulnerabilities": ['),
        _entries(gitlab_records(findings, options), 0, 1, F.col("id"), F.col("vulnerability")),
        _text_row(findings, 0, 2, '], "remediations": [], "scan": ' + json.dumps(scan_part) + "}"),
    )
    return write_document(document, path)


def save_report(
    findings: DataFrame, rules: DataFrame, path: str, options: ScanOptions = ScanOptions(), start: str | None = None
) -> str:
    """Write the report in the format the options name. ``start``: when the scan ran, for formats that say it."""
    kind = report_kind(options.report_format)
    if kind == "sarif":
        return sarif_append_runs(findings, rules, path, options)
    if kind == "gitlab":
        return gitlab_report(findings, path, options, start)
    return report_json(findings, rules, path, options)
