"""Registered queries and the SQL each is checked against.

Every query reads the given tables whole. Texts, tickets, rules and maps are all derived from
those tables, so the work grows with them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.catalogue import default_rules
from leaksieve.functions import regex as rx
from leaksieve.functions import text as tx
from leaksieve.operators import comments as cm
from leaksieve.operators import findings as fi
from leaksieve.operators import flatten as fl
from leaksieve.operators import ledger as lg
from leaksieve.operators import masking as mk
from leaksieve.operators import matching as mt
from leaksieve.operators import rules as ru
from leaksieve.operators import scope as sc
from leaksieve.operators import tree as tr
from leaksieve.options import MatchOptions, ScanOptions
from leaksieve.plans.files import scan_files
from leaksieve.plans.scan import match_content, scan_platform
from leaksieve.session import configure, materialise, scratch_path
from leaksieve.sinks import reports as rp
from leaksieve.sources import files, maps, trackers
from leaksieve.sources.union import union_sources
from leaksieve.streaming import first as ft
from leaksieve.streaming import stream as st

SMOKE_DIR = "/root/testdata/sf0.001"
LABEL = "KEIT"  # stands in for the bot's label in the conversations
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[a-z]+)+"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"

RULES = ru.RuleSet.from_dict(
    {
        "rules": [
            {
                "id": "quoted-token",
                "description": "A token in quotes",
                "regex": 'token = "[0-9a-f]{40}"',
                "example": 'token = "made-up"',
                "keywords": ["token"],
                "entropy": 4.0,
                "path": "[02468]$",
                "secretGroup": 1,
            },
            {
                "id": "email",
                "description": "An e-mail address",
                "regex": EMAIL,
                "example": "someone@example.com",
                "keywords": ["@mail1.", "@mail2.", "@mail3.", "@mail5."],
                "entropy": 3.6,
                "allowlists": [
                    {"regexes": [r"mail[13]\.example"], "paths": ["[13]$"], "regexTarget": "match"},
                    {"regexes": ["the the the"], "regexTarget": "line"},
                ],
            },
            {
                "id": "ipv4",
                "description": "An IP address",
                "regex": IPV4,
                "example": "192.0.2.1",
                "entropy": 2.9,
                "allowlists": [{"regexes": ["&&&", "(?i)license"], "stopwords": ["19"]}],
            },
            {"id": "phone", "description": "A phone number", "regex": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"},
            {"id": "license", "description": "A license", "regex": "released (?i)under the [a-z]+", "example": ""},
        ],
        "allowlist": {"paths": ["doc/[0-9]*7$"], "regexes": [r"^[0-9.]+[02468]$"], "stopwords": ["mail2", "99"]},
    }
)
# the second rule table has a group, so that the group can be reported on its own
GROUP_RULES = ru.RuleSet.from_dict(
    {"rules": [{"id": "token-value", "regex": 'token = "([0-9a-f]{40})"', "secretGroup": 1, "example": "x"}]}
)


# --- inputs ------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_tickets(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return _table(spark, d, "documents").select(
        F.lit("LocalFilesystem").alias("platform"), url.alias("issue_id"), url.alias("url"), F.col("text").alias("file")
    )


def _doc_texts(spark: SparkSession, d: str) -> DataFrame:
    return fl.flatten_fields(_doc_tickets(spark, d))


def _source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source share a url, so that equal leaks collapse into one finding."""
    docs = _table(spark, d, "documents")
    return docs.select(
        F.lit("GitHub").alias("platform"),
        F.col("doc_id").cast("string").alias("issue_id"),
        F.concat(F.lit("src/"), F.col("lang")).alias("url"),
        F.lit("file").alias("field"),
        F.lit(3).alias("field_ord"),
        F.col("doc_id").alias("item_ord"),
        "text",
    )


def _matches(spark: SparkSession, d: str, options: MatchOptions = MatchOptions()) -> DataFrame:
    return mt.scan_texts(_doc_texts(spark, d), RULES, options)


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return fi.dedup_findings(fi.build_findings(_matches(spark, d)))


def _conv_tickets(spark: SparkSession, d: str) -> DataFrame:
    first = _table(spark, d, "conversations").where("turn = 0")
    issue = F.col("conv_id").cast("string")
    return first.select(
        F.lit("Jira").alias("platform"),
        issue.alias("issue_id"),
        F.concat(F.lit("conv/"), issue).alias("url"),
        F.concat(F.lit("Conversation "), issue).alias("title"),
        F.col("text").alias("description"),
    )


def _conv_comments(spark: SparkSession, d: str) -> DataFrame:
    later = _table(spark, d, "conversations").where("turn > 0")
    return later.select(
        F.lit("Jira").alias("platform"),
        F.col("conv_id").cast("string").alias("issue_id"),
        F.col("turn").alias("item_ord"),
        "text",
    )


# conversations hold no leaks of the rules above, so a word pattern stands in for them
WORD_RULES = ru.RuleSet.from_dict(
    {"rules": [{"id": "word", "description": "A word", "regex": "(?i)[a-z]*tion[a-z]*", "example": "WORD"}]}
)
POSTING = ScanOptions(post_comment=True, config_label=LABEL, label="bot#1", message_template="Hi {bot_name}: {finding_info} <&>")


def _conv_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_content(_conv_tickets(spark, d), _conv_comments(spark, d), WORD_RULES, ScanOptions(config_label="no such label"))


def _git_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of repositories; each ends with a byte that is not UTF-8."""
    return _table(spark, d, "documents").select(
        F.upper("lang").alias("owner"),
        F.concat(F.lit("Repo-"), "source").alias("repo"),
        F.concat(F.lit("https://code.example.com/"), "source").alias("html_url"),
        F.concat(F.lit("https://code.example.com/"), "source").alias("web_url"),
        F.concat(F.lit("Group/"), "source").alias("path_with_namespace"),
        F.pmod("doc_id", F.lit(50)).alias("project_id"),
        F.when(F.col("source") < "src15", "en").otherwise("fr").alias("default_branch"),
        F.col("lang").alias("branch"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).alias("content"),
        "doc_id",
    )


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the containers they lie in: region, nation, customer."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = _table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, d, "nation")
    region = _table(spark, d, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("l1"),
            F.col("n_name").alias("l2"),
            F.col("c_custkey").cast("string").alias("l3"),
            F.col("o_orderkey").cast("string").alias("l4"),
            "o_orderpriority",
        )
    )


def _rule_table(spark: SparkSession, d: str) -> DataFrame:
    """One rule per brand of the parts; the ids of some rules above appear among them."""
    brands = _table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    ids = (
        F.when(F.col("p_brand") == "Brand#1", "QUOTED-TOKEN").when(F.col("p_brand") == "Brand#2", "ipv4")
    )
    order = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return brands.select(
        order.alias("rule_ord"),
        F.coalesce(ids, F.col("p_brand")).alias("id"),
        F.concat(F.lit("Parts of "), "p_brand").alias("description"),
        F.concat("p_brand", F.lit("(?i)[^0-9]")).alias("regex"),
        F.concat("p_brand", F.lit(" ")).alias("example"),
    )


# --- SQL for the same inputs ------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A rule's pattern as DuckDB's regex engine takes it."""
    return rx.hoist_flags(pattern)


DOC_SQL = """SELECT 'LocalFilesystem' AS platform, 'doc/' || doc_id AS issue_id, 'doc/' || doc_id AS url,
 'file' AS field, 3 AS field_ord, 0::bigint AS item_ord, text FROM documents WHERE text <> ''"""
SOURCE_SQL = """SELECT 'GitHub' AS platform, doc_id::varchar AS issue_id, 'src/' || lang AS url,
 'file' AS field, 3 AS field_ord, doc_id AS item_ord, text FROM documents"""
CONV_TICKETS_SQL = """SELECT 'Jira' AS platform, conv_id::varchar AS issue_id, 'conv/' || conv_id AS url,
 'Conversation ' || conv_id AS title, text AS description FROM conversations WHERE turn = 0"""
CONV_COMMENTS_SQL = """SELECT 'Jira' AS platform, conv_id::varchar AS issue_id, turn AS item_ord, text
 FROM conversations WHERE turn > 0"""
CONV_SQL = f"""SELECT * FROM (
 SELECT platform, issue_id, url, 'title' AS field, 0 AS field_ord, 0::bigint AS item_ord, title AS text FROM ({CONV_TICKETS_SQL})
 UNION ALL SELECT platform, issue_id, url, 'description', 1, 0, description FROM ({CONV_TICKETS_SQL})
 UNION ALL SELECT c.platform, c.issue_id, t.url, 'comments', 2, c.item_ord, c.text
 FROM ({CONV_COMMENTS_SQL}) c JOIN ({CONV_TICKETS_SQL}) t USING (issue_id)) WHERE text <> ''"""


def _matches_sql(
    texts: str = DOC_SQL,
    rules: ru.RuleSet = RULES,
    accept: Callable[[int, str], str] | None = None,
    by_text: bool = False,
) -> str:
    """CTEs t, m, e, x that scan ``texts`` rule by rule; x holds one row per matched text.

    ``by_text`` looks the secret up by its text, where a pattern is too large for a prefix capture.
    """
    cases, secrets, prefixes, examples, ids, descriptions, regexes = [], [], [], [], [], [], []
    for i, rule in enumerate(rules.rules):
        p = _re2(rule.regex)
        test = f"regexp_matches(text, {_q(p)})"
        for allow in rule.allowlists:
            for r in allow.regexes:
                test += f" AND NOT regexp_matches(text, {_q(_re2(r))})"
        test = accept(i, test) if accept else test
        cases.append(f"WHEN {test} THEN {i}")
        secrets.append(f"WHEN {i} THEN regexp_extract(text, {_q(p)}, 0)")
        prefix = f"regexp_extract(text, {_q('(?s:^(.*?))(?:' + p + ')')}, 1)"
        if by_text:
            prefix = f"left(text, strpos(text, regexp_extract(text, {_q(p)}, 0)) - 1)"
        prefixes.append(f"WHEN {i} THEN {prefix}")
        examples.append(f"WHEN {i} THEN {_q(tx.REDACTED if rule.example is None else rule.example)}")
        ids.append(f"WHEN {i} THEN {_q(rule.id)}")
        descriptions.append(f"WHEN {i} THEN {_q(rule.description)}")
        regexes.append(f"WHEN {i} THEN {_q(rule.regex)}")
    by_rule = lambda parts: "CASE rule_ord " + " ".join(parts) + " END"
    return f"""WITH t AS ({texts}),
 m AS (SELECT *, CASE {' '.join(cases)} END AS rule_ord FROM t),
 e AS (SELECT *, {by_rule(secrets)} AS secret, {by_rule(prefixes)} AS prefix, {by_rule(examples)} AS example,
  {by_rule(ids)} AS rule_id, {by_rule(descriptions)} AS rule_description, {by_rule(regexes)} AS rule_regex
  FROM m WHERE rule_ord IS NOT NULL),
 s AS (SELECT *, length(prefix)::int AS b, (length(prefix) + length(secret))::int AS n,
  (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::int AS line_number,
  replace(text, secret, example) AS whole FROM e),
 x AS (SELECT *,
  right(prefix, 20) || '<REDACTED>' || substr(text, n + 1, 20) AS sanitized_secret,
  right(prefix, 20) || secret || substr(text, n + 1, 20) AS snippet_text,
  CASE WHEN length(whole) > 10000 OR contains(lower(whole), lower(secret)) THEN
   CASE WHEN example = '' THEN right(prefix, 20) || '<REDACTED>' || substr(text, n + 1, 20)
   ELSE right(prefix, 2000) || example || substr(text, n + 1, 2000) END ELSE whole END AS mocked_secret
  FROM s) """


FINDING_SQL = """SELECT sha256(url || '_' || sanitized_secret) AS id,
 CASE WHEN lower(platform) IN ('github', 'gitlab', 'localfilesystem') THEN url || '#L' || line_number ELSE url END AS url,
 sanitized_secret AS secret, mocked_secret, rule_id, rule_description, platform, field AS ticket_field,
 secret AS sensitive_secret, snippet_text, platform AS o1, issue_id AS o2, field_ord AS o3, item_ord AS o4 FROM x"""
FINDING_COLUMNS = "id, url, secret, mocked_secret, rule_id, rule_description, platform, ticket_field"


def _findings_sql(texts: str = DOC_SQL, rules: ru.RuleSet = RULES) -> str:
    """CTEs up to f, the findings with the first of each id kept."""
    return _matches_sql(texts, rules) + f""", a AS ({FINDING_SQL}),
 f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY o1, o2, o3, o4) = 1) """


PLACES_SQL = """SELECT r_name AS l1, n_name AS l2, c_custkey::varchar AS l3, o_orderkey::varchar AS l4, o_orderpriority
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey"""
RULE_TABLE_SQL = """SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::int AS rule_ord,
 CASE p_brand WHEN 'Brand#1' THEN 'QUOTED-TOKEN' WHEN 'Brand#2' THEN 'ipv4' ELSE p_brand END AS id,
 'Parts of ' || p_brand AS description, p_brand || '(?i)[^0-9]' AS regex, p_brand || ' ' AS example FROM part"""
GIT_SQL = """SELECT upper(lang) AS owner, 'Repo-' || source AS repo, 'https://code.example.com/' || source AS html_url,
 'Group/' || source AS path_with_namespace, doc_id % 50 AS project_id,
 CASE WHEN source < 'src15' THEN 'en' ELSE 'fr' END AS default_branch, lang AS branch, doc_id || '.txt' AS path, text, doc_id
 FROM documents"""


# --- registry ------------------------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__.lstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        _QUERIES[key] = run
        if sql:
            _ORACLES[key] = sql
        return fn

    return register


# sources


@_query(
    """SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest,
 length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))::bigint AS n_chars
 FROM documents WHERE length(text) > 0"""
)
def read_text_files_each(spark, d):
    """A file for each document, written by Spark's tasks with the document's number as its name, in up to 256 folders.

    A folder for each would be listed on its own, which took most of the time. Texts of a number meet packed, for the disk.
    """
    path = scratch_path(spark, "texts")
    docs = _table(spark, d, "documents").select("doc_id", files.pack_texts(F.coalesce("text", F.lit(""))).alias("text"))
    docs = docs.groupBy("doc_id").agg(F.collect_list("text").alias("text"))
    folder = F.pmod(F.hash("doc_id"), F.lit(256)).cast("string")
    name = F.concat(folder, F.lit("/doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    files.write_text_files(docs.select(name.alias("name"), "text"), path, lambda texts: b"".join(files.unpack_text(x) + b"\x00" for x in texts))
    read = files.read_text_files(spark, path, "doc_id=*")
    text = F.substring_index("file", "\x00", 1)
    key = F.regexp_extract("url", "/doc_id=([0-9]+)[.]txt$", 1).cast("bigint")
    return read.select(key.alias("doc_id"), F.sha2(text, 256).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


@_query(
    """SELECT source, lang, sum(length(replace(replace(text || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10))))::bigint
 AS n_chars FROM documents GROUP BY ALL"""
)
def read_text_files(spark, d):
    path = scratch_path(spark, "texts")
    docs = _table(spark, d, "documents").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").text(path)
    read = files.read_text_files(spark, path, "part-*")
    part = lambda key: F.regexp_extract("url", f"{key}=([^/]+)/", 1).alias(key)
    return read.groupBy(part("source"), part("lang")).agg(F.sum(F.length("file")).alias("n_chars"))


@_query(
    """SELECT 'Jira' AS platform, 'DOC-' || doc_id AS issue_id, 'https://jira.example.com/browse/DOC-' || doc_id AS url,
 source AS title, text AS description, doc_id::varchar AS comment_ref FROM documents"""
)
def norm_jira(spark, d):
    doc_id = F.col("doc_id").cast("string")
    issues = _table(spark, d, "documents").select(
        doc_id.alias("id"),
        F.concat(F.lit("DOC-"), doc_id).alias("key"),
        F.concat(F.lit("https://jira.example.com/rest/api/2/issue/"), doc_id).alias("self"),
        F.col("source").alias("summary"),
        F.col("text").alias("description"),
    )
    return trackers.norm_jira(issues)


@_query(
    """SELECT 'Confluence' AS platform, page_id::varchar AS issue_id, 'https://wiki.example.com/x/' || page_id AS url,
 url AS title, html AS description FROM pages WHERE url LIKE 'https%'"""
)
def norm_wiki(spark, d):
    pages = _table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        F.when(F.col("url").startswith("https"), "Page").otherwise("blogpost").alias("type"),
        F.col("url").alias("title"),
        F.concat(F.lit("/x/"), F.col("page_id").cast("string")).alias("webui"),
        F.lit("https://wiki.example.com").alias("base"),
        F.col("html").alias("storage_value"),
    )
    return trackers.norm_wiki(pages)


def _linear_responses(spark, d):
    doc_id = F.col("doc_id").cast("string")
    comment = lambda i, body: F.struct(F.concat(doc_id, F.lit(i)).alias("id"), body.alias("body"))
    node = F.struct(
        doc_id.alias("id"),
        F.concat(F.lit("LIN-"), doc_id).alias("identifier"),
        F.concat(F.lit("https://linear.example.com/"), doc_id).alias("url"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.struct(F.array(comment("a", F.lit("")), comment("b", F.col("lang"))).alias("nodes")).alias("comments"),
    )
    edges = F.array(F.struct(node.alias("node")))
    return _table(spark, d, "documents").select(F.struct(F.struct(edges.alias("edges")).alias("issues")).alias("data"))


@_query(
    """SELECT 'Linear' AS platform, 'LIN-' || doc_id AS issue_id, 'https://linear.example.com/' || doc_id AS url,
 source AS title, text AS description FROM documents"""
)
def norm_linear(spark, d):
    return trackers.norm_linear(_linear_responses(spark, d))


@_query("SELECT 'Linear' AS platform, 'LIN-' || doc_id AS issue_id, 1::bigint AS item_ord, lang AS text FROM documents")
def norm_linear_comments(spark, d):
    return trackers.norm_linear_comments(_linear_responses(spark, d))


@_query(
    """SELECT 'Asana' AS platform, p_partkey::varchar AS issue_id, 'https://asana.example.com/' || p_partkey AS url,
 p_name AS title, p_type AS description FROM part"""
)
def norm_asana(spark, d):
    key = F.col("p_partkey").cast("string")
    tasks = _table(spark, d, "part").select(
        key.alias("gid"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("notes"),
        F.concat(F.lit("https://asana.example.com/"), key).alias("permalink_url"),
    )
    return trackers.norm_asana(tasks)


@_query(
    """SELECT 'Asana' AS platform, l_partkey::varchar AS issue_id, l_orderkey * 10 + l_linenumber AS item_ord,
 l_linestatus AS text FROM lineitem WHERE l_returnflag = 'R'"""
)
def norm_asana_comments(spark, d):
    stories = _table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("task_gid"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "R", "Comment").otherwise("system").alias("type"),
        F.col("l_linestatus").alias("text"),
    )
    return trackers.norm_asana_comments(stories)


@_query(
    """SELECT 'Wrike' AS platform, c_name AS issue_id, 'https://wrike.example.com/' || c_custkey AS url,
 c_mktsegment AS title, c_acctbal::bigint::varchar AS description FROM customer WHERE c_mktsegment <> 'BUILDING'"""
)
def norm_wrike(spark, d):
    tasks = _table(spark, d, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("id"),
        F.col("c_mktsegment").alias("title"),
        F.rint("c_acctbal").cast("bigint").cast("string").alias("description"),
        F.concat(F.lit("https://wrike.example.com/"), F.col("c_custkey").cast("string")).alias("permalink"),
    )
    return trackers.norm_wrike(tasks)


@_query(
    """SELECT 'Zendesk' AS platform, o_orderkey::varchar AS issue_id,
 'https://acme.zendesk.com/agent/tickets/' || o_orderkey AS url, o_orderpriority AS title, o_orderstatus AS description
 FROM orders"""
)
def norm_zendesk(spark, d):
    return trackers.norm_zendesk(_zendesk_tickets(spark, d), server="acme")


def _zendesk_tickets(spark, d):
    return _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_orderstatus").alias("description"),
        F.concat(F.lit("https://zendesk.example.com/api/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


def _chat_messages(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    channel = F.concat(F.lit("C"), F.col("user_id").cast("string"))
    return _table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("iid"),
        F.col("props").alias("text"),
        F.concat(F.lit("https://chat.example.com/archives/"), channel, F.lit("/p"), micros).alias("permalink"),
        F.col("ts").alias("posted"),
        micros.alias("ts"),
        F.col("event_type").alias("type"),
        F.struct(
            channel.alias("id"), F.col("event_type").alias("name"), (F.col("value") > 10).alias("is_channel")
        ).alias("channel"),
    )


CHAT_LINK = "'https://chat.example.com/archives/C' || user_id || '/p' || epoch_us(ts)"


def _turns(spark, d, issue, text):
    """Turns of conversations as the comments of a platform's export."""
    turns = _table(spark, d, "conversations")
    return turns.select(F.col("conv_id").alias(issue), F.col("turn").alias("ord"), F.col("text").alias(text))


def _turns_sql(platform: str) -> str:
    return f"SELECT '{platform}' AS platform, conv_id::varchar AS issue_id, turn AS item_ord, text FROM conversations"


@_query(_turns_sql("Jira"))
def norm_jira_comments(spark, d):
    return trackers.norm_jira_comments(_turns(spark, d, "issue_id", "body"))


@_query(_turns_sql("Confluence"))
def norm_wiki_comments(spark, d):
    return trackers.norm_wiki_comments(_turns(spark, d, "page_id", "storage_value"))


@_query(_turns_sql("Wrike"))
def norm_wrike_comments(spark, d):
    return trackers.norm_wrike_comments(_turns(spark, d, "task_id", "text"))


@_query(_turns_sql("Zendesk"))
def norm_zendesk_comments(spark, d):
    return trackers.norm_zendesk_comments(_turns(spark, d, "ticket_id", "body"))


@_query(
    f"""SELECT 'Slack' AS platform, {CHAT_LINK} AS issue_id, {CHAT_LINK} AS url, props AS message,
 event_id::varchar AS iid, event_type AS channel_name, 'C' || user_id AS channel_id, value > 10 AS is_channel,
 epoch_us(ts)::varchar AS timestamp, event_type AS slack_type FROM events"""
)
def norm_chat(spark, d):
    tickets = trackers.norm_chat(_chat_messages(spark, d))
    return tickets.select("platform", "issue_id", "url", "message", "raw_data.*")


@_query(
    f"""SELECT 'GitHub' AS platform, html_url || '/blob/' || branch || '/' || path AS issue_id,
 html_url || '/blob/' || branch || '/' || path AS url, replace(text, chr(65533), '') AS file FROM ({GIT_SQL})"""
)
def norm_github(spark, d):
    return files.norm_github(_git_files(spark, d))


@_query(
    f"""SELECT 'GitHub' AS platform, html_url || '/blob/' || branch || '/' || path AS issue_id,
 html_url || '/blob/' || branch || '/' || path AS url, replace(text, ' ', chr(65533)) AS file FROM ({GIT_SQL})"""
)
def norm_github_replacement(spark, d):
    """Texts that hold genuine replacement characters besides bytes that are not UTF-8."""
    marked = F.concat(F.replace("text", F.lit(" "), F.lit("\ufffd")).cast("binary"), F.unhex(F.lit("FF")))
    docs = _table(spark, d, "documents").select("doc_id", marked.alias("content"))
    return files.norm_github(_git_files(spark, d).drop("content").join(docs, "doc_id"))


@_query(
    f"""SELECT 'GitLab' AS platform, html_url || '/-/blob/' || branch || '/' || path AS issue_id,
 html_url || '/-/blob/' || branch || '/' || path AS url, text || chr(65533) AS file FROM ({GIT_SQL})"""
)
def norm_gitlab(spark, d):
    return files.norm_gitlab(_git_files(spark, d))


@_query(
    f"""SELECT t.issue_id, t.url, c.item_ord, c.text AS comment
 FROM ({CONV_TICKETS_SQL}) t LEFT JOIN ({CONV_COMMENTS_SQL}) c USING (issue_id)"""
)
def attach_comments(spark, d):
    both = fl.attach_comments(_conv_tickets(spark, d), _conv_comments(spark, d))
    return both.select("issue_id", "url", "item_ord", "comment")


@_query(
    f"""SELECT 'GitHub' AS platform, html_url || '/blob/' || branch || '/' || path AS issue_id, length(replace(text, chr(65533), ''))::bigint AS n
 FROM ({GIT_SQL}) UNION ALL SELECT 'Zendesk', o_orderkey::varchar, length(o_orderstatus)::bigint FROM orders
 UNION ALL SELECT 'Slack', {CHAT_LINK}, length(props)::bigint FROM events""",
    name="union_sources",
)
def union_of_sources(spark, d):
    content = union_sources(
        spark,
        {
            "github_scan": _git_files(spark, d),
            "zendesk": _zendesk_tickets(spark, d),
            "slack": _chat_messages(spark, d),
            "nowhere": _table(spark, d, "region"),
        },
    )
    text = F.coalesce("file", "description", "message")
    return content.select("platform", "issue_id", F.length(text).cast("bigint").alias("n"))


# flattening and filters


@_query(f"SELECT issue_id, url, field, field_ord, item_ord, text FROM ({CONV_SQL})")
def flatten_fields(spark, d):
    texts = fl.flatten_fields(_conv_tickets(spark, d), _conv_comments(spark, d))
    return texts.drop("platform")


@_query(f"SELECT issue_id, field, text FROM ({CONV_SQL}) WHERE field <> 'comments'")
def skip_comments(spark, d):
    comments = fl.skip_comments(_conv_comments(spark, d), True)
    return fl.flatten_fields(_conv_tickets(spark, d), comments).select("issue_id", "field", "text")


@_query(f"SELECT issue_id, field, text FROM ({CONV_SQL}) WHERE NOT contains(lower(text), lower('{LABEL}'))")
def drop_labelled_text(spark, d):
    texts = fl.flatten_fields(_conv_tickets(spark, d), _conv_comments(spark, d))
    return fl.drop_labelled_text(texts, LABEL).select("issue_id", "field", "text")


@_query(
    f"""SELECT issue_id, issue_id IN (SELECT issue_id FROM ({CONV_COMMENTS_SQL}) WHERE contains(lower(text), lower('{LABEL}')))
 AS already_warned FROM ({CONV_TICKETS_SQL})"""
)
def flag_already_warned(spark, d):
    flagged = fl.flag_already_warned(_conv_tickets(spark, d), _conv_comments(spark, d), LABEL)
    return flagged.select("issue_id", "already_warned")


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 2000")
def scope_filter(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return sc.scope_filter(docs, "query: lang = 'en' AND n_chars > 2000")


@_query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def scope_filter_or_all(spark, d):
    return sc.scope_filter_or_all(_table(spark, d, "documents").select("doc_id", "lang"), "search: lang = 'en'")


@_query("SELECT doc_id, lang FROM documents")
def scope_filter_or_all_miss(spark, d):
    return sc.scope_filter_or_all(_table(spark, d, "documents").select("doc_id", "lang"), "cql: lang = 'xx'")


@_query(f"SELECT doc_id, owner, repo FROM ({GIT_SQL}) WHERE lower(owner) = 'en' AND lower(repo) = 'repo-src1'")
def owner_repo_filter(spark, d):
    rows = _git_files(spark, d).select("doc_id", "owner", "repo")
    return sc.owner_repo_filter(rows, "En", "REPO-SRC1")


@_query(
    f"""SELECT doc_id, path_with_namespace, project_id FROM ({GIT_SQL})
 WHERE lower(path_with_namespace) = 'group/src3'"""
)
def owner_repo_filter_project(spark, d):
    rows = _git_files(spark, d).select("doc_id", "path_with_namespace", "project_id")
    return sc.owner_repo_filter(rows, "GROUP", "Src3")


@_query(f"SELECT doc_id, branch FROM ({GIT_SQL}) WHERE branch IN ('en', 'fr')")
def branch_filter(spark, d):
    return sc.branch_filter(_git_files(spark, d), "en,fr, de").select("doc_id", "branch")


@_query(f"SELECT doc_id, branch FROM ({GIT_SQL}) WHERE branch = default_branch")
def branch_filter_default(spark, d):
    return sc.branch_filter(_git_files(spark, d), "Default").select("doc_id", "branch")


@_query(
    "SELECT event_id, ts FROM events WHERE ts::date > DATE '2024-01-10' AND ts::date < DATE '2024-01-20'"
)
def time_window_filter(spark, d):
    return sc.time_window_filter(_table(spark, d, "events").select("event_id", "ts"), "2024-01-10", "2024-01-20")


@_query(
    """WITH RECURSIVE d AS (SELECT ts::date AS day, count(*) AS c FROM events GROUP BY 1),
 w AS (SELECT 0::bigint AS window_id, DATE '2024-02-09' AS start_day, DATE '2024-02-11' AS end_day, 0::bigint AS used,
  1::bigint AS width, (SELECT coalesce(sum(c), 0) FROM d WHERE day > DATE '2024-02-09' AND day < DATE '2024-02-11')::bigint AS n
 UNION ALL SELECT window_id + 1, (start_day - next::int)::date, start_day + 1, used + next, next,
  (SELECT coalesce(sum(c), 0) FROM d WHERE day > v.start_day - v.next::int AND day < v.start_day + 1)::bigint
  FROM (SELECT *, CASE WHEN n > 0 THEN 1 ELSE width * 2 END::bigint AS next FROM w) v WHERE used + next < 36500)
 SELECT window_id, start_day, end_day, n FROM w"""
)
def day_windows(spark, d):
    return sc.day_windows(_table(spark, d, "events"), "2024-02-10")


@_query(
    """SELECT event_id, 'C' || user_id AS channel_id,
 substr(epoch_us(ts)::varchar, 1, 10) || '.' || substr(epoch_us(ts)::varchar, 11) AS thread_ts FROM events"""
)
def parse_message_link(spark, d):
    link = tx.parse_message_link(F.col("permalink"))
    return _chat_messages(spark, d).select(
        F.col("iid").cast("bigint").alias("event_id"), link["channel_id"].alias("channel_id"), link["thread_ts"].alias("thread_ts")
    )


# rules as data


@_query(
    f"""SELECT row_number() OVER (ORDER BY rule_ord) - 1 AS rule_ord, id, regex, example, true AS live
 FROM ({RULE_TABLE_SQL})"""
)
def load_rules(spark, d):
    path = scratch_path(spark, "rules") + ".parquet"
    _rule_table(spark, d).write.parquet(path)
    table = ru.load_rules(spark, path).to_df(spark)
    return table.select(F.col("rule_ord").cast("bigint").alias("rule_ord"), "id", "regex", "example", "live")


def _hoist_sql() -> str:
    sql = "SELECT p_partkey, p_name || '(?i)' || p_type || '(?s)' || p_brand AS r FROM part"
    for flag in rx.MODIFIERS:
        sql = f"""SELECT p_partkey, CASE WHEN strpos(r, '{flag}') > 1 THEN '{flag}' || replace(r, '{flag}', '') ELSE r END AS r
 FROM ({sql})"""
    return f"SELECT p_partkey, r AS regex FROM ({sql})"


@_query(_hoist_sql())
def hoist_inline_flags(spark, d):
    raw = F.concat("p_name", F.lit("(?i)"), "p_type", F.lit("(?s)"), "p_brand")
    return _table(spark, d, "part").select("p_partkey", rx.hoist_inline_flags(raw).alias("regex"))


PART_RULES_SQL = """SELECT 'part-' || p_partkey AS rule_id,
 CASE WHEN p_size < 5 THEN '' WHEN p_type = 'PROMO' THEN '(' ELSE '(?i)^' || split_part(p_name, ' ', 1) || ' [a-z]+$' END AS regex,
 CASE WHEN p_size > 40 THEN p_brand ELSE upper(p_name) END AS example FROM part"""


@_query(
    f"""SELECT rule_id, CASE WHEN regex = '' THEN 'missing' WHEN regex = '(' THEN 'invalid'
 WHEN regexp_matches(example, CASE WHEN regex = '(' THEN 'x' ELSE regex END) THEN 'ok' ELSE 'mismatch' END AS status
 FROM ({PART_RULES_SQL})"""
)
def validate_rules(spark, d):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    rules = _table(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") < 5, "")
        .when(F.col("p_type") == "PROMO", "(")
        .otherwise(F.concat(F.lit("(?i)^"), first, F.lit(" [a-z]+$")))
        .alias("regex"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.upper("p_name")).alias("example"),
    )
    return ru.validate_rules(rules).select("rule_id", "status")


# the scan


@_query(_matches_sql() + "SELECT url, rule_ord IS NOT NULL AS has_leak FROM m")
def has_leak(spark, d):
    return mt.has_leak(_doc_texts(spark, d), RULES).select("url", "has_leak")


@_query(_matches_sql() + "SELECT url, rule_ord, rule_id FROM x")
def first_match_rule(spark, d):
    found = mt.first_match_rule(_doc_texts(spark, d), RULES)
    return found.select("url", "rule_ord", F.col("_rule.id").alias("rule_id"))


@_query(
    f"""SELECT 'doc/' || doc_id AS url FROM documents WHERE regexp_matches(text, {_q(IPV4)})
 AND NOT regexp_matches(text, '&&&') AND NOT regexp_matches(text, '(?i)license')"""
)
def allowlist_suppress(spark, d):
    only = ru.RuleSet(tuple(r for r in RULES.rules if r.id == "ipv4"))
    return mt.first_match_rule(_doc_texts(spark, d), only).select("url")


@_query(_matches_sql() + "SELECT url, secret FROM x")
def extract_secret(spark, d):
    return mt.extract_secret(mt.match_span(mt.first_match_rule(_doc_texts(spark, d), RULES))).select("url", "secret")


@_query(_matches_sql() + 'SELECT url, b AS "begin", n AS "end" FROM x')
def match_span(spark, d):
    return mt.match_span(mt.first_match_rule(_doc_texts(spark, d), RULES)).select("url", "begin", "end")


@_query(_matches_sql() + "SELECT url, line_number FROM x")
def line_number(spark, d):
    return _matches(spark, d).select("url", "line_number")


@_query(_matches_sql() + "SELECT url, sanitized_secret FROM x")
def redact_window(spark, d):
    return _matches(spark, d).select("url", "sanitized_secret")


@_query(_matches_sql() + "SELECT url, snippet_text FROM x")
def snippet_window(spark, d):
    return _matches(spark, d).select("url", "snippet_text")


@_query(_matches_sql() + "SELECT url, mocked_secret FROM x")
def mock_secret(spark, d):
    return _matches(spark, d).select("url", "mocked_secret")


SCAN_COLUMNS = "platform, issue_id, url, field, rule_ord, rule_id, secret, line_number, sanitized_secret, snippet_text, mocked_secret"


@_query(_matches_sql() + f'SELECT {SCAN_COLUMNS}, b AS "begin", n AS "end" FROM x')
def scan_texts(spark, d):
    return _matches(spark, d).select(*SCAN_COLUMNS.split(", "), "begin", "end")


FILE_RULES = ru.RuleSet.from_dict(
    {
        "rules": [
            {"id": "phone-88", "regex": r"\([0-9]{3}\) [0-9]{3}-[0-9]{2}88", "example": "(555) 555-0100"},
            {"id": "ipv4", "regex": IPV4, "example": "192.0.2.1", "allowlists": [{"regexes": [r"\([0-9]{3}\) [0-9]{3}-[0-9]{2}77"]}]},
            {"id": "quoted-token", "regex": 'token = "[0-9a-f]{40}"', "example": 'token = "made-up"'},
        ]
    }
)
FILE_SQL = """SELECT source AS url, replace(replace(string_agg(text || chr(10), '' ORDER BY doc_id), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
 FROM documents GROUP BY source"""


@_query(
    _matches_sql(FILE_SQL, FILE_RULES)
    + 'SELECT url, rule_id, secret, line_number, b::bigint AS "begin", n::bigint AS "end", sanitized_secret, snippet_text FROM x'
)
def scan_large_files(spark, d):
    """A file for each source, those above 64 KB read in pieces of 32 KB by many tasks."""
    path = scratch_path(spark, "large")
    docs = _table(spark, d, "documents").select("source", "doc_id", "text")
    rows = docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text")
    rows.write.partitionBy("source").text(path)
    found = scan_files(spark, path, FILE_RULES, pattern="part-*", whole=64 << 10, size=32 << 10)
    url = F.regexp_extract("url", "source=([^/]+)/", 1)
    return found.select(url.alias("url"), "rule_id", "secret", "line_number", "begin", "end", "sanitized_secret", "snippet_text")


MASKED_SQL = "text"
for _rule in RULES.rules:
    MASKED_SQL = f"regexp_replace({MASKED_SQL}, {_q(_re2(_rule.regex))}, {_q(tx.REDACTED)}, 'g')"


@_query(f"SELECT doc_id, sha256({MASKED_SQL}) AS masked_sha256, length({MASKED_SQL})::bigint AS n_chars FROM documents")
def mask_secrets(spark, d):
    """All documents with every match of every rule replaced."""
    masked = mk.mask_secrets(_table(spark, d, "documents").select("doc_id", "text"), RULES)
    return masked.select("doc_id", F.sha2("masked_text", 256).alias("masked_sha256"), F.length("masked_text").cast("bigint").alias("n_chars"))


OLD_RULES = ru.RuleSet((RULES.rules[0], ru.Rule("email", "nobody@nowhere[.]invalid"), *RULES.rules[2:]))


def _scanned_twice(spark, d) -> tuple[DataFrame, lg.Ledger]:
    """All documents, first with another second rule, then with the rules."""
    ledger, texts = lg.Ledger(scratch_path(spark, "ledger")), _doc_texts(spark, d)
    lg.scan_new(texts, OLD_RULES, ledger, run="1")
    return lg.scan_new(texts, RULES, ledger, run="2"), ledger


@_query(_matches_sql() + f'SELECT {SCAN_COLUMNS}, b AS "begin", n AS "end" FROM x')
def scan_again(spark, d):
    """The second scan of a ledger finds what a scan of everything does."""
    return _scanned_twice(spark, d)[0].select(*SCAN_COLUMNS.split(", "), "begin", "end")


@_query(
    f"""SELECT CASE WHEN regexp_matches(text, {_q(RULES.rules[0].regex)}) THEN 0 ELSE 1 END AS tried, count(DISTINCT text) AS n
 FROM documents WHERE text <> '' GROUP BY ALL"""
)
def scan_again_work(spark, d):
    """How many rules the second scan tries on each text: the changed one, where the rule before it does not accept the text."""
    ledger = _scanned_twice(spark, d)[1]
    return ledger.answers(spark).where("run = '2'").groupBy("tried").agg(F.count(F.lit(1)).alias("n"))


EVERYTHING_SQL = f"""{DOC_SQL} UNION ALL SELECT 'Confluence', page_id::varchar, url, 'description', 1, 0::bigint, html FROM pages
 WHERE html <> '' UNION ALL {CONV_SQL}"""


CATALOGUE = default_rules()
TOLD_SQL = (
    f"SELECT * REPLACE (text || ' ' || ([{', '.join(_q(r.example) for r in CATALOGUE.rules)}])"
    f"[item_ord % {len(CATALOGUE)} + 1] AS text) FROM (SELECT * REPLACE (doc_id AS item_ord) FROM"
    " (SELECT *, split_part(url, '/', 2)::bigint AS doc_id FROM (" + DOC_SQL + "))) "
)


def _everything(spark, d):
    pages = _table(spark, d, "pages").select(
        F.lit("Confluence").alias("platform"),
        F.col("page_id").cast("string").alias("issue_id"),
        "url",
        F.col("html").alias("description"),
    )
    texts = _doc_texts(spark, d).unionByName(fl.flatten_fields(pages))
    return texts.unionByName(fl.flatten_fields(_conv_tickets(spark, d), _conv_comments(spark, d)))


@_query(
    _matches_sql(EVERYTHING_SQL, CATALOGUE, by_text=True)
    + "SELECT url, field, item_ord, rule_id, secret, line_number, sanitized_secret, mocked_secret FROM x"
)
def scan_catalogue(spark, d):
    found = mt.scan_texts(_everything(spark, d), CATALOGUE)
    return found.select(
        "url", "field", "item_ord", "rule_id", "secret", "line_number", "sanitized_secret", "mocked_secret"
    )


@_query(_matches_sql(TOLD_SQL, CATALOGUE, by_text=True) + "SELECT url, rule_id, secret, line_number, sanitized_secret FROM x")
def scan_catalogue_tokens(spark, d):
    """Each document with a token of one of the rules, in turn: every rule is found."""
    number = F.split_part("url", F.lit("/"), F.lit(2)).cast("bigint")
    told = F.element_at(F.lit([r.example for r in CATALOGUE.rules]), (number % len(CATALOGUE) + 1).cast("int"))
    texts = _doc_texts(spark, d).withColumn("text", F.concat("text", F.lit(" "), told))
    return mt.scan_texts(texts, CATALOGUE).select("url", "rule_id", "secret", "line_number", "sanitized_secret")


# opt-in rule fields


def _keyword_accept(i: int, test: str) -> str:
    words = RULES.rules[i].keywords
    any_word = " OR ".join(f"contains(lower(text), {_q(w.lower())})" for w in words)
    return f"({any_word}) AND {test}" if words else test


@_query(_matches_sql(accept=_keyword_accept) + "SELECT url, rule_id FROM x")
def keyword_prefilter(spark, d):
    return _matches(spark, d, MatchOptions(keyword_prefilter=True)).select("url", "rule_id")


ENTROPY_SQL = """, c AS (SELECT url, rule_id, secret, unnest(string_split(secret, '')) AS ch FROM x),
 h AS (SELECT url, rule_id, ch, count(*) AS k FROM c GROUP BY ALL),
 g AS (SELECT url, rule_id, sum(k) AS total FROM h GROUP BY ALL),
 bits AS (SELECT url, rule_id, round(-sum((k / total) * log2(k / total)), 6) AS entropy FROM h JOIN g USING (url, rule_id) GROUP BY ALL) """


@_query(
    _matches_sql()
    + ENTROPY_SQL
    + """SELECT url, rule_id, entropy FROM bits
 WHERE entropy >= CASE rule_id WHEN 'quoted-token' THEN 4.0 WHEN 'email' THEN 3.6 WHEN 'ipv4' THEN 2.9 ELSE 0 END"""
)
def entropy_filter(spark, d):
    kept = _matches(spark, d, MatchOptions(entropy_filter=True))
    return kept.select("url", "rule_id", F.round(tx.shannon_entropy(F.col("secret")), 6).alias("entropy"))


@_query(
    _matches_sql(accept=lambda i, test: f"regexp_matches(url, '[02468]$') AND {test}" if i == 0 else test)
    + "SELECT url, rule_id FROM x"
)
def path_filter(spark, d):
    return _matches(spark, d, MatchOptions(path_filter=True)).select("url", "rule_id")


@_query(_matches_sql(f"SELECT * FROM ({DOC_SQL}) WHERE NOT regexp_matches(url, 'doc/[0-9]*7$')") + "SELECT url, rule_id FROM x")
def global_path_exclude(spark, d):
    return _matches(spark, d, MatchOptions(global_path_exclude=True)).select("url", "rule_id")


@_query(
    _matches_sql(accept=lambda i, test: f"{test} AND NOT regexp_matches(url, '[13]$')" if i == 1 else test)
    + "SELECT url, rule_id FROM x"
)
def allowlist_paths(spark, d):
    return _matches(spark, d, MatchOptions(allowlist_paths=True)).select("url", "rule_id")


@_query(_matches_sql() + "SELECT url, rule_id FROM x WHERE NOT regexp_matches(secret, '^[0-9.]+[02468]$')")
def global_regex_allowlist(spark, d):
    return _matches(spark, d, MatchOptions(global_regex_allowlist=True)).select("url", "rule_id")


@_query(
    _matches_sql(
        accept=lambda i, test: f"{test} AND NOT contains(regexp_extract(text, {_q(IPV4)}, 0), '19')" if i == 2 else test
    )
    + "SELECT url, rule_id FROM x WHERE NOT contains(lower(secret), 'mail2') AND NOT contains(lower(secret), '99')"
)
def stopword_filter(spark, d):
    return _matches(spark, d, MatchOptions(stopword_filter=True)).select("url", "rule_id")


def _target_accept(i: int, test: str) -> str:
    if i != 1:
        return test
    first = f"regexp_extract(text, {_q(EMAIL)}, 0)"
    prefix = f"regexp_extract(text, {_q('(?s:^(.*?))(?:' + EMAIL + ')')}, 1)"
    line = f"split_part(text, chr(10), length({prefix}) - length(replace({prefix}, chr(10), '')) + 1)"
    return (
        f"regexp_matches(text, {_q(EMAIL)}) AND NOT regexp_matches({first}, 'mail[13]\\.example')"
        f" AND NOT regexp_matches({line}, 'the the the')"
    )


@_query(_matches_sql(accept=_target_accept) + "SELECT url, rule_id FROM x")
def regex_target(spark, d):
    return _matches(spark, d, MatchOptions(regex_target=True)).select("url", "rule_id")


@_query(
    """SELECT 'doc/' || doc_id AS url, regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS secret,
 right(regexp_extract(text, '(?s:^(.*?))token = "[0-9a-f]{40}"', 1) || 'token = "', 20) || '<REDACTED>' ||
 substr(text, length(regexp_extract(text, '(?s:^(.*?))token = "[0-9a-f]{40}"', 1)) + 50, 20) AS sanitized_secret
 FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')"""
)
def secret_group(spark, d):
    found = mt.scan_texts(_doc_texts(spark, d), GROUP_RULES, MatchOptions(secret_group=True))
    return found.select("url", "secret", "sanitized_secret")


# findings


@_query(
    """SELECT 'doc/' || doc_id AS url, regexp_extract(text, '([0-9]|[a-f])+ereda|(?:[a-z]+,?[ \\n])+of\\.') AS secret FROM documents
 WHERE regexp_matches(text, '([0-9]|[a-f])+ereda|(?:[a-z]+,?[ \\n])+of\\.')"""
)
def deep_patterns(spark, d):
    """A pattern whose groups repeat without bound, which the JVM's engine would nest on long texts."""
    rules = ru.RuleSet.from_dict({"rules": [{"id": "deep", "regex": r"([0-9]|[a-f])+ereda|(?:[a-z]+,?[ \n])+of\."}]})
    return mt.scan_texts(_doc_texts(spark, d), rules).select("url", "secret")


@_query(
    _matches_sql(f"SELECT platform, CASE WHEN url NOT LIKE '%7' THEN url END AS url, text FROM ({DOC_SQL})")
    + "SELECT rule_id, coalesce(url, '') AS url, sha256(coalesce(url, '') || '_' || sanitized_secret) AS id FROM x"
)
def finding_id_null_url(spark, d):
    texts = _doc_texts(spark, d).withColumn("url", F.when(~F.col("url").endswith("7"), F.col("url")))
    return fi.build_findings(mt.scan_texts(texts, RULES)).select("rule_id", F.regexp_replace("url", "#L[0-9]+$", "").alias("url"), "id")


REPEATED_SQL = "'(?s:^(.*?))([a-z]*on (?:[a-z]* )?[a-z]*)on[ ,.]'"


@_query(
    f"""SELECT url, 'on' AS secret, right(p, 20) || '<REDACTED>' || substr(text, length(p) + 3, 20) AS sanitized_secret
 FROM (SELECT 'doc/' || doc_id AS url, text, regexp_extract(text, {REPEATED_SQL}, 1) || regexp_extract(text, {REPEATED_SQL}, 2) AS p
 FROM documents WHERE regexp_matches(text, '[a-z]*on (?:[a-z]* )?[a-z]*on[ ,.]'))"""
)
def secret_group_repeated(spark, d):
    """The group's text also stands earlier in the match."""
    rules = ru.RuleSet.from_dict({"rules": [{"id": "on", "regex": "[a-z]*on (?:[a-z]* )?[a-z]*(on)[ ,.]", "secretGroup": 1}]})
    found = mt.scan_texts(_doc_texts(spark, d), rules, MatchOptions(secret_group=True))
    return found.select("url", "secret", "sanitized_secret")


@_query(_matches_sql() + "SELECT url, sha256(url || '_' || sanitized_secret) AS id FROM x")
def finding_id(spark, d):
    return fi.finding_id(_matches(spark, d)).select("url", "id")


@_query(_matches_sql() + "SELECT issue_id, url || '#L' || line_number AS url, url AS plain FROM x")
def source_url(spark, d):
    m = _matches(spark, d)
    url = fi.source_url(F.col("url"), F.col("platform"), F.col("line_number"))
    plain = fi.source_url(F.col("url"), F.lit("Jira"), F.col("line_number"))
    return m.select("issue_id", url.alias("url"), plain.alias("plain"))


@_query(_matches_sql() + "SELECT url, sanitized_secret AS hidden, snippet_text AS shown FROM x")
def reported_secret(spark, d):
    return _matches(spark, d).select(
        "url", fi.reported_secret().alias("hidden"), fi.reported_secret(True).alias("shown")
    )


@_query(_matches_sql() + f", a AS ({FINDING_SQL}) SELECT {FINDING_COLUMNS} FROM a")
def build_findings(spark, d):
    return fi.build_findings(_matches(spark, d)).drop("seq")


@_query(_findings_sql(SOURCE_SQL) + f"SELECT {FINDING_COLUMNS} FROM f")
def dedup_findings(spark, d):
    return fi.dedup_findings(fi.build_findings(mt.scan_texts(_source_texts(spark, d), RULES)))


@_query(_findings_sql(SOURCE_SQL) + f"SELECT {FINDING_COLUMNS}, sensitive_secret FROM f")
def sensitive_findings(spark, d):
    return fi.sensitive_findings(mt.scan_texts(_source_texts(spark, d), RULES))


@_query(
    _findings_sql(f"{DOC_SQL} UNION ALL {SOURCE_SQL}")
    + "SELECT coalesce(platform, 'all') AS platform, count(*) AS n FROM f GROUP BY ROLLUP (platform)"
)
def consolidate_platforms(spark, d):
    other = fi.dedup_findings(fi.build_findings(mt.scan_texts(_source_texts(spark, d), RULES)))
    return fi.consolidate_platforms([_findings(spark, d), other])


@_query(_findings_sql() + "SELECT rule_id, platform, count(*) AS n FROM f GROUP BY ALL")
def count_findings(spark, d):
    return fi.count_findings(_findings(spark, d), "rule_id", "platform")


@_query(
    _findings_sql()
    + """SELECT f.id, CASE WHEN rule_id = 'email' THEN 'checked e-mail' ELSE rule_description END AS rule_description,
 CASE rule_id WHEN 'email' THEN 'live' WHEN 'phone' THEN 'unable to test' END AS status FROM f"""
)
def apply_verdicts(spark, d):
    found = materialise(_findings(spark, d), "findings")  # the verdicts below come from the same scan
    status = F.when(F.col("rule_id") == "email", "live").otherwise("unable to test")
    verdicts = found.where(F.col("rule_id").isin("email", "phone")).select(
        "id", status.alias("status"), F.when(F.col("rule_id") == "email", "checked e-mail").alias("rule_description")
    )
    return fi.apply_verdicts(found, verdicts).select("id", "rule_description", "status")


@_query(
    _findings_sql()
    + """SELECT f.id, CASE rule_id WHEN 'email' THEN 'live' WHEN 'phone' THEN 'unable to test' END AS status FROM f"""
)
def apply_verdicts_at(spark, d):
    """Three verdicts for each finding; the second is the latest at the time asked for."""
    found = materialise(_findings(spark, d), "findings")
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    status = F.when(F.col("rule_id") == "email", "live").otherwise("unable to test")
    verdicts = found.where(F.col("rule_id").isin("email", "phone")).select("id", status.alias("status"), k.alias("k"))
    verdicts = verdicts.select(
        "id", F.when(F.col("k") == 2, F.col("status")).otherwise("invalid").alias("status"), F.concat(F.lit("2024-0"), F.col("k"), F.lit("-01")).cast("timestamp").alias("at")
    )
    return fi.apply_verdicts_at(found, verdicts, "2024-02-20").select("id", "status")


def _event_verdicts(spark, d):
    """Errors stand in for verdicts on a user, other events for findings."""
    events = _table(spark, d, "events").withColumn("id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).otherwise(0).cast("string"))
    verdicts = events.where("event_type = 'error'").select(
        "id", F.col("ts").alias("at"), F.col("props").alias("status"), (F.col("ts") + F.expr("make_dt_interval(cast(event_id % 9 as int))")).alias("seen")
    )
    return events.where("event_type <> 'error'").select("event_id", "id", "ts"), verdicts


EVENT_VERDICTS = """f AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id ELSE 0 END::varchar AS id, ts FROM events WHERE event_type <> 'error'),
 v AS (SELECT CASE WHEN user_id % 3 > 0 THEN user_id ELSE 0 END::varchar AS id, ts AS moment, props AS status, ts + to_days((event_id % 9)::int) AS seen
  FROM events WHERE event_type = 'error')"""


@_query(
    f"""WITH {EVENT_VERDICTS}, u AS (SELECT id, moment, max(status) AS status FROM v GROUP BY ALL)
SELECT event_id, f.id, ts, status FROM f ASOF LEFT JOIN u ON f.id = u.id AND f.ts >= u.moment"""
)
def verdicts_as_of(spark, d):
    """The verdict that held at each finding's time; a third of all findings and verdicts share an id."""
    found, verdicts = _event_verdicts(spark, d)
    return fi.verdicts_as_of(found, verdicts.drop("seen"))


@_query(
    f"""WITH {EVENT_VERDICTS}, u AS (SELECT id, moment, max(status) AS status FROM v GROUP BY ALL),
 o AS (SELECT id, moment, max(status) AS status FROM v WHERE seen <= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT n.event_id, n.id, n.ts, n.status FROM (SELECT event_id, f.id, ts, status FROM f ASOF LEFT JOIN u ON f.id = u.id AND f.ts >= u.moment) n
 JOIN (SELECT event_id, status FROM f ASOF LEFT JOIN o ON f.id = o.id AND f.ts >= o.moment) p USING (event_id)
WHERE n.status IS DISTINCT FROM p.status"""
)
def late_verdicts(spark, d):
    """Findings of which verdicts that came in after a day say otherwise."""
    found, verdicts = _event_verdicts(spark, d)
    return fi.late_verdicts(found, verdicts, "2024-01-20")


@_query(_findings_sql(CONV_SQL, WORD_RULES) + f"SELECT {FINDING_COLUMNS} FROM f")
def scan_tickets(spark, d):
    return fi.dedup_findings(fi.build_findings(_conv_matches(spark, d)))


# reports and outbox


@_query(_findings_sql() + "SELECT id, rule_id, url, secret, platform, ticket_field FROM f")
def report_json(spark, d):
    path = rp.report_json(_findings(spark, d), RULES.to_df(spark), scratch_path(spark, "report"))
    lines = spark.read.text(path).where("value rlike '^,?\"[0-9a-f]{64}\":'")
    body = F.regexp_replace("value", '^,?"[0-9a-f]{64}":', "")
    shape = (
        "id string, url string, secret string, details struct<"
        "matched_regex_config:struct<id:string>,platform:string,ticket_field:string>"
    )
    f = lines.select(F.from_json(body, shape).alias("f"))
    return f.select(
        "f.id",
        F.col("f.details.matched_regex_config.id").alias("rule_id"),
        "f.url",
        "f.secret",
        "f.details.platform",
        "f.details.ticket_field",
    )


@_query(
    _findings_sql()
    + f""", r AS ({RULE_TABLE_SQL}) SELECT id, description AS name, description AS full_description, 'note' AS level FROM r
 UNION ALL SELECT rule_id, 'Secret Leak - ' || rule_id, rule_id, 'note' FROM f WHERE rule_id NOT IN (SELECT id FROM r)"""
)
def sarif_rules(spark, d):
    rows = rp.sarif_rules(_rule_table(spark, d), _findings(spark, d))
    return rows.select("id", "name", "full_description", "level")


@_query(
    _findings_sql()
    + f""", r AS ({RULE_TABLE_SQL}) SELECT f.id, f.rule_id,
 coalesce((SELECT min(r.rule_ord) + 1 FROM r WHERE lower(r.id) = lower(f.rule_id)), -1)::bigint AS rule_index FROM f"""
)
def sarif_rule_index(spark, d):
    return rp.sarif_rule_index(_findings(spark, d), _rule_table(spark, d)).select("id", "rule_id", "rule_index")


SARIF_MESSAGE = """'Potential Secret Leak on [' || platform || '](' || url || ').' || chr(10) || 'Details:' || chr(10)
 || 'Sensitive data type: [' || rule_id || '] - Description: [' || rule_description || ']' || chr(10) || 'Platform: [' || platform
 || '] - Field: [ticket ' || ticket_field || ']' || chr(10) || 'Source: ' || url || chr(10)
 || '000000000000000 Sensitive data found (redacted) 000000000000000' || chr(10) || secret || chr(10)
 || '000000000000000 Sensitive data found (redacted) 000000000000000' || chr(10)
 || 'Please verify the [' || platform || ' ticket](' || url || ') and conduct a thorough search for any sensitive data. '
 || 'If a data leak is confirmed, proceed to rotate the data and eliminate any sensitive information from the ticket.'"""


@_query(
    _findings_sql()
    + f"""SELECT rule_id, CASE rule_id {' '.join(f"WHEN '{r.id}' THEN {i + 1}" for i, r in enumerate(RULES.rules))} END::bigint AS rule_index,
 replace({SARIF_MESSAGE}, '<REDACTED>', 'xxxxxxxxxxxx') AS message, 'note' AS level, id AS uri, 'ROOTPATH' AS uri_base_id,
 url AS location_message FROM f"""
)
def sarif_results(spark, d):
    return rp.sarif_results(_findings(spark, d), RULES.to_df(spark))


@_query(
    _findings_sql(f"{DOC_SQL} UNION ALL {SOURCE_SQL}")
    + "SELECT CASE platform WHEN 'LocalFilesystem' THEN 0 ELSE 1 END AS run, id AS uri FROM f"
)
def sarif_append_runs(spark, d):
    first, second = scratch_path(spark, "sarif"), scratch_path(spark, "sarif")
    other = fi.dedup_findings(fi.build_findings(mt.scan_texts(_source_texts(spark, d), RULES)))
    rules = RULES.to_df(spark)
    rp.sarif_append_runs(_findings(spark, d), rules, first)
    rp.sarif_append_runs(other, rules, second, old_path=first)
    rows = spark.read.parquet(f"{second}/rows").where("section = 3")
    uri = F.get_json_object("json", "$.locations[0].physicalLocation.artifactLocation.uri")
    return rows.select("run", uri.alias("uri"))


GITLAB_SQL = """SELECT id, name || chr(10) || 'Sensitive data type: [' || rule_id || '] - Sensitive data description: ['
 || rule_description || '] - Platform: [' || platform || '] - Field: [ticket ' || ticket_field || '] - Source: ' || url AS description,
 ticket_field || ' field on ' || platform AS discovered_at, '[' || hidden || ']' AS sanitized_secret,
 'Potential leaked secret (sanitized): [' || hidden || ']' AS evidence_summary, url, rule_description AS identifier_name,
 rule_id AS identifier_value, platform || ' ' || ticket_field AS link_name, name, 'Info' AS severity,
 chr(10) || 'Please verify the ' || platform || ' ticket and conduct a thorough search for any sensitive data. '
 || 'If a data leak is confirmed, proceed to rotate the data and eliminate any sensitive information from the ticket. Ticket URL: '
 || url AS solution
 FROM (SELECT *, 'Potential Secret Leak on ' || platform || ' ' || ticket_field || '.' AS name,
 replace(secret, '<REDACTED>', 'xxxxxxxxxxxx') AS hidden FROM f)"""


@_query(_findings_sql() + GITLAB_SQL)
def gitlab_vulns(spark, d):
    return rp.gitlab_vulns(_findings(spark, d))


@_query(_findings_sql() + f"SELECT id, description, url FROM ({GITLAB_SQL})")
def gitlab_report(spark, d):
    path = rp.gitlab_report(_findings(spark, d), scratch_path(spark, "gitlab"))
    lines = spark.read.text(path).where("value rlike '^,?\\\\{\"id\":'")
    body = F.regexp_replace("value", "^,", "")
    shape = "id string, description string, location struct<hostname:string>"
    v = lines.select(F.from_json(body, shape).alias("v"))
    return v.select("v.id", "v.description", F.col("v.location.hostname").alias("url"))


INFO_SQL = """'Platform:[' || platform || '] Field:[' || field || '] ID:[' || rule_id || '] Description:[' || rule_description
 || '] Regex: ' || rule_regex || chr(10) || '############## Sanitized Secret Leak ##############' || chr(10) || ' '
 || sanitized_secret || chr(10) || '############## Sanitized Secret Leak ##############'"""
COMMENT_SQL = f"""'Hi leaksieve bot: ' || {INFO_SQL} || ' <&>' || chr(10) || 'secret_manager: a secret manager tool' || chr(10)
 || 'contact_help: your security team' || chr(10) || 'label: bot#1'"""


@_query(_matches_sql() + f"SELECT url, {COMMENT_SQL} AS comment FROM x")
def compose_comment(spark, d):
    return cm.compose_comment(_matches(spark, d), POSTING).select("url", "comment")


OUTBOX_SQL = (
    _matches_sql(CONV_SQL, WORD_RULES)
    + f""", o AS (SELECT issue_id, url, {COMMENT_SQL} AS comment FROM x WHERE issue_id NOT IN
 (SELECT issue_id FROM ({CONV_COMMENTS_SQL}) WHERE contains(lower(text), lower('{LABEL}')))) """
)


@_query(OUTBOX_SQL + "SELECT issue_id, url, comment FROM o")
def comment_outbox(spark, d):
    rows = cm.comment_outbox(_conv_matches(spark, d), _conv_tickets(spark, d), _conv_comments(spark, d), POSTING)
    return rows.drop("platform")


NO_HASH = "replace(comment, '#', '0')"
HTML = (
    f"replace(replace(replace(replace(replace({NO_HASH}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
)


@_query(
    OUTBOX_SQL
    + f""", p AS (SELECT unnest(['Jira', 'Confluence', 'Wrike', 'Linear', 'Asana', 'Zendesk']) AS platform)
 SELECT platform, issue_id, comment, CASE platform WHEN 'Jira' THEN {NO_HASH} WHEN 'Confluence' THEN {HTML}
 WHEN 'Wrike' THEN replace(replace(comment, '<REDACTED>', '**********'), chr(10), '<br>')
 WHEN 'Linear' THEN replace(comment, chr(10), '\\n') ELSE comment END AS payload FROM o, p"""
)
def encode_comment(spark, d):
    rows = cm.comment_outbox(_conv_matches(spark, d), _conv_tickets(spark, d), _conv_comments(spark, d), POSTING)
    names = ["Jira", "Confluence", "Wrike", "Linear", "Asana", "Zendesk", "Slack", "GitHub"]
    everywhere = rows.withColumn("platform", F.explode(F.lit(names)))
    encoded = cm.encode_comment(everywhere, jira_cloud=False)
    return encoded.select("platform", "issue_id", "comment", "payload")


CHAT_NOTE_SQL = f"""SELECT 'Slack' AS platform, {CHAT_LINK} AS issue_id, 'C' || user_id AS channel_id,
 substr(epoch_us(ts)::varchar, 1, 10) || '.' || substr(epoch_us(ts)::varchar, 11) AS thread_ts, event_type AS comment FROM events"""


@_query(
    f"""SELECT platform, issue_id, comment, comment AS payload, channel_id, thread_ts FROM ({CHAT_NOTE_SQL})
 UNION ALL SELECT 'Jira', event_id::varchar, event_type,
 '{{"body":{{"type":"doc","version":1,"content":[{{"type":"paragraph","content":[{{"type":"text","text":"' || event_type || '"}}]}}]}}}}',
 '', '' FROM events"""
)
def encode_comment_threads(spark, d):
    """Chat threads by their links, and Jira's cloud format."""
    chat = trackers.norm_chat(_chat_messages(spark, d)).select("platform", "issue_id", "url", F.col("raw_data.slack_type").alias("comment"))
    jira = _table(spark, d, "events").select(
        F.lit("Jira").alias("platform"), F.col("event_id").cast("string").alias("issue_id"), F.lit("").alias("url"), F.col("event_type").alias("comment")
    )
    encoded = cm.encode_comment(chat.unionByName(jira), jira_cloud=True)
    return encoded.select("platform", "issue_id", "comment", "payload", "channel_id", "thread_ts")


# scope maps


@_query(f"SELECT DISTINCT 'Asana' AS platform, l1, l2, l3, NULL::varchar AS l4 FROM ({PLACES_SQL})")
def scope_map(spark, d):
    return sc.scope_map(_places(spark, d), "Asana", ["l1", "l2", "l3", "l4"], 3)


PATHS_SQL = "SELECT string_split(lang || '/' || source || '/' || doc_id || '.txt', '/') AS p FROM documents"


@_query(
    f"""SELECT directory, depth, sum(own)::bigint AS n_files FROM (
 SELECT p[1] AS directory, 0 AS depth, 0 AS own FROM ({PATHS_SQL})
 UNION ALL SELECT p[1] || '/' || p[2], 1, 1 FROM ({PATHS_SQL})) GROUP BY ALL"""
)
def scope_map_files(spark, d):
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return sc.file_tree_map(_table(spark, d, "documents").select(path.alias("path")))


@_query(f"SELECT DISTINCT 'Asana' AS platform, l1, l2, l3, l4 FROM ({PLACES_SQL})")
def map_file(spark, d):
    """A map written as nested documents, each with a part of one region, and read back."""
    path = scratch_path(spark, "map")
    maps.write_map_documents(sc.scope_map(_places(spark, d), "Asana", ["l1", "l2", "l3", "l4"]), path, "asana")
    return maps.read_map(spark, path, "asana", lines=True)


DEEP_PATH = "concat_ws('/', lang, source, CAST(doc_id % 7 AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN 'even/' || CAST(doc_id % 3 AS VARCHAR(20)) END, doc_id || '.txt')"
NODES_SQL = f"""SELECT DISTINCT array_to_string(p[1:i], '/') AS path, p[i] AS name, CASE WHEN i = len(p) THEN 'file' ELSE 'directory' END AS kind,
 (i - 1)::int AS depth, false AS empty FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM
 (SELECT string_split({DEEP_PATH}, '/') AS p FROM documents))"""


def _deep_files(spark, d):
    return _table(spark, d, "documents").select("doc_id", "lang", "source", F.expr(DEEP_PATH).alias("path"))


def _tree_map(spark, files: DataFrame, levels: int = -1) -> DataFrame:
    """A file tree's map, written and read back."""
    return maps.read_tree_map(spark, maps.write_tree_map(files, scratch_path(spark, "tree"), levels))


@_query(NODES_SQL)
def tree_map_file(spark, d):
    """The tree of all documents' paths as nested documents, read back."""
    return _tree_map(spark, _deep_files(spark, d))


@_query(
    f"""SELECT path, name, kind, depth, (depth = 2 AND kind = 'directory') AS empty FROM ({NODES_SQL}) WHERE depth <= 2"""
)
def tree_map_levels(spark, d):
    """The same tree to a depth, where directories are listed without what they hold."""
    return _tree_map(spark, _deep_files(spark, d), 2)


@_query(
    f"""SELECT doc_id, {DEEP_PATH} AS path FROM documents
 WHERE (lang = 'en' AND source <> 'src1') OR (lang = 'fr' AND doc_id % 7 < 3) OR (lang NOT IN ('en', 'fr') AND doc_id % 10 = 0)"""
)
def scope_tree(spark, d):
    """Directories of two depths listed without children, and single files."""
    files = _deep_files(spark, d)
    sources = _tree_map(spark, files.where("lang = 'en' AND source <> 'src1'"), 1)
    numbers = _tree_map(spark, files.where("lang = 'fr' AND doc_id % 7 < 3"), 2)
    single = _tree_map(spark, files.where("lang NOT IN ('en', 'fr') AND doc_id % 10 = 0"))
    listed = sources.unionByName(numbers).unionByName(single)
    return tr.tree_scope_join(files.select("doc_id", "path"), listed)


def _scope(spark, d):
    """All of one region, one nation of another, and the large orders of a third."""
    places = _places(spark, d)
    none = F.lit(None).cast("string")
    region = places.where("l1 = 'ASIA'").select("l1", none.alias("l2"), none.alias("l3"))
    nation = places.where("l1 = 'EUROPE' AND l2 > 'NATION_2'").select("l1", "l2", none.alias("l3"))
    customers = places.where("l1 = 'AFRICA' AND o_orderpriority = '1-URGENT'").select("l1", "l2", "l3")
    return region.unionByName(nation).unionByName(customers).distinct()


@_query(
    _findings_sql(
        f"""SELECT * FROM ({CONV_SQL})
 WHERE url IN (SELECT 'conv/' || conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0)""", WORD_RULES
    )
    + "SELECT rule_id, url, secret FROM f"
)
def scan_scoped(spark, d):
    """A scan that a predicate limits: comments outside it are never searched."""
    issues = _conv_tickets(spark, d).select(
        F.col("issue_id").alias("key"), F.col("issue_id").alias("id"), F.concat(F.lit("https://j/rest/api/"), "issue_id").alias("self"),
        F.col("title").alias("summary"), "description",
    )
    notes = _conv_comments(spark, d).select("issue_id", F.col("item_ord").alias("ord"), F.col("text").alias("body"))
    options = ScanOptions(scope="query: cast(key as int) % 3 = 0", config_label="no such label")
    found = scan_platform(spark, "jira_scan", WORD_RULES, options, issues, notes).findings
    return found.select("rule_id", F.regexp_replace("url", ".*/", "conv/").alias("url"), "secret")


SCOPED_SQL = f"""SELECT l1, l2, l3, l4 FROM ({PLACES_SQL}) p WHERE l1 = 'ASIA' OR (l1 = 'EUROPE' AND l2 > 'NATION_2')
 OR (l1 = 'AFRICA' AND l3 IN (SELECT l3 FROM ({PLACES_SQL}) WHERE l1 = 'AFRICA' AND o_orderpriority = '1-URGENT'))"""


@_query(SCOPED_SQL)
def scope_semi_join(spark, d):
    content = _places(spark, d).select("l1", "l2", "l3", "l4")
    return sc.scope_semi_join(content, _scope(spark, d), ["l1", "l2", "l3"])


@_query(
    f"""SELECT l1, l2, l3, l4 FROM ({PLACES_SQL})
 WHERE ('0x' || substr(md5(l1 || '/' || l2 || '/' || l3 || '/' || l4), 1, 8))::bigint % 3 = 1"""
)
def scope_chunk(spark, d):
    content = _places(spark, d).select("l1", "l2", "l3", "l4")
    return sc.scope_chunk(content, 2, 3, ["l1", "l2", "l3", "l4"])


@_query(
    f"""WITH r AS (SELECT l3, l4, ('0x' || substr(md5(k), 1, 8))::bigint % 4096 AS b, length(k) + 1 AS s
 FROM (SELECT l3, l4, coalesce(l3, chr(0)) || '/' || coalesce(l4, chr(0)) AS k FROM
 (SELECT CASE WHEN l1 <> 'ASIA' THEN l3 END AS l3, l4 FROM ({PLACES_SQL})))),
 z AS (SELECT b, sum(s) AS s FROM r GROUP BY b),
 p AS (SELECT b, floor((sum(s) OVER (ORDER BY b) - s) * 3 / sum(s) OVER ())::int + 1 AS part FROM z)
 SELECT l3, l4, part FROM r JOIN p USING (b)"""
)
def scope_chunk_balanced(spark, d):
    places = _places(spark, d).select(F.when(F.col("l1") != "ASIA", F.col("l3")).alias("l3"), "l4")
    parts = [sc.scope_chunk_balanced(places, i, 3, ["l3", "l4"]).withColumn("part", F.lit(i)) for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PARTS_SQL = f"""SELECT l3, l4, floor((sum(s) OVER (ORDER BY l3 NULLS FIRST, l4) - s) * 3 / sum(s) OVER ())::int + 1 AS part FROM
 (SELECT l3, l4, length(coalesce(l3, '')) + length(l4) + 2 AS s FROM (SELECT CASE WHEN l1 <> 'ASIA' THEN l3 END AS l3, l4 FROM ({PLACES_SQL})))"""


@_query(PARTS_SQL)
def scope_chunk_contiguous(spark, d):
    """Parts that follow the order of the containers; a fifth of the map lies in one of them."""
    places = _places(spark, d).select(F.when(F.col("l1") != "ASIA", F.col("l3")).alias("l3"), "l4")
    return sc.scope_parts_contiguous(places, 3, ["l3", "l4"])


# streams


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it a file or a folder of them. A stream takes a file's own path for a folder, but not a pattern."""
    schema = _table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _stream_texts(spark, d):
    """Documents as a stream; the id stands in for seconds of event time."""
    docs = _table_stream(spark, d, "documents")
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return docs.select(
        F.lit("LocalFilesystem").alias("platform"),
        url.alias("issue_id"),
        url.alias("url"),
        F.lit("file").alias("field"),
        F.timestamp_seconds(F.col("doc_id") + F.lit(1_700_000_000)).alias("ts"),
        "text",
    )


def _run_stream(spark, frame: DataFrame, mode: str = "append") -> DataFrame:
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    query = (
        frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
        .option("path", out).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@_query(_matches_sql() + "SELECT url, rule_id, secret, line_number, mocked_secret FROM x")
def scan_stream(spark, d):
    matches = st.scan_stream(_stream_texts(spark, d), RULES)
    return _run_stream(spark, matches.select("url", "rule_id", "secret", "line_number", "mocked_secret"))


@_query(
    _matches_sql(f"SELECT platform, 'one place' AS url, text FROM ({DOC_SQL})")
    + "SELECT DISTINCT sha256(url || '_' || sanitized_secret) AS id FROM x"
)
def stream_dedup(spark, d):
    texts = _stream_texts(spark, d).withColumn("url", F.lit("one place"))
    found = st.stream_findings(st.scan_stream(texts, RULES))
    return _run_stream(spark, st.stream_dedup(found, "3650 days").select("id"))


@_query(
    _matches_sql(f"SELECT platform, issue_id, 'one place' AS url, text FROM ({DOC_SQL})")
    + """SELECT sha256(url || '_' || sanitized_secret) AS id, min(issue_id) AS first_issue, arg_min(rule_id, issue_id) AS rule_id,
 arg_min(line_number, issue_id) AS line_number FROM x WHERE issue_id <> 'doc/' || (SELECT max(doc_id) FROM documents) GROUP BY ALL"""
)
def stream_earliest(spark, d):
    """The earliest finding of each id in scan order, from a stream; the last document comes much later and ends the wait."""
    last = _table(spark, d, "documents").agg(F.max("doc_id")).first()[0]
    later = F.when(F.col("url") == f"doc/{last}", F.col("ts") + F.expr("interval 30 days")).otherwise(F.col("ts"))
    texts = _stream_texts(spark, d).withColumn("ts", later).withColumn("url", F.lit("one place")).withWatermark("ts", "10 days")
    matches = st.scan_stream(texts, RULES).withColumn("field_ord", F.lit(0)).withColumn("item_ord", F.lit(0).cast("bigint"))
    found = st.stream_findings(matches, keep_seq=True).withColumn("first_issue", F.col("seq.issue_id"))
    found = found.select("id", "rule_id", "first_issue", F.regexp_extract("url", "#L([0-9]+)$", 1).cast("int").alias("line_number"), "ts", "seq")
    before = spark.conf.get(ft.STORE, None)
    spark.conf.set(ft.STORE, ft.ROCKS)
    try:
        return _run_stream(spark, ft.stream_earliest(found, "10 days", watermark=False).select("id", "first_issue", "rule_id", "line_number"))
    finally:
        spark.conf.set(ft.STORE, before) if before else spark.conf.unset(ft.STORE)


EVENT_RULES = ru.RuleSet.from_dict(
    {"rules": [{"id": "sixties", "regex": '"k": 6[0-9]'}, {"id": "sevens", "regex": '"k": [0-9]*7'}]}
)


RATE_SQL = """SELECT date_trunc('hour', ts) AS window_start, CASE WHEN regexp_matches(props, '"k": 6[0-9]') THEN 'sixties' ELSE 'sevens' END
 AS rule_id, count(*) AS n FROM events WHERE regexp_matches(props, '"k": (6[0-9]|[0-9]*7)') GROUP BY ALL"""


@_query(RATE_SQL)
def leak_rate(spark, d):
    texts = trackers.norm_chat(_chat_messages(spark, d)).select(
        "platform", "issue_id", "url", F.lit("message").alias("field"), F.col("message").alias("text"),
        F.timestamp_micros(F.col("raw_data.timestamp").cast("bigint")).alias("ts"),
    )
    return st.stream_leak_rate(st.stream_findings(st.scan_stream(texts, EVENT_RULES)))


@_query(
    f"""SELECT window_start, rule_id, n FROM ({RATE_SQL}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds',
 max(ts)) - INTERVAL 1 DAY FROM events WHERE regexp_matches(props, '"k": (6[0-9]|[0-9]*7)'))"""
)
def stream_leak_rate(spark, d):
    """The windows that a stream closes; those within a day of the last event stay open."""
    events = _table_stream(spark, d, "events")
    key = F.col("event_id").cast("string")
    texts = events.select(
        F.lit("Slack").alias("platform"), key.alias("issue_id"), key.alias("url"), F.lit("message").alias("field"),
        F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("ts"),
    )
    rates = st.stream_leak_rate(st.stream_findings(st.scan_stream(texts, EVENT_RULES)), delay="1 day")
    return _run_stream(spark, rates)


def entry(spark: SparkSession) -> DataFrame:
    """Findings in all documents, each id once."""
    return _QUERIES["dedup_findings"](spark, SMOKE_DIR)


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data package; empty where that package is not installed."""
    try:
        import corpus_pipeline
        from leaksieve.llm import queries as training
    except ImportError:  # the package, or a library that it alone needs
        return {}, {}
    oracles = dict(training.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**training.QUERIES, "pipeline": corpus_pipeline.run}, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_training_data()[1]}
