"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leaksieve.llm import (
    alignment,
    chatformat,
    decontaminate,
    htmltext,
    jaccard,
    langid,
    lines,
    modest_batches,
    packing,
    quality,
    repair,
    repeats,
    secrets,
    sharding,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify_documents(_table(spark, d, "documents"))


def op3_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, d, "pages"))


def op4_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, d, "documents"))


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge_documents(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_report(_table(spark, d, "documents"), lines.WHOLE)


def op7_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, d, "documents"))


def op8_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), TOKENIZER)


def op9_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.link_report(_table(spark, d, "documents"))


def op10_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, d, "documents"))


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, d, "documents"), *ALIGNED)


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_digest(_table(spark, d, "conversations"))


def op13_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    return chatformat.format_digest(chatformat.with_probe(_table(spark, d, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scans": op10_secret_scans,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_chat_formatting": op13_chat_formatting,
}
# A-Z alone, as the queries fold case
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH cut AS (
  SELECT * FROM (
    SELECT false AS test, row_number() OVER () AS r, doc_id AS k,
           regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
    UNION ALL
    SELECT true, row_number() OVER (), item_id,
           regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark)),
wins AS (
  SELECT DISTINCT k AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM cut WHERE test AND len(w) > 0)),
found AS (
  SELECT d.r, d.i, x.n, x.item
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM cut, (SELECT DISTINCT n FROM wins) WHERE NOT test AND len(w) >= n)) d
  JOIN wins x USING (win, n)),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
names AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT r, cast(item AS VARCHAR) AS item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT cut.k AS doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM cut LEFT JOIN hits USING (r) LEFT JOIN names USING (r) WHERE NOT test"""

OP9 = rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cut WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
pair AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM gram x JOIN gram y USING (g) WHERE x.r <> y.r GROUP BY 1, 2) p
  JOIN size s ON s.r = a JOIN size t ON t.r = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT r AS a, r AS b FROM cut UNION SELECT reach.a, pair.b FROM reach JOIN pair ON pair.a = reach.b)
SELECT any_value(me.doc_id) AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other.doc_id) AS component_id
FROM reach JOIN cut me ON me.r = reach.a JOIN cut other ON other.r = reach.b LEFT JOIN size ON size.r = reach.a GROUP BY reach.a"""


def _op10() -> str:
    kinds = []
    for number, rule in enumerate(secrets.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        kinds.append(
            f"SELECT r, t, {number} AS k, '{rule.kind}' AS kind, {rule.shortest} AS least,"
            f" regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {rule.group}) AS parts,"
            f" regexp_split_to_array(t, {pattern}) AS gaps FROM cut"
        )
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{rule.kind}" for n, rule in enumerate(secrets.BASE))
    zero = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secrets.BASE)
    return f"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
hit AS (
  SELECT r, k, kind, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
span AS (
  SELECT r, k, kind, cast(b AS BIGINT) AS b, cast(b + length(hits[i]) AS BIGINT) AS e
  FROM (SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b FROM hit)
  WHERE length(parts[i]) >= least),
listed AS (
  SELECT r, {counts}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < {len(secrets.BASE)}) AS base
  FROM span GROUP BY r)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM cut LEFT JOIN listed USING (r)"""


def _op13() -> str:
    def length(column: str, number: int) -> str:
        cases = " ".join(f"WHEN '{role}' THEN {len(marks[number])}" for role, marks in chatformat.MARKS.items())
        other = len(chatformat.END_ROLE) if number else f"{len(chatformat.ROLE + chatformat.TEXT)} + length({escaped('role')})"
        return f"CASE {column} {cases} ELSE {other} END"

    def escaped(column: str) -> str:
        return rf"regexp_replace({column}, '{chatformat.ESCAPE}', '\1\2\\\3', 'g')"

    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH cut AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
told AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM cut
  WINDOW w AS (PARTITION BY conv_id {order}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(length({escaped("text")})
                + CASE WHEN before = role THEN {len(chatformat.NEXT)} ELSE {length("role", 0)} END
                + CASE WHEN after = role THEN 0 ELSE {length("role", 1)} END) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id"""


# The other queries depend on hashes, learned models, tokenizers, page shapes or whole-text searches that
# SQL cannot say or not finish: tests compare them with brute-force versions.
ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op9_jaccard_join": OP9,
    "op10_secret_scans": _op10(),
    "op13_chat_formatting": _op13(),
}
