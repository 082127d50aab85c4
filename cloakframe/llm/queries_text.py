"""Queries opN over single documents and conversations, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.llm.chat_format import format_conversations, loss_text, read_turns
from cloakframe.llm.license_scan import ENDS, RULES, known, rewritten, scan_licenses
from cloakframe.llm.line_rules import BOILERPLATE, NAVIGATION, clean_lines
from cloakframe.llm.registry import query, table

SPACE = r"[\x20\x09-\x0D]+"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP1_SQL = rf"""
WITH s AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '{ENDS}', chr(10), 'g'), chr(10)),
                                lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS list FROM documents),
named AS (SELECT doc_id, list_filter(list, lambda x: x <> '') AS list FROM s),
found AS (SELECT doc_id, list_filter(list_transform(list, lambda s, i: {{'id': {known('s')}, 'place': i}}), lambda x: x.id IS NOT NULL) AS found FROM named),
seq AS (SELECT doc_id, list_transform(found, lambda x: x.id) AS sentence_ids,
          array_to_string(list_transform(found, lambda x, i: CASE WHEN i > 1 AND x.place - found[i - 1].place > 6 THEN '~' ELSE '' END || '<' || x.id || '>'), '') AS sequence FROM found),
rest AS (SELECT doc_id, sentence_ids, {rewritten('sequence')} AS rest FROM seq)
SELECT doc_id, sentence_ids,
       list_transform(regexp_extract_all(rest, '\[(\d+)\]', 1), lambda k: {sql_list([n for n, _ in RULES])}[CAST(k AS INT) + 1]) AS licenses,
       CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched
FROM rest"""


@query("op1_license_scan", OP1_SQL)
def license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last_role,
                  replace(replace(text, '\', '\\'), '<', '<\') AS body, replace(replace(role, '\', '\\'), '<', '<\') AS head FROM clean)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN last_role = role THEN 6 ELSE 20 + length(head) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


@query("op4_chat_format", OP4_SQL)
def chat_format(spark, sf_dir):
    """All conversations, and conversation -7 whose texts look like the control strings of a template."""
    odd = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"),
                 F.lit(r"\### Assistant: </turn> ok").alias("text")) for turn, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    formatted = format_conversations(rows)
    read = formatted.select("conv_id", "formatted", read_turns("formatted").alias("turns"), loss_text("formatted", "loss_spans").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_sql() -> str:
    words = f"list_filter(regexp_split_to_array(%s, '{SPACE}'), lambda w: w <> '')"
    line_words = words % "l"
    marks = "length(l) - length(regexp_replace(l, '[|»]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {words % 'text'} AS words FROM d),
base AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM w),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle
        FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS t(i)),
again AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, shingle) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM again GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
judged AS (
  SELECT doc_id, l, len({line_words}) AS n,
    (regexp_matches(l, '{NAVIGATION}') OR ({marks} >= 2 AND 3 * ({marks}) >= len({line_words}))
     OR 4 * (length(l) - length(regexp_replace(l, '(?i){BOILERPLATE}', '', 'g'))) >= length(l)
     OR 2 * len(regexp_extract_all(l, '[#*$%&!<>]+')) > len({line_words})
     OR (len({line_words}) >= 30 AND NOT regexp_matches(l, '[.!?:;,"…)\]]'))) AS fails
  FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
per AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS lost_words FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND 2 * coalesce(lost_words, 0) <= n_words AS kept,
       CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)"""


@query("op9_quality_rules", op9_sql())
def quality_rules(spark, sf_dir):
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")
