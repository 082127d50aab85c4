"""Customer tables: headers, redaction, vault, risk tiers, letters, prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions import rules as R
from cloakframe.operators import letters as letter_ops
from cloakframe.operators import replies as M
from cloakframe.operators import tables as T
from cloakframe.operators.restore import restore_text
from cloakframe.plans.checksql import fill_sql, lit, mask_sql, spaced, trim_sql
from cloakframe.plans.registry import plan
from cloakframe.sources.portfolio import fill_missing
from cloakframe.sources.synthetic import portfolio_sql, synth_portfolio
from cloakframe.sources.views import load

PORTFOLIO = ["portfolio"]
HEADERS = {
    "customer_name": "Customer Name", "qid": "QID", "iban": "IBAN", "segment": "Product",
    "monthly_salary": "Monthly Salary (QAR)", "outstanding_loan": "Outstanding Loan (QAR)",
    "days_past_due": "Days Past Due",
}
COLUMNS = list(HEADERS)
INSTRUCTION = "Draft a payment reminder for overdue customers"


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "portfolio")


def vault_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = portfolio(spark, sf_dir)
    return rows, T.table_vault(rows, "row_ord", HEADERS)


LABELS = " ".join(f"WHEN {lit(k)} THEN {lit(label)}" for k, label, _w in c.HEADER_RULES)
VAULT = f"""cells AS (
  SELECT row_ord, 0 AS col_ord, 'NAME' AS type, customer_name AS value FROM portfolio
  UNION ALL SELECT row_ord, 1, 'QID', qid FROM portfolio UNION ALL SELECT row_ord, 2, 'IBAN', iban FROM portfolio),
vault AS MATERIALIZED (
  SELECT concat('[', type, '_', idx, ']') AS placeholder, type, CASE type {LABELS} END AS label, value, {mask_sql()} AS masked, idx, first_row, first_col
  FROM (SELECT type, value, first_row, first_col, row_number() OVER (PARTITION BY type ORDER BY first_row, first_col) AS idx
        FROM (SELECT type, value, min(row_ord) AS first_row, min(col_ord) AS first_col FROM cells WHERE value <> '' GROUP BY type, value))),
redacted AS MATERIALIZED (
  SELECT p.row_ord, n.placeholder AS customer_name, q.placeholder AS qid, i.placeholder AS iban, p.segment, p.monthly_salary, p.outstanding_loan, p.days_past_due
  FROM portfolio p JOIN vault n ON n.type = 'NAME' AND n.value = p.customer_name
  JOIN vault q ON q.type = 'QID' AND q.value = p.qid JOIN vault i ON i.type = 'IBAN' AND i.value = p.iban)"""
NUM = lambda col: f"CASE WHEN {col} = floor({col}) THEN CAST(CAST({col} AS BIGINT) AS VARCHAR) ELSE CAST({col} AS VARCHAR) END"
LINE = f"concat_ws(',', customer_name, qid, iban, segment, {NUM('monthly_salary')}, {NUM('outstanding_loan')}, CAST(days_past_due AS VARCHAR))"
RATED = """rated AS MATERIALIZED (
  SELECT *, CASE WHEN days_past_due >= 90 OR dti >= 0.6 THEN 'High risk' WHEN days_past_due >= 30 OR dti >= 0.35 THEN 'Medium risk' ELSE 'Low risk' END AS tier
  FROM (SELECT *, CASE WHEN monthly_salary > 0 THEN outstanding_loan / (monthly_salary * 12) WHEN outstanding_loan > 0 THEN 99 ELSE 0 END AS dti FROM portfolio))"""
RANK = "CASE tier WHEN 'High risk' THEN 0 WHEN 'Medium risk' THEN 1 WHEN 'Low risk' THEN 2 ELSE 9 END"
TIER_RULE = "CASE tier " + " ".join(f"WHEN {lit(t)} THEN {lit(rule)}" for t, _r, rule in c.TIER_RULES) + " END"
BY_NAME = f"""by_name AS (
  SELECT customer_name, max({RANK}) AS rank FROM rated GROUP BY customer_name),
named AS (SELECT customer_name, rank, CASE rank WHEN 0 THEN 'High risk' WHEN 1 THEN 'Medium risk' ELSE 'Low risk' END AS tier FROM by_name)"""


@plan("scan_portfolio", spaced(PORTFOLIO, [], "SELECT row_ord, customer_name, CASE WHEN row_ord % 7 = 0 THEN '' ELSE qid END AS qid, segment FROM portfolio"))
def scan_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = portfolio(spark, sf_dir).select(
        "row_ord", "customer_name", F.when(F.col("row_ord") % 7 != 0, F.col("qid")).alias("qid"), "segment"
    )
    return fill_missing(holes)


@plan("synth_portfolio", portfolio_sql("customer", "c_custkey"))
def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_portfolio(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


HEADER_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(h, {lit(w)})" for w in words) + f" THEN {lit(kind)}" for kind, _l, words in c.HEADER_RULES
)


@plan(
    "classify_headers",
    spaced(["headers"], [], f"""SELECT file_id, ord, type, CASE type {LABELS} END AS label
FROM (SELECT file_id, ord, CASE WHEN h = '' THEN NULL {HEADER_CASE} END AS type FROM (SELECT *, lower({trim_sql('header')}) AS h FROM headers))"""),
)
def classify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = load(spark, sf_dir, "headers").withColumn("type", R.header_type(F.col("header")))
    return kinds.select("file_id", "ord", "type", R.type_label(F.col("type")).alias("label"))


def _hint_sql(figure: str) -> str:
    hits = " OR ".join(f"contains(lower({trim_sql('header')}), {lit(w)})" for w in c.FINANCE_HINTS[figure])
    return f"arg_min(header, ord) FILTER ({hits}) AS {figure}"


@plan("finance_columns", spaced(["headers"], [], f"SELECT file_id, {', '.join(map(_hint_sql, c.FINANCE_HINTS))} FROM headers GROUP BY file_id"))
def finance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = R.header_key(F.col("header"))
    first = [
        F.min_by("header", F.when(R.contains_any(key, hints), F.col("ord"))).alias(figure)
        for figure, hints in c.FINANCE_HINTS.items()
    ]
    return load(spark, sf_dir, "headers").groupBy("file_id").agg(*first)


@plan("redact_table", spaced(PORTFOLIO, [VAULT], "SELECT * FROM redacted"))
def redact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vault = vault_of(spark, sf_dir)
    return T.redact_table(rows, "row_ord", vault, HEADERS)


@plan("table_vault", spaced(PORTFOLIO, [VAULT], "SELECT placeholder, type, label, masked, sha256(value) AS value_digest FROM vault"))
def table_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    _rows, vault = vault_of(spark, sf_dir)
    return vault.select("placeholder", "type", "label", "masked", F.sha2("value", 256).alias("value_digest"))


@plan("protected_by_type", spaced(PORTFOLIO, [VAULT], 'SELECT type, label, count(*) AS "count", arg_min(masked, idx) AS sample FROM vault GROUP BY type, label'))
def protected_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summarise_vault(vault_of(spark, sf_dir)[1])


@plan("protected_total", spaced(PORTFOLIO, [VAULT], "SELECT count(*) AS protected FROM vault"))
def protected_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.identity_cells(portfolio(spark, sf_dir), "row_ord", HEADERS)
    return cells.select("type", "value").distinct().agg(F.count("*").alias("protected"))


@plan(
    "restore_table",
    spaced(PORTFOLIO, [], "SELECT row_ord, concat('Dear ', customer_name, ', your account ', iban, ' (', qid, ') is due.') AS restored FROM portfolio"),
)
def restore_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portfolio(spark, sf_dir)
    vault = T.stored_vault(rows, "row_ord", HEADERS)
    redacted = T.redact_table(rows, "row_ord", vault, HEADERS)
    texts = redacted.select(
        "row_ord", F.format_string("Dear %s, your account %s (%s) is due.", "customer_name", "iban", "qid").alias("text")
    )
    entries = vault.select(F.struct("first_row", "first_col").alias("ord"), "placeholder", "value")
    return restore_text(texts, ["row_ord"], [], "text", entries, "restored", nested=True).select("row_ord", "restored")


@plan("render_csv_lines", spaced(PORTFOLIO, [VAULT], f"SELECT row_ord, {LINE} AS line FROM redacted"))
def render_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vault = vault_of(spark, sf_dir)
    redacted = T.redact_table(rows, "row_ord", vault, HEADERS)
    return redacted.select("row_ord", T.csv_lines(redacted, COLUMNS).alias("line"))


@plan(
    "csv_quoting",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n]') THEN concat('"', replace(text, '"', '""'), '"') ELSE text END AS cell FROM documents""",
)
def csv_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", R.csv_cell(F.col("text")).alias("cell"))


@plan("redacted_preview", spaced(PORTFOLIO, [VAULT], f"SELECT row_ord, {LINE} AS line FROM redacted ORDER BY row_ord LIMIT {c.PREVIEW_ROWS}"))
def redacted_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_csv_lines(spark, sf_dir).orderBy("row_ord").limit(c.PREVIEW_ROWS)


@plan(
    "to_number",
    """SELECT c_custkey, CASE WHEN regexp_matches(k, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN coalesce(TRY_CAST(k AS DOUBLE), 0) ELSE 0 END AS number
FROM (SELECT c_custkey, regexp_replace(CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'QAR 12,500' || c_custkey WHEN 1 THEN '1-' || c_custkey WHEN 2 THEN ''
  WHEN 3 THEN '(' || c_custkey || ')' WHEN 4 THEN c_custkey || '.' WHEN 5 THEN '[IBAN_' || c_custkey || ']' ELSE '-.' || c_custkey END, '[^0-9.-]', '', 'g') AS k FROM customer)""",
)
def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 7 WHEN 0 THEN concat('QAR 12,500', c_custkey) WHEN 1 THEN concat('1-', c_custkey) WHEN 2 THEN '' "
        "WHEN 3 THEN concat('(', c_custkey, ')') WHEN 4 THEN concat(c_custkey, '.') WHEN 5 THEN concat('[IBAN_', c_custkey, ']') "
        "ELSE concat('-.', c_custkey) END AS cell",
    )
    return cells.select("c_custkey", R.to_number(F.col("cell")).alias("number"))


@plan("dti", spaced(PORTFOLIO, [RATED], "SELECT row_ord, dti FROM rated"))
def dti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS).select("row_ord", "dti")


@plan("risk_tier", spaced(PORTFOLIO, [RATED], "SELECT row_ord, tier FROM rated"))
def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS).select("row_ord", "tier")


@plan(
    "tier_groups",
    spaced(PORTFOLIO, [RATED], f"""SELECT tier, {TIER_RULE} AS rule, count(*) AS "count", concat(count(*), ' customer(s) in this tier.') AS summary FROM rated GROUP BY tier"""),
)
def tier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tier_summary(T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS))


@plan(
    "tier_members",
    spaced(PORTFOLIO, [VAULT, RATED], "SELECT r.tier, r.row_ord, d.customer_name AS member FROM rated r JOIN redacted d USING (row_ord)"),
)
def tier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS)
    vault = T.table_vault(rated.select("row_ord", "customer_name"), "row_ord", HEADERS)
    redacted = T.redact_table(rated.select("row_ord", "customer_name", "tier"), "row_ord", vault, HEADERS)
    return redacted.select("tier", "row_ord", F.col("customer_name").alias("member"))


@plan("tier_by_name", spaced(PORTFOLIO, [RATED, BY_NAME], "SELECT customer_name, tier, CAST(rank AS BIGINT) AS rank FROM named"))
def tier_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tier_by_name(T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS), "customer_name")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS)
    known = T.tier_by_name(rated, "customer_name").where("NOT endswith(customer_name, '7')")
    return T.tier_rows(rated, "customer_name", known)


JOINED = "joined AS (SELECT r.row_ord, r.customer_name, coalesce(n.tier, 'Unclassified') AS tier FROM rated r LEFT JOIN named n ON n.customer_name = r.customer_name AND right(r.customer_name, 1) <> '7')"


@plan("tier_join", spaced(PORTFOLIO, [RATED, BY_NAME, JOINED], "SELECT * FROM joined"))
def tier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).select("row_ord", "customer_name", "tier")


@plan("tier_sorted", spaced(PORTFOLIO, [RATED, BY_NAME, JOINED], f"SELECT CAST({RANK} AS BIGINT) AS rank, tier, row_ord FROM joined ORDER BY 1, 3"))
def tier_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = T.sort_by_tier(_joined(spark, sf_dir), "row_ord")
    return ordered.select(R.tier_order(F.col("tier")).cast("long").alias("rank"), "tier", "row_ord")


@plan(
    "route_task",
    spaced(["corpus"], [], f"SELECT kind, id, CASE WHEN regexp_matches(coalesce(text, ''), {lit('(?i)' + chr(92) + 'b(' + '|'.join(c.DRAFT_WORDS) + ')' + chr(92) + 'b')}) THEN 'draft' ELSE 'group' END AS task FROM corpus"),
)
def route_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "corpus").select("kind", "id", R.task_of(F.col("text")).alias("task"))


TARGETS = f"""targets AS MATERIALIZED (
  SELECT row_ord, customer_name, qid, iban, outstanding_loan AS debt, days_past_due AS dpd FROM portfolio
  WHERE days_past_due > 0 OR NOT EXISTS (SELECT 1 FROM portfolio WHERE days_past_due > 0))"""
AMOUNT = "regexp_replace(regexp_replace(format('{:,.3f}', debt), '0+$', ''), '\\.$', '')"


def _letter_sql(body: str, late: str, who: str) -> str:
    clause = f"CASE WHEN dpd <> 0 THEN {fill_sql(late, {'days': 'CAST(dpd AS VARCHAR)'})} ELSE '' END"
    return fill_sql(body, {"id": who, "amount": AMOUNT, "late": clause})


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = T.with_figures(portfolio(spark, sf_dir), "row_ord", HEADERS)
    return letter_ops.draft_targets(figures)


@plan("draft_targets", spaced(PORTFOLIO, [TARGETS], "SELECT row_ord, CAST(dpd AS DOUBLE) AS dpd FROM targets"))
def draft_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("row_ord", "dpd")


def _letters_redacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = portfolio(spark, sf_dir)
    vault = T.stored_vault(rows, "row_ord", HEADERS)
    redacted = T.redact_table(_targets(spark, sf_dir), "row_ord", vault, HEADERS)
    return letter_ops.letters(redacted, "customer_name"), vault


LETTER_IDS = "ids AS (SELECT t.*, v.placeholder AS who FROM targets t JOIN vault v ON v.type = 'NAME' AND v.value = t.customer_name)"


@plan(
    "draft_letters",
    spaced(PORTFOLIO, [VAULT, TARGETS, LETTER_IDS],
           f"SELECT row_ord, who AS id, {_letter_sql(c.LETTER_EN, c.LETTER_EN_LATE, 'who')} AS en, {_letter_sql(c.LETTER_AR, c.LETTER_AR_LATE, 'who')} AS ar FROM ids"),
)
def draft_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafted, _vault = _letters_redacted(spark, sf_dir)
    return drafted.select("row_ord", F.col("customer_name").alias("id"), "en", "ar")


@plan(
    "draft_restored",
    spaced(PORTFOLIO, [TARGETS],
           f"SELECT row_ord, customer_name AS name, {_letter_sql(c.LETTER_EN, c.LETTER_EN_LATE, 'customer_name')} AS en, {_letter_sql(c.LETTER_AR, c.LETTER_AR_LATE, 'customer_name')} AS ar FROM targets"),
)
def draft_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafted, vault = _letters_redacted(spark, sf_dir)
    entries = vault.select(F.struct("first_row", "first_col").alias("ord"), "placeholder", "value")
    # One pass restores all three texts, each a row of its own, so that no value can reach into another text.
    texts = drafted.select("row_ord", F.explode(F.create_map(
        F.lit("name"), F.col("customer_name"), F.lit("en"), F.col("en"), F.lit("ar"), F.col("ar"))).alias("part", "text"))
    restored = restore_text(texts, ["row_ord", "part"], [], "text", entries, "clear", nested=True)
    part = lambda name: F.max(F.when(F.col("part") == name, F.col("clear")))
    return restored.groupBy("row_ord").agg(
        F.coalesce(F.nullif(part("name"), F.lit("")), F.lit(c.NO_NAME)).alias("name"), part("en").alias("en"), part("ar").alias("ar"))


@plan(
    "draft_headline",
    spaced(PORTFOLIO, [TARGETS], """SELECT concat('Drafted ', count(*), ' bilingual payment reminder', CASE WHEN count(*) = 1 THEN '' ELSE 's' END,
CASE WHEN min(dpd) > 0 THEN ' for every overdue account' ELSE '' END, ' — English and Arabic.') AS headline FROM targets"""),
)
def draft_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _targets(spark, sf_dir).agg(F.count("*").alias("n"), (F.min("dpd") > 0).alias("overdue"))
    return counted.select(
        letter_ops.headline(F.col("n"), F.lit(INSTRUCTION), F.coalesce("overdue", F.lit(False))).alias("headline")
    )


BATCH = 40


def _prompt_check(source: str, head: str, task: str, tail: str) -> str:
    top = lit(f"{head}{','.join(COLUMNS)}\n")
    end = lit(f"\n\nTASK: {task}{tail}")
    return f"""SELECT CAST(floor((seq - 1) / {BATCH}) AS BIGINT) AS batch, count(*) AS n_rows, concat({top}, string_agg(line, chr(10) ORDER BY seq), {end}) AS prompt
FROM (SELECT {LINE} AS line, row_number() OVER (ORDER BY row_ord) AS seq FROM {source}) GROUP BY 1"""


@plan("build_prompts", spaced(PORTFOLIO, [VAULT], _prompt_check("redacted", c.GROUPING_HEAD, c.GROUPING_TASK, c.GROUPING_TAIL)))
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vault = vault_of(spark, sf_dir)
    redacted = T.redact_table(rows, "row_ord", vault, HEADERS)
    return T.prompt_batches(redacted, "row_ord", COLUMNS, c.GROUPING_HEAD, c.GROUPING_TASK, c.GROUPING_TAIL, BATCH)


@plan(
    "build_draft_prompts",
    spaced(PORTFOLIO, [VAULT], _prompt_check("(SELECT * FROM redacted WHERE days_past_due > 0)", c.DRAFT_HEAD, c.DRAFT_TASK, c.DRAFT_TAIL)),
)
def build_draft_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vault = vault_of(spark, sf_dir)
    redacted = T.redact_table(rows, "row_ord", vault, HEADERS).where("days_past_due > 0")
    return T.prompt_batches(redacted, "row_ord", COLUMNS, c.DRAFT_HEAD, c.DRAFT_TASK, c.DRAFT_TAIL, BATCH)


REPLY_JSON = """bodies AS (
  SELECT reply_id, CASE WHEN strpos(s, '{') > 0 AND strpos(reverse(s), '}') > 0 THEN
           substring(s, strpos(s, '{'), length(s) - strpos(reverse(s), '}') + 1 - strpos(s, '{') + 1) END AS body
  FROM (SELECT reply_id, regexp_replace(regexp_replace(trim(text), '^```(json)?\\s*', '', 'i'), '\\s*```$', '') AS s FROM replies)),
parsed AS MATERIALIZED (SELECT reply_id, CASE WHEN json_valid(body) THEN body END AS body FROM bodies)"""


@plan(
    "parse_model_json",
    spaced(["replies"], [REPLY_JSON], """SELECT reply_id, body AS json, json_extract_string(body, '$.headline') AS headline,
CAST(json_array_length(body, '$.groups') AS BIGINT) AS n_groups FROM parsed"""),
)
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = T.parse_replies(load(spark, sf_dir, "replies"))
    groups = F.col("grouping.groups")
    return parsed.select(
        "reply_id", "json", "grouping.headline", F.when(groups.isNotNull(), F.size(groups).cast("long")).alias("n_groups")
    )


@plan(
    "apply_grouping",
    spaced(["portfolio", "replies"], [VAULT, REPLY_JSON, """members AS (
  SELECT json_extract_string(body, '$.groups[0].members[0]') AS member, arg_max(json_extract_string(body, '$.groups[0].tier'), reply_id) AS tier
  FROM parsed WHERE body IS NOT NULL GROUP BY 1)"""],
           "SELECT d.row_ord, d.customer_name, coalesce(m.tier, 'Unclassified') AS tier FROM redacted d LEFT JOIN members m ON m.member = d.customer_name"),
)
def apply_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vault = vault_of(spark, sf_dir)
    redacted = T.redact_table(rows, "row_ord", vault, HEADERS)
    tiers = T.reply_tiers(T.parse_replies(load(spark, sf_dir, "replies")), "reply_id", "customer_name")
    return T.tier_rows(redacted, "customer_name", tiers).select("row_ord", "customer_name", "tier")


# Written apart from the operators: what each kind of reply must come to, with the values of its placeholders.
REPLY_VALUES = """v AS MATERIALIZED (SELECT reply_id, reply_id % 7 AS kind, n.value AS name, q.value AS qid, i.value AS iban, concat('[NAME_', k, ']') AS name_mark FROM model_replies
  JOIN vault n ON n.placeholder = concat('[NAME_', k, ']') JOIN vault q ON q.placeholder = concat('[QID_', k, ']') JOIN vault i ON i.placeholder = concat('[IBAN_', k, ']'))"""
MODEL = ["portfolio", "model_replies"]


def _model_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _rows, vault = vault_of(spark, sf_dir)
    entries = vault.select(F.struct("first_row", "first_col").alias("ord"), "placeholder", "value")
    return load(spark, sf_dir, "model_replies"), entries


@plan(
    "reply_groups_restored",
    spaced(MODEL, [VAULT, REPLY_VALUES], """SELECT reply_id, CAST(0 AS INT) AS g_ord, concat('About ', name, ' today') AS headline, 'High risk' AS tier, 'late' AS rule, concat(name, ' owes') AS summary, CAST(2 AS BIGINT) AS "count" FROM v WHERE kind = 0
UNION ALL SELECT reply_id, 1, concat('About ', name, ' today'), 'Low risk', '', '', 0 FROM v WHERE kind = 0
UNION ALL SELECT reply_id, 1, '7', 'Low risk', '', qid, 2 FROM v WHERE kind = 1
UNION ALL SELECT reply_id, 2, '7', NULL, 'no tier', '', 0 FROM v WHERE kind = 1
UNION ALL SELECT reply_id, 0, '', 'Medium risk', '', concat(iban, ' stays'), 0 FROM v WHERE kind = 6"""),
)
def reply_groups_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, entries = _model_parts(spark, sf_dir)
    return M.restored_groups(M.grouping_rows(replies, "reply_id"), "reply_id", entries)


@plan(
    "reply_members_restored",
    spaced(MODEL, [VAULT, REPLY_VALUES], """SELECT reply_id, CAST(0 AS INT) AS g_ord, 'High risk' AS tier, CAST(0 AS INT) AS m_ord, name AS member FROM v WHERE kind = 0
UNION ALL SELECT reply_id, 0, 'High risk', 1, qid FROM v WHERE kind = 0
UNION ALL SELECT reply_id, 1, 'Low risk', 0, concat(' ', name, ' ') FROM v WHERE kind = 1
UNION ALL SELECT reply_id, 1, 'Low risk', 1, '5' FROM v WHERE kind = 1"""),
)
def reply_members_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, entries = _model_parts(spark, sf_dir)
    return M.restored_members(M.grouping_rows(replies, "reply_id"), "reply_id", entries)


@plan(
    "reply_drafts_restored",
    spaced(MODEL, [VAULT, REPLY_VALUES], """SELECT reply_id, CAST(0 AS INT) AS d_ord, name, concat('Dear ', name, ', ', qid) AS en, name AS ar FROM v WHERE kind = 4
UNION ALL SELECT reply_id, 1, qid, '', '' FROM v WHERE kind = 4
UNION ALL SELECT reply_id, 3, 'Customer', '', 'x' FROM v WHERE kind = 4
UNION ALL SELECT reply_id, 0, '9', '', concat(name, name) FROM v WHERE kind = 6"""),
)
def reply_drafts_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies, entries = _model_parts(spark, sf_dir)
    return M.restored_drafts(M.draft_rows(replies, "reply_id"), "reply_id", entries)


@plan(
    "reply_tiers",
    spaced(MODEL, [VAULT, REPLY_VALUES], """SELECT mark AS customer_name, arg_max(tier, {'r': reply_id, 'm': m}) AS tier FROM (
SELECT reply_id, 0 AS m, name_mark AS mark, 'High risk' AS tier FROM v WHERE kind = 0 UNION ALL SELECT reply_id, 1, replace(name_mark, 'NAME', 'QID'), 'High risk' FROM v WHERE kind = 0
UNION ALL SELECT reply_id, 0, name_mark, 'Low risk' FROM v WHERE kind = 1 UNION ALL SELECT reply_id, 1, '5', 'Low risk' FROM v WHERE kind = 1) GROUP BY mark"""),
)
def reply_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tiers_of(M.grouping_rows(load(spark, sf_dir, "model_replies"), "reply_id"), "reply_id", "customer_name")


GROUPED = f"""SELECT {lit(c.GROUPING_HEADLINE)} AS headline, r.tier, {TIER_RULE.replace('CASE tier', 'CASE r.tier')} AS rule, n AS "count", concat(n, ' customer(s) in this tier.') AS summary, row_ord, {{member}} AS member
FROM rated r JOIN (SELECT tier, count(*) AS n FROM rated GROUP BY tier) USING (tier)"""


@plan("tier_grouping", spaced(PORTFOLIO, [VAULT, RATED], GROUPED.format(member="(SELECT d.customer_name FROM redacted d WHERE d.row_ord = r.row_ord)")))
def tier_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping by rules with its members, as the model's grouping would be: on the redacted table."""
    rated = T.with_risk(portfolio(spark, sf_dir), "row_ord", HEADERS)
    vault = T.table_vault(rated.select("row_ord", *COLUMNS), "row_ord", HEADERS)
    redacted = T.redact_table(rated.select("row_ord", *COLUMNS, "tier"), "row_ord", vault, HEADERS)
    return T.tier_grouping(redacted, "row_ord", HEADERS)


@plan("tier_grouping_unnamed", spaced(PORTFOLIO, [RATED], GROUPED.format(member="r.segment")))
def tier_grouping_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a name column: members are called by its first column."""
    rated = T.with_risk(portfolio(spark, sf_dir).select("row_ord", "segment", "monthly_salary", "outstanding_loan", "days_past_due"), "row_ord", HEADERS)
    return T.tier_grouping(rated, "row_ord", HEADERS)


@plan(
    "draft_letters_unnamed",
    spaced(PORTFOLIO, [], f"SELECT row_ord, segment AS id, {_letter_sql(c.LETTER_EN, c.LETTER_EN_LATE, 'segment')} AS en, {_letter_sql(c.LETTER_AR, c.LETTER_AR_LATE, 'segment')} AS ar "
           "FROM (SELECT row_ord, segment, outstanding_loan AS debt, days_past_due AS dpd FROM portfolio WHERE days_past_due > 0)"),
)
def draft_letters_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters from a table without a name column greet by its first column."""
    rows = portfolio(spark, sf_dir).select("row_ord", "segment", "outstanding_loan", "days_past_due")
    called = T.addressee(rows, "row_ord", HEADERS)
    targets = letter_ops.draft_targets(T.with_figures(rows, "row_ord", HEADERS))
    return letter_ops.letters(targets, called).select("row_ord", F.col(called).alias("id"), "en", "ar")
