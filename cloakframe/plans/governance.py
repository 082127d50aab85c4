"""Policy, ledger, approvals and hash chain over the prompts view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.redaction import entity_summary, with_redaction
from cloakframe.operators import ledger as L
from cloakframe.operators.numbering import carry_last
from cloakframe.operators.responders import chat_provider, distinct_placeholders, gateway_provider, gateway_reply
from cloakframe.operators.restore import restore_text
from cloakframe.plans.checksql import lit, redacted_ctes, reply_sql, spaced, spans_ctes
from cloakframe.plans.registry import plan
from cloakframe.session import materialise
from cloakframe.sources.views import load

PROMPTS = ["prompts"]
KEPT = spans_ctes("prompts", "prompt_id")
REDACTED = redacted_ctes("prompts", "prompt_id")

FIRST_NAME = "list_filter(ph, lambda p: starts_with(p, '[NAME'))[1]"
FIRST_CARD = "list_filter(ph, lambda p: starts_with(p, '[PAN'))[1]"
REPLY = reply_sql(
    "lower(redacted)",
    c.GATEWAY_INTENTS,
    c.GATEWAY_REPLIES,
    {
        "who": f"coalesce({FIRST_NAME}, {lit(c.GATEWAY_NOBODY)})",
        "card": f"coalesce(' on card ' || {FIRST_CARD}, '')",
        "others": f"CASE WHEN len(ph) > 1 THEN concat({lit(c.GATEWAY_OTHERS[0])}, len(ph) - 1, {lit(c.GATEWAY_OTHERS[1])}) ELSE '' END",
        "fields": f"CASE WHEN len(ph) > 0 THEN concat({lit(c.GATEWAY_FIELDS[0])}, array_to_string(ph, ', '), {lit(c.GATEWAY_FIELDS[1])})"
                  f" ELSE {lit(c.GATEWAY_NO_FIELDS)} END",
    },
)
RULES = ", ".join(f"({lit(d)}, {lit(t)}, {lit(r)})" for d, t, r in c.POLICY)
VERDICT = f"""facts AS MATERIALIZED (
  SELECT r.prompt_id, r.destination, r.redacted, CASE e.rank WHEN 3 THEN 'restricted' WHEN 2 THEN 'confidential' WHEN 1 THEN 'internal' END AS sensitivity,
         coalesce(e.cls, []) AS cls, coalesce(e.ph, []) AS ph, coalesce(e.entities, '[]') AS entities
  FROM redacted r LEFT JOIN (
    SELECT prompt_id, max(rank) AS rank, list(placeholder ORDER BY first_start) AS ph,
           concat('[', string_agg(CAST(json_object('placeholder', placeholder, 'type', type, 'cls', cls, 'sensitivity', sensitivity,
                  'label', label, 'masked', masked) AS VARCHAR), ',' ORDER BY first_start), ']') AS entities,
           list(cls ORDER BY first_start) FILTER (cls_rank = 1) AS cls
    FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, cls ORDER BY first_start) AS cls_rank FROM entity) GROUP BY prompt_id) e
  ON r.prompt_id = e.prompt_id),
rules(dest, tier, rule) AS (VALUES {RULES}),
verdict AS MATERIALIZED (
  SELECT f.*, f2.dest, f2.tier, CASE WHEN f2.never IS NOT NULL THEN 'block' ELSE coalesce(rule, 'allow') END AS decision,
         CASE WHEN f2.never IS NOT NULL THEN concat({lit(c.REASON_BLOCKED_CLASS[0])}, f2.never, {lit(c.REASON_BLOCKED_CLASS[1])})
              WHEN rule = 'require-approval' THEN concat(upper(left(f2.tier, 1)), substring(f2.tier, 2), {lit(c.REASON_APPROVAL)})
              WHEN rule = 'block' THEN concat(upper(left(f2.tier, 1)), substring(f2.tier, 2), {lit(c.REASON_NOT_PERMITTED)})
              WHEN f2.dest = 'sovereign-local' THEN {lit(c.REASON_SOVEREIGN)}
              ELSE concat(upper(left(f2.tier, 1)), substring(f2.tier, 2), {lit(c.REASON_PERMITTED)}) END AS reason
  FROM facts f JOIN (SELECT prompt_id, coalesce(sensitivity, 'none') AS tier,
                            CASE WHEN destination IN ('sovereign-local', 'external-cloud') THEN destination ELSE 'sovereign-local' END AS dest,
                            CASE WHEN destination = 'external-cloud' THEN list_filter(cls, lambda x: x = 'credential')[1] END AS never
                     FROM facts) f2 USING (prompt_id)
  LEFT JOIN rules ON rules.dest = f2.dest AND rules.tier = f2.tier)"""
LEDGER = f"""ledger AS MATERIALIZED (
  SELECT prompt_id AS id, strftime(TIMESTAMP '2024-01-01' + to_seconds(prompt_id), '%Y-%m-%d %H:%M:%S') AS created_at,
         'dashboard' AS actor, 'operator' AS role, destination,
         CASE WHEN decision = 'allow' THEN '{c.OFFLINE_PROVIDER}' END AS provider, CASE WHEN decision = 'allow' THEN '{c.OFFLINE_MODEL}' END AS model,
         redacted AS prompt_redacted, entities, CAST(to_json(cls) AS VARCHAR) AS classes, sensitivity, decision,
         CASE decision WHEN 'block' THEN 'blocked' WHEN 'require-approval' THEN 'pending' ELSE 'completed' END AS status, reason,
         CAST(NULL AS VARCHAR) AS approver, CASE WHEN decision = 'allow' THEN {REPLY} END AS output_redacted, ph
  FROM verdict)"""
LEDGER_CTES = [KEPT, REDACTED, VERDICT, LEDGER]
LEDGER_COLS = (
    "id, created_at, actor, role, destination, provider, model, prompt_redacted, entities, classes, sensitivity, "
    "decision, status, reason, approver, output_redacted"
)
DECISIONS = """decisions AS (
  SELECT *, TIMESTAMP '2024-02-01' + to_seconds((decision_id * 37) % 100000) AS decided_at FROM (
  SELECT prompt_id AS request_id, 4 * prompt_id AS decision_id, CASE WHEN (prompt_id // 12) % 3 = 0 THEN 'approve' ELSE 'reject' END AS verdict, 'dashboard:lead' AS approver,
         CASE WHEN prompt_id % 5 = 0 THEN 'not needed' END AS notes FROM prompts WHERE (prompt_id // 12) % 3 < 2
  UNION ALL SELECT prompt_id, 4 * prompt_id + 1, CASE WHEN prompt_id % 2 = 0 THEN 'approve' ELSE 'reject' END, 'dashboard:second', 'second look' FROM prompts WHERE prompt_id % 3 > 0
  UNION ALL SELECT -prompt_id, 4 * prompt_id + 2, 'approve', 'dashboard:lead', NULL FROM prompts WHERE prompt_id % 50 = 0 AND prompt_id > 0)),
turns AS (SELECT *, row_number() OVER w AS nr, first_value(verdict) OVER w AS first_verdict FROM decisions WINDOW w AS (PARTITION BY request_id ORDER BY decided_at, decision_id)),
asked AS MATERIALIZED (SELECT l.id AS lid, l.reason AS old_reason, l.ph AS lph, t.*,
         CASE WHEN l.status = 'pending' AND nr > 1 THEN CASE first_verdict WHEN 'approve' THEN 'completed' ELSE 'rejected' END ELSE l.status END AS found_status
  FROM turns t LEFT JOIN ledger l ON l.id = t.request_id)"""
OUTCOMES = f"""outcomes AS MATERIALIZED (
  SELECT request_id, decision_id, decided_at, verdict, coalesce(found_status = 'pending', FALSE) AS ok,
         CASE WHEN lid IS NULL THEN 'Request not found' WHEN found_status <> 'pending' THEN concat('Request is ''', found_status, ''', not pending') END AS error,
         CASE WHEN found_status = 'pending' THEN CASE verdict WHEN 'approve' THEN 'completed' ELSE 'rejected' END ELSE found_status END AS status,
         CASE WHEN found_status = 'pending' THEN approver END AS approver,
         CASE WHEN found_status = 'pending' AND verdict = 'reject' THEN coalesce(notes, old_reason) ELSE old_reason END AS reason,
         CASE WHEN found_status = 'pending' AND verdict = 'approve' THEN '{c.OFFLINE_PROVIDER}' END AS provider,
         CASE WHEN found_status = 'pending' AND verdict = 'approve' THEN '{c.OFFLINE_MODEL}' END AS model,
         CASE WHEN found_status = 'pending' AND verdict = 'approve' THEN (SELECT r.reply FROM replied r WHERE r.id = lid) END AS output_redacted
  FROM asked)"""
REPLIED = f"replied AS MATERIALIZED (SELECT id, {REPLY.replace('redacted)', 'prompt_redacted)')} AS reply FROM ledger)"
SETTLED = """settled AS MATERIALIZED (
  SELECT l.id, l.created_at, l.actor, l.role, l.destination, l.decision, coalesce(o.status, l.status) AS status, l.sensitivity, l.classes,
         l.prompt_redacted, l.entities, coalesce(o.output_redacted, l.output_redacted) AS output_redacted, o.approver,
         CASE WHEN o.ok THEN 1 ELSE 0 END AS phase,
         CASE WHEN o.ok THEN o.decided_at ELSE CAST(l.created_at AS TIMESTAMP) END AS settled_at
  FROM ledger l LEFT JOIN outcomes o ON o.request_id = l.id AND o.ok)"""
HEADS = """heads AS MATERIALIZED (
  SELECT id, status, phase, concat(left(j, length(j) - 1), ',"prev_hash":"') AS head, row_number() OVER (ORDER BY settled_at, id) AS seq
  FROM (SELECT *, CAST(json_object('id', id, 'created_at', created_at, 'actor', actor, 'role', role, 'destination', destination, 'decision', decision,
          'status', status, 'sensitivity', sensitivity, 'classes', list_sort(CAST(CAST(classes AS JSON) AS VARCHAR[])), 'prompt_redacted', prompt_redacted,
          'entities', entities, 'output_redacted', output_redacted, 'approver', approver) AS VARCHAR) AS j
        FROM settled WHERE status <> 'pending'))"""
CHAIN_CTES = [*LEDGER_CTES, REPLIED, DECISIONS, OUTCOMES, SETTLED, HEADS]


def chain_check(block_rows: int | None) -> str:
    start = "seq = 1" if block_rows is None else f"(seq - 1) % {block_rows} = 0"
    step = "" if block_rows is None else f" AND (h.seq - 1) % {block_rows} <> 0"
    return f"""chain AS (
  SELECT seq, id, repeat('0', 64) AS prev_hash, sha256(concat(head, repeat('0', 64), '"}}')) AS hash FROM heads WHERE {start}
  UNION ALL
  SELECT h.seq, h.id, c.hash, sha256(concat(h.head, c.hash, '"}}')) FROM chain c JOIN heads h ON h.seq = c.seq + 1{step})"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(load(spark, sf_dir, "prompts"))


def requests_of(prompts: DataFrame) -> DataFrame:
    """The prompts as gateway requests, one second apart."""
    return prompts.select(
        F.col("prompt_id").alias("id"),
        F.expr("date_format(timestampadd(SECOND, prompt_id, TIMESTAMP_NTZ '2024-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss')").alias("created_at"),
        F.lit("dashboard").alias("actor"),
        F.lit("operator").alias("role"),
        "destination",
        "text",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions_of(load(spark, sf_dir, "prompts").select("prompt_id"))


def decisions_of(prompts: DataFrame) -> DataFrame:
    """Approver decisions: some on records that are not held, some on unknown ids, some a second one on the same request."""
    given = prompts.where("(prompt_id div 12) % 3 < 2").selectExpr(
        "prompt_id AS request_id",
        "4 * prompt_id AS decision_id",
        "CASE WHEN (prompt_id div 12) % 3 = 0 THEN 'approve' ELSE 'reject' END AS verdict",
        "'dashboard:lead' AS approver",
        "CASE WHEN prompt_id % 5 = 0 THEN 'not needed' END AS notes",
    )
    again = prompts.where("prompt_id % 3 > 0").selectExpr(
        "prompt_id AS request_id", "4 * prompt_id + 1 AS decision_id",
        "CASE WHEN prompt_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS verdict", "'dashboard:second' AS approver", "'second look' AS notes",
    )
    unknown = prompts.where("prompt_id % 50 = 0 AND prompt_id > 0").selectExpr(
        "-prompt_id AS request_id", "4 * prompt_id + 2 AS decision_id", "'approve' AS verdict", "'dashboard:lead' AS approver", "CAST(NULL AS STRING) AS notes"
    )
    every = given.unionByName(again).unionByName(unknown)
    return every.withColumn("decided_at", F.expr("TIMESTAMP_NTZ '2024-02-01' + make_interval(0, 0, 0, 0, 0, 0, (decision_id * 37) % 100000)"))


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_rows(requests(spark, sf_dir))


def settled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(full_ledger(spark, sf_dir))
    return L.settle(rows, L.apply_approvals(rows, decisions(spark, sf_dir)))


def _assessed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assess(load(spark, sf_dir, "prompts"))


POLICY_COLS = "prompt_id, dest, tier, decision"


@plan("policy_decide", spaced(PROMPTS, [KEPT, REDACTED, VERDICT], f"SELECT {POLICY_COLS} FROM verdict"))
def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed_prompts(spark, sf_dir).select("prompt_id", "dest", "tier", "decision")


@plan("policy_reason", spaced(PROMPTS, [KEPT, REDACTED, VERDICT], "SELECT prompt_id, reason FROM verdict"))
def policy_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed_prompts(spark, sf_dir).select("prompt_id", "reason")


@plan(
    "policy_block",
    spaced(PROMPTS, [KEPT, REDACTED, VERDICT], "SELECT prompt_id, array_to_string(cls, ',') AS classes, reason FROM verdict WHERE decision = 'block'"),
)
def policy_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = _assessed_prompts(spark, sf_dir).where("decision = 'block'")
    return blocked.select("prompt_id", F.array_join("class_list", ",").alias("classes"), "reason")


@plan(
    "exposure_by_type",
    spaced(["corpus"], [spans_ctes("corpus"), redacted_ctes("corpus")], """SELECT kind, type, cls, sensitivity, count(DISTINCT id) AS texts, count(*) AS n_values
FROM entity GROUP BY kind, type, cls, sensitivity"""),
)
def exposure_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    rows = done.select("kind", "id", F.inline_outer(entity_summary(F.col("entities")))).where("type IS NOT NULL")
    per_text = rows.groupBy("kind", "type", "cls", "sensitivity", "id").agg(F.count("*").alias("k"))
    return per_text.groupBy("kind", "type", "cls", "sensitivity").agg(
        F.count("*").alias("texts"), F.sum("k").alias("n_values")
    )


@plan("ledger_rows", spaced(PROMPTS, LEDGER_CTES, f"SELECT {LEDGER_COLS} FROM ledger"))
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_ledger(spark, sf_dir)


@plan("respond_gateway", spaced(PROMPTS, [*LEDGER_CTES, REPLIED], "SELECT id, reply FROM replied"))
def respond_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "prompts"))
    return done.select(
        F.col("prompt_id").alias("id"),
        gateway_reply(F.col("redacted"), distinct_placeholders(F.col("redacted"))).alias("reply"),
    )


@plan(
    "apply_approvals",
    spaced(PROMPTS, [*LEDGER_CTES, REPLIED, DECISIONS, OUTCOMES],
           "SELECT request_id, decision_id, decided_at, verdict, ok, error, status, approver, reason, provider, model, output_redacted FROM outcomes"),
)
def apply_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.apply_approvals(full_ledger(spark, sf_dir), decisions(spark, sf_dir))


@plan("canonical_hash", spaced(PROMPTS, CHAIN_CTES, """SELECT id, sha256(concat(head, repeat('0', 64), '"}')) AS digest FROM heads"""))
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = settled_ledger(spark, sf_dir).where("status <> 'pending'")
    return final.select("id", L.linked_hash(L.canonical_head(), F.lit(c.GENESIS)).alias("digest"))


@plan("build_chain", spaced(PROMPTS, [*CHAIN_CTES, chain_check(None)], "SELECT seq, id, prev_hash, hash FROM chain"))
def build_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = L.build_chain(settled_ledger(spark, sf_dir), ["settled_at", "id"])
    return chained.select("seq", "id", "prev_hash", "hash")


@plan("build_chain_blocks", spaced(PROMPTS, [*CHAIN_CTES, chain_check(100)], "SELECT seq, id, prev_hash, hash FROM chain"))
def build_chain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = L.build_chain_blocks(settled_ledger(spark, sf_dir), ["settled_at", "id"], block_rows=100)
    return chained.select("seq", "id", "prev_hash", "hash")


VERIFIED = "concat('Verified ', count(*), ' records — chain intact, no tampering detected.')"


@plan(
    "verify_chain",
    spaced(PROMPTS, [*CHAIN_CTES, chain_check(None)],
           f"SELECT TRUE AS ok, count(*) AS total, CAST(NULL AS BIGINT) AS broken_at, {VERIFIED} AS message FROM chain"),
)
def verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.verify_chain(L.build_chain(settled_ledger(spark, sf_dir), ["settled_at", "id"]), ["settled_at", "id"])


@plan(
    "verify_chain_tampered",
    spaced(PROMPTS, CHAIN_CTES, """SELECT FALSE AS ok, (SELECT count(*) FROM heads) AS total, id AS broken_at,
concat('Integrity check FAILED at record #', id, ' — the audit log has been altered.') AS message
FROM heads WHERE id % 400 = 11 ORDER BY seq LIMIT 1"""),
)
def verify_chain_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = L.build_chain(settled_ledger(spark, sf_dir), ["settled_at", "id"])
    edited = chained.withColumn("actor", F.when(F.col("id") % 400 == 11, "someone else").otherwise(F.col("actor")))
    return L.verify_chain(edited, ["settled_at", "id"])


@plan(
    "prev_hash_asof",
    spaced(PROMPTS, [*LEDGER_CTES], """SELECT id, last_value(h IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hash
FROM (SELECT id, CASE WHEN status <> 'pending' THEN sha256(prompt_redacted) END AS h FROM ledger)"""),
)
def prev_hash_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_ledger(spark, sf_dir).select(
        "id", F.when(F.col("status") != "pending", F.sha2("prompt_redacted", 256)).alias("h")
    )
    return carry_last(rows, ["id"], "h", "prev_hash").select("id", "prev_hash")


@plan(
    "ledger_view",
    spaced(PROMPTS, [*LEDGER_CTES], """SELECT l.id, l.decision, len(l.ph) AS n_entities, array_to_string(CAST(CAST(l.classes AS JSON) AS VARCHAR[]), ',') AS classes,
p.text AS prompt_clear FROM ledger l JOIN prompts p ON p.prompt_id = l.id"""),
)
def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(full_ledger(spark, sf_dir))
    vault = (
        with_redaction(load(spark, sf_dir, "prompts"))
        .select(F.col("prompt_id").alias("id"), F.posexplode_outer("entities").alias("ord", "e"))
        .where("e IS NOT NULL")
        .select("id", "ord", F.col("e.placeholder").alias("placeholder"), F.col("e.value").alias("value"))
    )
    clear = restore_text(rows, ["id"], ["id"], "prompt_redacted", vault, "prompt_clear")
    return L.public_view(clear).select(
        "id",
        "decision",
        F.size("entities").cast("long").alias("n_entities"),
        F.array_join("classes", ",").alias("classes"),
        "prompt_clear",
    )


@plan("latest_requests", spaced(PROMPTS, LEDGER_CTES, "SELECT id, decision, status FROM ledger ORDER BY id DESC LIMIT 50"))
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_rows(requests(spark, sf_dir)).select("id", "decision", "status")


@plan("older_requests", spaced(PROMPTS, LEDGER_CTES, "SELECT id, decision, status FROM ledger WHERE id < 100 ORDER BY id DESC LIMIT 20"))
def older_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_rows(requests(spark, sf_dir), limit=20, before=100).select("id", "decision", "status")


@plan("request_by_id", spaced(PROMPTS, LEDGER_CTES, f"SELECT {LEDGER_COLS} FROM ledger WHERE id = 7"))
def request_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_id(full_ledger(spark, sf_dir), 7)


@plan(
    "route_provider",
    f"""WITH s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'ollama' WHEN 3 THEN 'echo' WHEN 4 THEN 'other' END AS choice,
  CASE WHEN c_custkey % 4 < 2 THEN 'external-cloud' ELSE 'sovereign-local' END AS destination, c_custkey % 5 = 0 AS has_key FROM customer)
SELECT c_custkey,
  CASE WHEN w = 'echo' THEN '{c.OFFLINE_PROVIDER}'
       WHEN w = 'openai' OR (w = 'auto' AND destination = 'external-cloud' AND has_key)
         THEN CASE WHEN destination = 'external-cloud' THEN 'openai' ELSE '{c.OFFLINE_PROVIDER}' END
       WHEN w IN ('ollama', 'auto') THEN 'ollama' ELSE '{c.OFFLINE_PROVIDER}' END AS gateway,
  CASE WHEN lower(choice) IN ('sovereign', 'openai', 'anthropic', 'ollama') THEN lower(choice) ELSE 'sovereign' END AS chat
FROM (SELECT *, lower(coalesce(choice, 'auto')) AS w FROM s)""",
)
def route_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'ollama' WHEN 3 THEN 'echo' WHEN 4 THEN 'other' END AS choice",
        "CASE WHEN c_custkey % 4 < 2 THEN 'external-cloud' ELSE 'sovereign-local' END AS destination",
        "c_custkey % 5 = 0 AS has_key",
    )
    return settings.select(
        "c_custkey",
        gateway_provider(F.col("choice"), F.col("destination"), F.col("has_key")).alias("gateway"),
        chat_provider(F.col("choice")).alias("chat"),
    )
