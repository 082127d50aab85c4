"""Streaming jobs drained over the test tables, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.operators import ledger as L
from cloakframe.plans.checksql import redacted_ctes, spaced, spans_ctes
from cloakframe.plans.conversations import CHAT, MESSAGES
from cloakframe.plans.governance import DECISIONS, LEDGER_CTES, OUTCOMES, PROMPTS, REPLIED, decisions_of, requests_of
from cloakframe.plans.operations import FAULTS, STATE
from cloakframe.plans.registry import plan
from cloakframe.session import scratch_path
from cloakframe.sources.views import VIEWS, load
from cloakframe.streaming import jobs as J


def utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents WHERE trim(text) <> '')"


@plan(
    "stream_screen_requests",
    "WITH RECURSIVE " + DOCS + ", " + spans_ctes("docs", "id") + ", " + redacted_ctes("docs", "id")
    + " SELECT id, trim(redacted) AS prompt_redacted FROM redacted",
)
def stream_screen_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    requests = J.read_stream(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit("2024-01-01 00:00:00").alias("created_at"),
        F.lit("stream").alias("actor"),
        F.lit("operator").alias("role"),
        F.lit("external-cloud").alias("destination"),
        "text",
    )
    return J.run_available(J.screen_requests(requests), "screened").select("id", "prompt_redacted")


@plan("stream_redact_chat", spaced(MESSAGES, CHAT, "SELECT conv_id, turn, redacted, protected_count, n_new, FALSE AS late FROM chat"))
def stream_redact_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    raw = J.read_stream(spark, sf_dir, "conversations")
    anchored = raw.withColumn(
        "text",
        F.when(
            F.col("role") == "user",
            F.concat(
                "text", F.lit(" Customer Omar Khan, mail u"), F.col("conv_id") % 9, F.lit("@x.qa"),
                F.when(F.col("turn") > 0, ", and Omar Khan again.").otherwise("."),
            ),
        ).otherwise(F.col("text")),
    )
    done = J.redact_chat(anchored, scratch_path(spark, "chat"))
    return done.select("conv_id", "turn", "redacted", "protected_count", F.size("entries").cast("long").alias("n_new"), "late")


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events{where})"


@plan(
    "stream_lockout_alerts",
    f"""SELECT ip, ts AS locked_at, since FROM (
SELECT 'gateway' AS ip, ts, lag(ts, {c.LOCK_THRESHOLD - 1}) OVER (ORDER BY ts, event_id) AS since FROM events WHERE event_type = 'error')
WHERE ts - since <= INTERVAL {c.LOCK_WINDOW_SECONDS} SECONDS""",
)
def stream_lockout_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users come through one gateway address here, so that the real window and threshold are reached."""
    utc(spark)
    attempts = J.read_stream(spark, sf_dir, "events").selectExpr(
        "'gateway' AS ip", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success", "ts AS at"
    )
    return plain_time(J.run_available(J.lockout_alerts(attempts), "lockouts"), "locked_at", "since")


@plan(
    "stream_idle_sessions",
    f"""SELECT token, min(ts) AS first_seen, max(ts) + INTERVAL 24 HOURS AS idle_at, count(*) AS accesses FROM (
SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 24 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY ts, event_id) AS s FROM (
SELECT event_id, concat('tok', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS token, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events))
GROUP BY token, s HAVING max(ts) + INTERVAL 24 HOURS <= {CLOSED.format(where='')}""",
)
def stream_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    accesses = J.read_stream(spark, sf_dir, "events").selectExpr(
        "concat('tok', lpad(CAST(user_id AS STRING), 5, '0')) AS token", "ts AS seen_at"
    )
    return plain_time(J.run_available(J.idle_sessions(accesses), "idle"), "first_seen", "idle_at")


@plan(
    "stream_audit_activity",
    f"""SELECT window_start, action, count(*) AS n FROM (SELECT date_trunc('day', ts) AS window_start, event_type AS action FROM events)
WHERE window_start + INTERVAL 1 DAY <= {CLOSED.format(where='')} GROUP BY window_start, action""",
)
def stream_audit_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    log = J.read_stream(spark, sf_dir, "events").selectExpr("event_type AS action", "ts AS created_at")
    return plain_time(J.run_available(J.audit_activity(log), "activity"), "window_start")


REQUESTS = "event_type = 'view'"
DECIDED = "event_type = 'purchase'"


@plan(
    "stream_approval_queue",
    f"""WITH r AS (SELECT event_id AS id, ts AS created_at FROM events WHERE {REQUESTS}),
d AS (SELECT event_id - event_id % 7 AS request_id, CASE WHEN user_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS verdict, ts AS decided_at FROM events WHERE {DECIDED})
SELECT r.id, r.created_at, d.verdict, d.decided_at FROM r LEFT JOIN d ON d.request_id = r.id AND d.decided_at >= r.created_at AND d.decided_at <= r.created_at + INTERVAL 3 DAY
WHERE d.verdict IS NOT NULL OR r.created_at + INTERVAL 3 DAY < least((SELECT max(created_at) FROM r), (SELECT max(decided_at) FROM d)) - INTERVAL 1 HOUR""",
)
def stream_approval_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided requests, and undecided ones whose patience the watermark has passed; the rest is still open."""
    utc(spark)
    events = J.read_stream(spark, sf_dir, "events")
    requests = events.where(REQUESTS).selectExpr("event_id AS id", "ts AS created_at")
    decisions = J.read_stream(spark, sf_dir, "events").where(DECIDED).selectExpr(
        "event_id - event_id % 7 AS request_id", "CASE WHEN user_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS verdict", "ts AS decided_at"
    )
    queue = J.run_available(J.approval_queue(requests, decisions), "approvals")
    return plain_time(queue, "created_at", "decided_at")



ACCESSES = """accesses AS (SELECT event_id, concat('tok', lpad(CAST(CASE WHEN event_id % 11 = 0 THEN 99999 ELSE user_id END AS VARCHAR), 5, '0')) AS token,
ts + INTERVAL 2 DAY AS seen_at FROM events)"""
JUDGED = f"""judged AS MATERIALIZED (SELECT event_id, token, seen_at, {STATE} AS state
FROM (SELECT *, min(CASE WHEN fault IS NOT NULL THEN nr END) OVER (PARTITION BY token) AS first_nr FROM faults))"""


def followed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    accesses = J.read_stream(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('tok', lpad(CAST(CASE WHEN event_id % 11 = 0 THEN 99999 ELSE user_id END AS STRING), 5, '0')) AS token",
        "ts + INTERVAL 2 DAYS AS seen_at",
    )
    return plain_time(J.run_available(J.session_states(accesses, load(spark, sf_dir, "sessions")), "sessions"), "at")


@plan("stream_session_states", spaced(["sessions"], [ACCESSES, FAULTS, JUDGED], "SELECT event_id, token, state FROM judged"))
def stream_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followed_sessions(spark, sf_dir).where("kind = 'access'").select("event_id", "token", "state")


@plan(
    "stream_session_ends",
    spaced(["sessions"], [ACCESSES, FAULTS, JUDGED, """lasts AS (SELECT token, max(seen_at) FILTER (state = 'valid') AS last_valid, bool_or(state <> 'valid') AS found_over FROM judged GROUP BY token),
limits AS (SELECT s.token, found_over, revoked_at AS r, expires_at + INTERVAL 1 MICROSECOND AS e,
  coalesce(last_valid, last_seen_at, created_at) + INTERVAL 24 HOURS + INTERVAL 1 MICROSECOND AS i FROM sessions s LEFT JOIN lasts USING (token))"""],
           """SELECT token, least(r, e, i) AS ended_at, CASE least(r, e, i) WHEN r THEN 'revoked' WHEN e THEN 'expired' ELSE 'idle' END AS reason FROM limits
WHERE found_over OR least(r, e, i) <= (SELECT max(seen_at) - INTERVAL 1 HOUR FROM accesses)"""),
)
def stream_session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session over by the watermark, whether an access found it so or only time passed."""
    return followed_sessions(spark, sf_dir).where("kind = 'end'").select("token", F.col("at").alias("ended_at"), F.col("state").alias("reason"))


def approval_events(spark: SparkSession, sf_dir: str, made: str = "true") -> DataFrame:
    utc(spark)
    stream = J.spread(J.read_stream(spark, sf_dir, "customer"))
    name = "customer_arriving"
    stream.createOrReplaceTempView(name)
    prompts = spark.sql(VIEWS["prompts"].replace("@customer", name))
    events = J.approval_events(L.ledger_rows(requests_of(prompts)), decisions_of(prompts).where(made), delay="0 seconds")
    return plain_time(J.run_available(events, "approvals"), "at")


@plan(
    "stream_approval_events",
    spaced(PROMPTS, [*LEDGER_CTES, REPLIED, DECISIONS, OUTCOMES],
           "SELECT request_id, decision_id, decided_at, verdict, ok, error, status, approver, reason, provider, model, output_redacted FROM outcomes"),
)
def stream_approval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = approval_events(spark, sf_dir).where("kind = 'decided'").withColumnRenamed("at", "decided_at")
    return decided.drop("kind")


@plan(
    "stream_open_requests",
    spaced(PROMPTS, LEDGER_CTES, "SELECT id AS request_id, CAST(created_at AS TIMESTAMP) AS opened_at FROM ledger WHERE status = 'pending' AND (id // 12) % 3 = 2"),
)
def stream_open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still waits when only the lead has decided."""
    return J.open_requests(approval_events(spark, sf_dir, "approver = 'dashboard:lead'"))


@plan(
    "stream_activity_snapshot",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY ALL",
)
def stream_activity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, the open day included."""
    utc(spark)
    log = J.read_stream(spark, sf_dir, "events").selectExpr("event_type AS action", "ts AS created_at")
    return plain_time(J.activity_snapshots(log, scratch_path(spark, "activity")), "window_start")
