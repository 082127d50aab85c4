"""Audit log, sessions, lockouts and settings over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.operators import access as A
from cloakframe.operators import audit as Q
from cloakframe.plans.checksql import spaced
from cloakframe.plans.registry import plan
from cloakframe.sources.views import load

AUDIT = ["audit_log"]
WINDOW = Q.AuditFilter(since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
IN_WINDOW = "created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "audit_log")


@plan(
    "audit_query",
    spaced(AUDIT, [], f"SELECT id, actor, action, meta, created_at FROM audit_log WHERE action = 'error' AND {IN_WINDOW} ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 10"),
)
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = Q.AuditFilter(action="error", since=WINDOW.since, until=WINDOW.until)
    return Q.query_audit(audit_log(spark, sf_dir), where, offset=10).select("id", "actor", "action", "meta", "created_at")


@plan("audit_count", spaced(AUDIT, [], f"SELECT count(*) AS n FROM audit_log WHERE {IN_WINDOW}"))
def audit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count_audit(audit_log(spark, sf_dir), WINDOW)


@plan("audit_summary", spaced(AUDIT, [], f"SELECT action, count(*) AS n FROM audit_log WHERE {IN_WINDOW} GROUP BY action ORDER BY n DESC, action"))
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summarise_audit(audit_log(spark, sf_dir), WINDOW)


@plan(
    "audit_append_projection",
    """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE concat('user', user_id) END AS actor, event_type AS action,
CASE WHEN user_id % 3 <> 0 THEN 'dashboard' END AS target, CASE WHEN value > 10 THEN CAST(json_object('user', user_id, 'type', event_type) AS VARCHAR) END AS meta,
CASE WHEN user_id % 2 = 0 THEN '10.0.0.1' END AS ip, CAST(NULL AS VARCHAR) AS user_agent FROM events""",
)
def audit_append_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("user"), F.col("user_id"))).alias("actor"),
        F.col("event_type").alias("action"),
        F.when(F.col("user_id") % 3 != 0, "dashboard").otherwise("").alias("target"),
        F.when(F.col("value") > 10, F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("meta"),
        F.when(F.col("user_id") % 2 == 0, "10.0.0.1").alias("ip"),
        F.lit("").alias("user_agent"),
    )
    return Q.audit_entries(entries, keep=["event_id"])


@plan(
    "audit_meta",
    "SELECT id, CASE WHEN id % 9 = 0 THEN concat('{', props) WHEN id % 10 = 0 THEN NULL ELSE CAST(json(props) AS VARCHAR) END AS meta FROM (SELECT event_id AS id, props FROM events)",
)
def audit_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("id") % 9 == 0, F.concat(F.lit("{"), F.col("meta"))).when(F.col("id") % 10 != 0, F.col("meta")).otherwise("")
    return audit_log(spark, sf_dir).select("id", Q.parsed_or_raw(raw).alias("meta"))


@plan("actor_label", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'dashboard' ELSE concat('dashboard:', event_type) END AS actor FROM events")
def actor_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", Q.actor_label(label).alias("actor"))


@plan(
    "client_ip",
    "SELECT event_id, CASE CAST(user_id % 3 AS INT) WHEN 0 THEN concat('10.1.0.', user_id % 256) WHEN 1 THEN concat('10.2.0.', user_id % 256) ELSE '' END AS ip FROM events",
)
def client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, low = F.col("user_id") % 3, (F.col("user_id") % 256).cast("string")
    forwarded = F.when(kind == 0, F.concat(F.lit("  10.1.0."), low, F.lit(" , 192.168.0.1")))
    direct = F.when(kind == 1, F.concat(F.lit("10.2.0."), low))
    return load(spark, sf_dir, "events").select("event_id", Q.client_ip(forwarded, direct).alias("ip"))


@plan(
    "login_lockout",
    spaced(["auth_attempts"], [], f"""SELECT id, ip, failed, failed >= {c.LOCK_THRESHOLD} AS locked FROM (
SELECT id, ip, CAST(coalesce(sum(1 - success) OVER (PARTITION BY ip ORDER BY "at" RANGE BETWEEN INTERVAL {c.LOCK_WINDOW_SECONDS} SECONDS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS failed FROM auth_attempts)"""),
)
def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trailing_failures(load(spark, sf_dir, "auth_attempts")).select("id", "ip", "failed", "locked")


@plan(
    "login_lockout_day",
    spaced(["auth_attempts"], [], f"""SELECT id, ip, failed, failed >= {c.LOCK_THRESHOLD} AS locked FROM (
SELECT id, ip, CAST(coalesce(sum(1 - success) OVER (PARTITION BY ip ORDER BY "at" RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS failed FROM auth_attempts)"""),
)
def login_lockout_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trailing_failures(load(spark, sf_dir, "auth_attempts"), 86_400).select("id", "ip", "failed", "locked")


@plan(
    "rbac_decisions",
    f"""SELECT event_id, role, required, r1 >= r2 AS allowed FROM (
SELECT *, CASE coalesce(role, 'viewer') WHEN 'admin' THEN 40 WHEN 'operator' THEN 30 WHEN 'auditor' THEN 20 WHEN 'viewer' THEN 10 ELSE 0 END AS r1,
CASE required WHEN 'admin' THEN 40 WHEN 'operator' THEN 30 WHEN 'auditor' THEN 20 ELSE 10 END AS r2 FROM (
SELECT event_id, CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'auditor' WHEN 3 THEN 'viewer' WHEN 4 THEN 'bogus' END AS role,
CASE event_type WHEN 'purchase' THEN 'admin' WHEN 'click' THEN 'operator' WHEN 'view' THEN 'auditor' ELSE 'viewer' END AS required FROM events))""",
)
def rbac_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE user_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'auditor' WHEN 3 THEN 'viewer' WHEN 4 THEN 'bogus' END AS role",
        "CASE event_type WHEN 'purchase' THEN 'admin' WHEN 'click' THEN 'operator' WHEN 'view' THEN 'auditor' ELSE 'viewer' END AS required",
    )
    return A.rbac(requests)


# The first access that finds the session over names the reason; all later ones of the token find it revoked.
STATE = """CASE WHEN created_at IS NULL THEN 'unknown' WHEN nr < first_nr OR first_nr IS NULL THEN 'valid' WHEN nr = first_nr THEN fault ELSE 'revoked' END"""
FAULTS = """faults AS (SELECT *, CASE WHEN revoked_at <= seen_at THEN 'revoked' WHEN seen_at > expires_at THEN 'expired'
    WHEN seen_at - coalesce(prior, last_seen_at, created_at) > INTERVAL 24 HOURS THEN 'idle' END AS fault
  FROM (SELECT *, lag(seen_at) OVER (PARTITION BY token ORDER BY seen_at, event_id) AS prior, row_number() OVER (PARTITION BY token ORDER BY seen_at, event_id) AS nr
        FROM accesses) a LEFT JOIN (SELECT token AS tok, * EXCLUDE (token) FROM sessions) s ON s.tok = a.token)"""


@plan(
    "session_validity",
    spaced(["sessions"], ["""accesses AS (SELECT event_id, concat('tok', lpad(CAST(CASE WHEN event_id % 11 = 0 THEN 99999 ELSE user_id END AS VARCHAR), 5, '0')) AS token,
ts + INTERVAL 2 DAY AS seen_at FROM events)""", FAULTS],
           f"""SELECT event_id, token, {STATE} AS state, CASE WHEN role IN ('admin', 'operator', 'auditor', 'viewer') THEN role ELSE 'admin' END AS role
FROM (SELECT *, min(CASE WHEN fault IS NOT NULL THEN nr END) OVER (PARTITION BY token) AS first_nr FROM faults)"""),
)
def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = load(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('tok', lpad(CAST(CASE WHEN event_id % 11 = 0 THEN 99999 ELSE user_id END AS STRING), 5, '0')) AS token",
        "ts + INTERVAL 2 DAYS AS seen_at",
    )
    checked = A.access_validity(accesses, load(spark, sf_dir, "sessions"))
    return checked.select("event_id", "token", "state", "role")


@plan(
    "session_listing",
    spaced(["sessions"], [], f"""SELECT left(token, 8) AS id, CASE WHEN role IN ('admin', 'operator', 'auditor', 'viewer') THEN role ELSE 'admin' END AS role,
expires_at, created_at, last_seen_at, revoked_at, revoked_at IS NULL AND NOT coalesce({NOW} > expires_at, FALSE) AS active
FROM sessions ORDER BY last_seen_at DESC, token LIMIT 100"""),
)
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.list_sessions(load(spark, sf_dir, "sessions"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))


@plan(
    "revoke_by_prefix",
    spaced(["sessions"], [], """SELECT DISTINCT r.prefix, s.token, s.token IS NOT NULL AS ok, CASE WHEN s.token IS NULL THEN 'Session not found or already revoked' END AS error
FROM (SELECT DISTINCT concat('tok', lpad(CAST(user_id * 2 AS VARCHAR), 5, '0')) AS prefix FROM events) r
LEFT JOIN sessions s ON left(s.token, 8) = r.prefix AND s.revoked_at IS NULL"""),
)
def revoke_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "events").selectExpr("concat('tok', lpad(CAST(user_id * 2 AS STRING), 5, '0')) AS prefix").distinct()
    return A.revoke_by_prefix(load(spark, sf_dir, "sessions"), requests).select("prefix", "token", "ok", "error")


@plan(
    "session_end",
    spaced(["sessions"], ["changes AS (SELECT ts AS changed_at FROM events WHERE event_type = 'signup')"],
           """SELECT token, end_at, CASE WHEN end_at = revoked_at THEN 'revoked' WHEN end_at = expires_at THEN 'expired' WHEN end_at = idle THEN 'idle' ELSE 'credential' END AS end_reason
FROM (SELECT *, least(revoked_at, expires_at, idle, changed_at) AS end_at FROM (
  SELECT token, revoked_at, expires_at, last_seen_at + INTERVAL 24 HOURS AS idle, (SELECT min(changed_at) FROM changes WHERE changed_at >= created_at) AS changed_at FROM sessions))"""),
)
def session_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = load(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("ts").alias("changed_at"))
    return A.session_end(load(spark, sf_dir, "sessions"), changes).select("token", "end_at", "end_reason")


@plan(
    "delegation_expiry",
    """SELECT event_id, CAST(hours AS BIGINT) AS hours, ts + to_hours(hours) AS expires_at FROM (
SELECT event_id, ts, greatest(1, least(720, coalesce(nullif(t, 0), 24))) AS hours FROM (
SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 900 - 50 END AS t FROM events))""",
)
def delegation_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS issued_at", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 900 - 50 END AS ttl_hours"
    )
    return A.delegation_expiry(requests).select("event_id", "hours", "expires_at")


@plan("latest_settings", spaced(["settings"], [], "SELECT key, arg_max(value, seq) AS value FROM settings GROUP BY key"))
def latest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_settings(load(spark, sf_dir, "settings"))
