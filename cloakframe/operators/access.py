"""Access analytics: roles, sessions, revocations, lockouts, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.operators.numbering import carry_last


def rank_of(role: Column) -> Column:
    """Rank of a role; a missing role is a viewer, an unknown one has rank 0."""
    chain = F.when(F.coalesce(role, F.lit("")) == "", c.ROLE_RANK["viewer"])
    for name, rank in c.ROLE_RANK.items():
        chain = chain.when(role == name, rank)
    return chain.otherwise(0)


def valid_role(role: Column) -> Column:
    """Stored roles that are not known read as admin."""
    return F.when(role.isin(*c.ROLE_RANK), role).otherwise("admin")


def rbac(requests: DataFrame) -> DataFrame:
    """Add ``allowed`` to (role, required) requests: the role's rank reaches the required one."""
    return requests.withColumn("allowed", rank_of(F.col("role")) >= rank_of(F.col("required")))


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


HOUR = 3_600_000_000


def access_validity(accesses: DataFrame, sessions: DataFrame, order: tuple[str, ...] = ("seen_at", "event_id")) -> DataFrame:
    """State of the session at each (token, seen_at) access: valid, expired, idle, revoked or unknown.

    Accesses of a token follow each other in ``order``.  A valid one moves the time the session was last seen; the first
    one past the hard expiry, or more than the idle limit after the last, ends the session and names why; all later ones
    find it revoked.  Both limits are strict, the hard expiry is tested first.

    Tokens are not gathered: accesses are range-partitioned by token and order, and the one before is carried over borders.
    """
    keyed = accesses.withColumn("here", F.struct("token", "seen_at"))
    # A token is the key of at most one session; hot tokens only repeat the access side.
    joined = carry_last(keyed, ["token", *order], "here", "before").drop("here").join(sessions, "token", "left")
    now = _micros(F.col("seen_at"))
    earlier = F.when(F.col("before.token") == F.col("token"), F.col("before.seen_at"))
    idle = now - _micros(F.coalesce(earlier, "last_seen_at", "created_at"))
    fault = (
        F.when(F.col("revoked_at") <= F.col("seen_at"), "revoked")
        .when(now > _micros(F.col("expires_at")), "expired")
        .when(idle > c.SESSION_IDLE_HOURS * HOUR, "idle")
    )
    judged = joined.withColumn("fault", fault).withColumn("place", F.struct(*order))
    # Up to the first fault every access was valid, so the one before is the one the session was last seen at.
    ends = judged.where("fault IS NOT NULL").groupBy("token").agg(F.min("place").alias("end"))
    state = (
        F.when(F.col("created_at").isNull(), "unknown")
        .when(F.col("end").isNull() | (F.col("place") < F.col("end")), "valid")
        .when(F.col("place") == F.col("end"), F.col("fault"))
        .otherwise("revoked")
    )
    out = judged.join(ends, "token", "left").withColumn("state", state).withColumn("role", valid_role(F.col("role")))
    return out.drop("before", "fault", "place", "end")


def list_sessions(sessions: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The most recently seen sessions with an 8-character id and whether they are active."""
    expired = F.coalesce(now > F.col("expires_at"), F.lit(False))
    return (
        sessions.orderBy(F.col("last_seen_at").desc(), "token")
        .limit(limit)
        .select(
            F.left("token", F.lit(8)).alias("id"),
            valid_role(F.col("role")).alias("role"),
            "expires_at",
            "created_at",
            "last_seen_at",
            "revoked_at",
            (F.col("revoked_at").isNull() & ~expired).alias("active"),
        )
    )


def revoke_by_prefix(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """For each ``prefix`` request the live session it ends, or null.

    Tokens are cut to the few prefix lengths that were asked for (listings show 8
    characters), so the match is an equi-join.  Of several matches the first token counts.
    """
    lengths = [r[0] for r in requests.select(F.length("prefix")).distinct().collect() if r[0]]
    live = sessions.where(F.col("revoked_at").isNull()).select(
        "token", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")
    )
    cut = live.where(F.length("token") >= F.col("n")).select(F.left("token", F.col("n")).alias("prefix"), "token")
    one = cut.groupBy("prefix").agg(F.min("token").alias("token"))
    joined = requests.join(one, "prefix", "left")
    error = F.when(F.col("token").isNull(), "Session not found or already revoked")
    return joined.withColumn("ok", F.col("token").isNotNull()).withColumn("error", error)


def session_end(sessions: DataFrame, credential_changes: DataFrame) -> DataFrame:
    """When each session ends: revocation, hard expiry, idle limit, or the first credential
    change after it began, whichever is first; and which one it was.

    Sessions find their next change on one time line, not by comparing all pairs.
    """
    idle = F.col("last_seen_at") + F.expr(f"INTERVAL {c.SESSION_IDLE_HOURS} HOURS")
    with_change = next_change(sessions, credential_changes)
    ends = F.array_sort(
        F.filter(
            F.array(
                F.struct(F.col("revoked_at").alias("at"), F.lit(0).alias("o"), F.lit("revoked").alias("why")),
                F.struct(F.col("expires_at").alias("at"), F.lit(1).alias("o"), F.lit("expired").alias("why")),
                F.struct(idle.alias("at"), F.lit(2).alias("o"), F.lit("idle").alias("why")),
                F.struct(F.col("changed_at").alias("at"), F.lit(3).alias("o"), F.lit("credential").alias("why")),
            ),
            lambda e: e["at"].isNotNull(),
        )
    )
    return (
        with_change.withColumn("ends", ends)
        .withColumn("end_at", F.col("ends")[0]["at"])
        .withColumn("end_reason", F.col("ends")[0]["why"])
        .drop("ends")
    )


def next_change(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Add ``changed_at``: the first change at or after ``created_at`` (a forward as-of lookup).

    Sessions and changes are merged on one time line, range-partitioned by time; the next
    change is carried backwards over range borders.
    """
    # Reversed time turns "next change" into "last change seen so far".
    marks = changes.select(F.col("changed_at"), (-_micros(F.col("changed_at"))).alias("key"), F.lit(0).alias("kind"))
    rows = sessions.select(F.col("token").alias("tok"), (-_micros(F.col("created_at"))).alias("key"), F.lit(1).alias("kind"))
    line = marks.unionByName(rows, allowMissingColumns=True).withColumn("tok", F.coalesce("tok", F.lit("")))
    carried = carry_last(line, ["key", "kind", "tok"], "changed_at", "next_at").where("kind = 1")
    found = carried.select(F.col("tok").alias("token"), F.col("next_at").alias("changed_at"))
    return sessions.join(found, "token", "left")


def trailing_failures(attempts: DataFrame, window_seconds: int = c.LOCK_WINDOW_SECONDS) -> DataFrame:
    """Add ``failed`` (failures of the ip in the window before this attempt) and ``locked``.

    The lock is asked for before the attempt is recorded, so an attempt does not count itself, nor others of its instant.

    An ip of any size is cut into windows of time: every row is counted in its own time
    bucket with the previous bucket's failures as lead-in, so no task holds a whole ip.
    Equal (ip, time) rows are merged before the shuffle.
    """
    span = window_seconds * 1_000_000
    moments = attempts.withColumn("at_us", _micros(F.col("at"))).withColumn("bucket", F.floor(F.col("at_us") / span))
    merged = moments.groupBy("ip", "bucket", "at_us").agg(F.sum(F.when(F.col("success") == 0, 1).otherwise(0)).alias("fails"))
    lead_in = merged.where("fails > 0").withColumn("bucket", F.col("bucket") + 1).withColumn("own", F.lit(False))
    both = merged.withColumn("own", F.lit(True)).unionByName(lead_in)
    trailing = Window.partitionBy("ip", "bucket").orderBy("at_us").rangeBetween(-span, -1)
    counted = both.withColumn("failed", F.coalesce(F.sum("fails").over(trailing), F.lit(0))).where("own")
    # An attempt without an ip finds no partner here and is never locked.
    out = moments.join(counted.select("ip", "bucket", "at_us", "failed"), ["ip", "bucket", "at_us"], "left")
    known = out.drop("bucket", "at_us").withColumn("failed", F.coalesce("failed", F.lit(0)))
    return known.withColumn("locked", F.col("failed") >= c.LOCK_THRESHOLD)


def delegation_expiry(requests: DataFrame) -> DataFrame:
    """Expiry of (issued_at, ttl_hours) requests: 24 hours by default, kept within 1..720."""
    hours = F.greatest(F.lit(1), F.least(F.lit(720), F.coalesce(F.nullif("ttl_hours", F.lit(0)), F.lit(24))))
    return requests.withColumn("hours", hours.cast("long")).withColumn(
        "expires_at", F.timestamp_add("HOUR", F.col("hours").cast("int"), F.col("issued_at"))
    )


def latest_settings(settings: DataFrame) -> DataFrame:
    """Last write wins per key."""
    return settings.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
