"""Structured Streaming forms of the operators.

Every job takes a streaming DataFrame and returns one; ``run_available`` drains what the
source holds now into a parquet sink, for catch-up runs and tests.  With a folder of its own a
later run goes on where the last one stopped and reads only what is new.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.operators.conversation import ENTRY, VAULT, redact_turns, user_turns
from cloakframe.operators.ledger import ledger_rows
from cloakframe.operators.responders import distinct_placeholders, gateway_reply
from cloakframe.rulebook import BUILT_IN, Rulebook
from cloakframe.session import materialise, scratch_path
from cloakframe.streaming.stateful import APPROVAL_OUT, SESSION_OUT, ApprovalMachine, SessionFollower

#: Requests whose ids agree but for so many low bits share a visit to the state store: 256 at most, whatever the ids are.
BLOCK_BITS = 8
# Timers and several states per key are held by this store only.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table of a folder as a stream, file by file; the table is one file, several of that name, or a folder of parts."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(f"{folder.rstrip('/')}/{table}*.parquet")


def spread(stream: DataFrame) -> DataFrame:
    """Deal the rows of a stream to every core before their texts are searched: a file of short rows is one split, however many rows it has."""
    return stream.repartition(stream.sparkSession.sparkContext.defaultParallelism)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that a query takes over when it starts, put back after."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(stream: DataFrame, name: str, state_partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """Process everything available into a table and read it back.

    With a ``folder`` its table and checkpoint stay, so another call reads only new files and adds to the table; without, the
    table lies in the shared folder.  State is kept in ``state_partitions`` parts, by default one per core: the number stays
    fixed for the life of a checkpoint, and every part is a store that each batch must open.
    """
    spark = stream.sparkSession
    target = f"{folder.rstrip('/')}/{name}" if folder else scratch_path(spark, name)
    parts = str(state_partitions or spark.sparkContext.defaultParallelism)
    with settings(spark, **{"spark.sql.shuffle.partitions": parts, "spark.sql.streaming.stateStore.providerClass": STATE_STORE}):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{target}-checkpoint")
            .option("path", target)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def screen_requests(requests: DataFrame, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Redact, decide and shape ledger records; stateless, so it appends as requests arrive."""
    return ledger_rows(requests, rules)


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What micro-batches before this one have stored."""
    if batch_id == 0:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < batch_id)


def redact_chat(messages: DataFrame, folder: str, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Conversation redaction over all messages available now; turns that come late are marked.

    A micro-batch is redacted as a batch, against the vault that earlier ones left for its conversations, and adds its
    turns and new vault values as parts of its own; a repeated micro-batch writes the same parts again.  With the
    same ``folder`` a later call goes on where the last one stopped.  The vault part holds clear values.
    """
    spark = messages.sparkSession
    turns_at, vault_at = f"{folder}/turns", f"{folder}/vault"
    schema = f"conv_id long, turn long, redacted string, protected_count long, entries {ENTRY}, late boolean"

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        turns = materialise(user_turns(batch).select("conv_id", "turn", "text"))
        # A stream turns adaptive execution off in its session; from the stored turns on all is plain tables, which are planned as elsewhere.
        with settings(session, **{"spark.sql.adaptive.enabled": adaptive}):
            fold(session, turns, batch_id)

    def fold(session: SparkSession, turns: DataFrame, batch_id: int) -> None:
        own = turns.select("conv_id").distinct()
        stored = _before(session, vault_at, VAULT, batch_id).join(own, "conv_id", "left_semi")
        # Values of earlier micro-batches come before all turns of this one, in the order of their arrival.
        known = stored.withColumn("first_at", F.least("first_at", F.lit((1 << 45) - 1)) + F.col("batch") * (1 << 45) - (1 << 62)).drop("batch")
        redacted, new = redact_turns(turns, materialise(known), rules)
        last = _before(session, turns_at, schema, batch_id).join(own, "conv_id", "left_semi").groupBy("conv_id").agg(F.max("turn").alias("last"))
        marked = redacted.join(last, "conv_id", "left").withColumn("late", F.coalesce(F.col("turn") <= F.col("last"), F.lit(False))).drop("last")
        new.select(*[f.split()[0] for f in VAULT.split(", ")]).write.mode("overwrite").parquet(f"{vault_at}/batch={batch_id}")
        marked.write.mode("overwrite").parquet(f"{turns_at}/batch={batch_id}")

    query = messages.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(turns_at).drop("batch")


def _timed(events: DataFrame, column: str, delay: str) -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def lockout_alerts(
    attempts: DataFrame, window_seconds: int = c.LOCK_WINDOW_SECONDS, threshold: int = c.LOCK_THRESHOLD, delay: str = "10 minutes",
) -> DataFrame:
    """Each failure that is at least the ``threshold``-th of its ip within the trailing window: ip, locked_at, since.

    The state of an ip is its last ``threshold - 1`` failure times, forgotten a window after the last one.  Rows later
    than ``delay`` are dropped; rows of a micro-batch are taken in the order of their time.
    """
    span = window_seconds * 1_000_000
    failed = _timed(attempts.where("success = 0 AND ip IS NOT NULL"), "at", delay).withColumn("us", F.unix_micros("at"))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out = []
        for moment in sorted(m for batch in batches for m in batch["us"].tolist()):
            recent.append(moment)
            recent = recent[-threshold:]
            if len(recent) == threshold and moment - recent[0] <= span:
                out.append((key[0], moment, recent[0]))
        recent = recent[-(threshold - 1):]
        state.update((recent,))
        state.setTimeoutTimestamp(max((recent[-1] + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["ip", "locked_us", "since_us"])

    kind = dict(failed.dtypes)["ip"]
    alerts = failed.select("ip", "at", "us").groupBy("ip").applyInPandasWithState(
        follow, f"ip {kind}, locked_us long, since_us long", "recent array<long>", "append", "EventTimeTimeout")
    return alerts.select("ip", F.timestamp_micros("locked_us").alias("locked_at"), F.timestamp_micros("since_us").alias("since"))


def idle_sessions(accesses: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sessions closed by a day without access."""
    timed = _timed(accesses, "seen_at", delay)
    idle = F.session_window("seen_at", f"{c.SESSION_IDLE_HOURS} hours")
    spans = timed.groupBy("token", idle.alias("w")).agg(F.count("*").alias("accesses"))
    return spans.select("token", F.col("w.start").alias("first_seen"), F.col("w.end").alias("idle_at"), "accesses")


def audit_activity(log: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Entries per action and window."""
    timed = _timed(log, "created_at", delay)
    counts = timed.groupBy(F.window("created_at", window).alias("w"), "action").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "action", "n")


def approval_queue(requests: DataFrame, decisions: DataFrame, patience: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """Each held request with the decision that came within ``patience``, or none."""
    held = _timed(requests, "created_at", delay).alias("r")
    made = _timed(decisions, "decided_at", delay).alias("d")
    match = F.expr(
        f"d.request_id = r.id AND d.decided_at >= r.created_at AND d.decided_at <= r.created_at + INTERVAL {patience}"
    )
    return held.join(made, match, "left_outer").select("r.id", "r.created_at", "d.verdict", "d.decided_at")


def session_states(accesses: DataFrame, sessions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What ``access_validity`` says about each access of a stream of (token, event_id, seen_at), as it comes, and the end of each session.

    ``sessions`` is where all begins: one row per token, a table.  Rows of kind ``access`` have the state of the session at that access.  A row of kind
    ``end`` comes once per session, from the access that finds it over or from a timer when the watermark passes its limit, with
    the moment it ended and why, the same either way.  Limits: the revocation, the hard expiry, a day without a valid access.
    Rows of a micro-batch are taken in the order of their time, then event_id; what comes later than ``delay`` is dropped.
    """
    timed = _timed(accesses, "seen_at", delay).withColumn("at_us", F.unix_micros("seen_at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begin = sessions.select(
        "token", F.coalesce(micros("last_seen_at"), micros("created_at")).alias("seen"), micros("expires_at").alias("expires"), micros("revoked_at").alias("revoked"))
    follower = SessionFollower(c.SESSION_IDLE_HOURS * 3_600_000_000)
    states = timed.select("token", "event_id", "at_us", "seen_at").groupBy("token").transformWithStateInPandas(
        follower, SESSION_OUT, "append", "EventTime", initialState=begin.groupBy("token"))
    return states.select("token", "event_id", F.timestamp_micros("at_us").alias("at"), "kind", "state")


def approval_events(ledger: DataFrame, decisions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests and decisions as one stream of events per request, each request settled once.

    ``ledger`` are ledger records as they come, ``decisions`` those of ``apply_approvals``.  Rows of kind ``opened`` name each request with the
    state it arrived in; rows of kind ``decided`` are the outcome of each decision as ``apply_approvals`` has it.  Decisions on a request
    follow each other in time, then by id; one that is taken first keeps its effect.  A decision may come before its request by
    ``delay``; after that it finds none.
    """
    prompt = F.col("prompt_redacted")
    held = F.when(F.col("status") == "pending", gateway_reply(prompt, distinct_placeholders(prompt)))
    asked = ledger.select(
        F.col("id").alias("request_id"), F.col("created_at").cast("timestamp").alias("at"), F.lit(None).cast("long").alias("decision_id"),
        *[F.lit(None).cast("string").alias(n) for n in ("verdict", "approver", "notes")], "status", "reason", held.alias("reply"))
    made = decisions.select(
        "request_id", F.col("decided_at").cast("timestamp").alias("at"), F.col("decision_id").cast("long"), "verdict", "approver", "notes",
        *[F.lit(None).cast("string").alias(n) for n in ("status", "reason", "reply")])
    events = asked.unionByName(made).withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))
    blocks = events.withColumn("block", F.shiftright("request_id", BLOCK_BITS)).groupBy("block")
    out = blocks.transformWithStateInPandas(ApprovalMachine(), APPROVAL_OUT, "append", "EventTime")
    approved = F.col("ok") & (F.col("verdict") == "approve")
    return out.select(
        "kind", "request_id", "decision_id", F.timestamp_micros("at_us").alias("at"), "verdict", "ok", "error", "status", "approver", "reason",
        F.when(approved, c.OFFLINE_PROVIDER).alias("provider"), F.when(approved, c.OFFLINE_MODEL).alias("model"), "output_redacted")


def open_requests(events: DataFrame) -> DataFrame:
    """The requests of an ``approval_events`` table that still wait for a decision: request_id, opened_at."""
    settled = events.where("kind = 'decided' AND ok").select("request_id")
    opened = events.where("kind = 'opened' AND status = 'pending'").select("request_id", F.col("at").alias("opened_at"))
    return opened.join(settled, "request_id", "left_anti")


def activity_snapshots(log: DataFrame, folder: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Entries per action and window over all there is, the open window included; the newest snapshot after what is available now.

    A micro-batch brings the counts that changed.  They replace those of the snapshot before and make the next, a table of one row per
    window and action under the number of the micro-batch; a repeated micro-batch makes the same snapshot again from
    the same one before.  With the same ``folder`` a later call goes on where the last one stopped.
    """
    spark = log.sparkSession
    schema = "window_start timestamp, action string, n long"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        older = session.createDataFrame([], schema) if batch_id == 0 else session.read.schema(schema).parquet(f"{folder}/snapshot={batch_id - 1}")
        fresh = materialise(batch)
        kept = older.join(fresh, (older.window_start == fresh.window_start) & older.action.eqNullSafe(fresh.action), "left_anti")
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{folder}/snapshot={batch_id}")

    counts = audit_activity(log, window, delay)
    parts = str(spark.sparkContext.defaultParallelism)
    with settings(spark, **{"spark.sql.shuffle.partitions": parts, "spark.sql.streaming.stateStore.providerClass": STATE_STORE}):
        query = (
            counts.writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    last = spark.read.schema(f"{schema}, snapshot long").parquet(folder)
    newest = last.agg(F.max("snapshot")).first()[0]
    return last.where(F.col("snapshot") == newest).drop("snapshot")
