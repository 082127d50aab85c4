"""The request ledger: rows, approvals, hash chain, verification and views."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.catalogue import GENESIS, OFFLINE_MODEL, OFFLINE_PROVIDER
from cloakframe.functions.redaction import distinct_classes, entity_summary, top_sensitivity, with_redaction
from cloakframe.functions.text import clean_text
from cloakframe.operators.numbering import carry_last, number_rows
from cloakframe.operators.policy import decide, status_of
from cloakframe.operators.responders import distinct_placeholders, gateway_reply
from cloakframe.rulebook import BUILT_IN, Rulebook
from cloakframe.session import scratch_path

# --- fixed values: hashed fields in their fixed order; the previous hash comes last ---
HASHED_FIELDS = (
    "id", "created_at", "actor", "role", "destination", "decision", "status", "sensitivity", "classes",
    "prompt_redacted", "entities", "output_redacted", "approver",
)
ENTITY_SCHEMA = "array<struct<placeholder:string,type:string,cls:string,sensitivity:string,label:string,masked:string>>"


def assess(requests: DataFrame, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Redact each request text and decide what may happen to it."""
    texts = requests.withColumn("text", clean_text(F.col("text"))).where(F.col("text") != "")
    seen = (
        with_redaction(texts, detectors=rules.detectors)
        .withColumn("class_list", distinct_classes(F.col("entities")))
        .withColumn("sensitivity", top_sensitivity(F.col("entities")))
    )
    return decide(seen, "destination", "sensitivity", "class_list", rules)


def ledger_rows(requests: DataFrame, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Ledger records for (id, created_at, actor, role, destination, text) requests.

    The destination is stored as it was asked for; only the decision normalises it.
    Held and blocked requests have no model output.
    """
    allowed = F.col("decision") == "allow"
    reply = gateway_reply(F.col("redacted"), distinct_placeholders(F.col("redacted")))
    return assess(requests, rules).select(
        "id",
        "created_at",
        "actor",
        "role",
        "destination",
        F.when(allowed, OFFLINE_PROVIDER).alias("provider"),
        F.when(allowed, OFFLINE_MODEL).alias("model"),
        F.col("redacted").alias("prompt_redacted"),
        F.to_json(entity_summary(F.col("entities"))).alias("entities"),
        F.to_json("class_list").alias("classes"),
        "sensitivity",
        "decision",
        status_of(F.col("decision")).alias("status"),
        "reason",
        F.lit(None).cast("string").alias("approver"),
        F.when(allowed, reply).alias("output_redacted"),
    )


def apply_approvals(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of each (request_id, decision_id, decided_at, verdict, approver, notes) decision against the ledger.

    One row per decision: ``ok``, ``error`` and, when it took effect, the new record state.  Of several decisions on
    a held request the first in time (then by decision_id) takes effect; the others find it settled and say so.
    """
    turn = F.struct("decided_at", "decision_id")
    first = decisions.groupBy("request_id").agg(F.min_by("verdict", turn).alias("first_verdict"), F.min(turn).alias("first"))
    held = ledger.select(
        F.col("id").alias("request_id"), "status", "reason", "prompt_redacted", F.lit(True).alias("found")
    )
    joined = decisions.join(held, "request_id", "left").join(first, "request_id", "left").withColumn("late", turn != F.col("first"))
    settled_as = F.when(F.col("first_verdict") == "approve", "completed").otherwise("rejected")
    joined = joined.withColumn("status", F.when((F.col("status") == "pending") & F.col("late"), settled_as).otherwise(F.col("status")))
    takes = F.col("found") & (F.col("status") == "pending")
    approve = takes & (F.col("verdict") == "approve")
    reject = takes & (F.col("verdict") == "reject")
    prompt = F.col("prompt_redacted")
    error = F.when(F.col("found").isNull(), "Request not found").when(
        F.col("status") != "pending", F.concat(F.lit("Request is '"), "status", F.lit("', not pending"))
    )
    return joined.select(
        "request_id",
        "decision_id",
        "decided_at",
        "verdict",
        F.coalesce(takes, F.lit(False)).alias("ok"),
        error.alias("error"),
        F.when(approve, "completed").when(reject, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(takes, F.col("approver")).alias("approver"),
        F.when(reject, F.coalesce(F.nullif("notes", F.lit("")), "reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(approve, OFFLINE_PROVIDER).alias("provider"),
        F.when(approve, OFFLINE_MODEL).alias("model"),
        F.when(approve, gateway_reply(prompt, distinct_placeholders(prompt))).alias("output_redacted"),
    )


def settle(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after approvals, with ``phase`` (0 settled on arrival, 1 settled by a person) and ``settled_at``."""
    done = outcomes.where("ok").select(
        F.col("request_id").alias("id"),
        *[F.col(c).alias(f"new_{c}") for c in ("status", "approver", "reason", "provider", "model", "output_redacted")],
        F.lit(1).alias("phase"),
        F.col("decided_at").alias("settled_at"),
    )
    joined = ledger.join(done, "id", "left")
    for column in ("status", "approver", "reason", "provider", "model", "output_redacted"):
        joined = joined.withColumn(
            column, F.when(F.col("phase") == 1, F.col(f"new_{column}")).otherwise(F.col(column))
        ).drop(f"new_{column}")
    moment = F.coalesce("settled_at", F.col("created_at").cast("timestamp_ntz"))
    return joined.withColumn("phase", F.coalesce("phase", F.lit(0))).withColumn("settled_at", moment)


def canonical_head() -> Column:
    """Canonical JSON of a record up to, not including, the previous hash."""
    classes = F.array_sort(F.from_json(F.coalesce("classes", F.lit("[]")), "array<string>"))
    values = {
        "classes": classes,
        "output_redacted": F.nullif("output_redacted", F.lit("")),
        "approver": F.nullif("approver", F.lit("")),
    }
    fields = [values.get(name, F.col(name)).alias(name) for name in HASHED_FIELDS]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"prev_hash":"'))


def linked_hash(head: Column, prev: Column) -> Column:
    return F.sha2(F.concat(head, prev, F.lit('"}')), 256)


def _hash_run(heads: pd.Series, prev: str) -> tuple[list[str], list[str]]:
    prevs, hashes = [], []
    for head in heads:
        prevs.append(prev)
        prev = hashlib.sha256(f'{head}{prev}"}}'.encode()).hexdigest()
        hashes.append(prev)
    return prevs, hashes


def _linker(start: str):
    def link(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("seq")
        prevs, hashes = _hash_run(block["head"], start)
        return block.drop(columns="head").assign(prev_hash=prevs, hash=hashes)

    return link


def _final(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") != "pending").withColumn("head", canonical_head())


def _blocks(final: DataFrame, order: list[str], block_rows: int) -> DataFrame:
    """Order, canonical text, dense number and block of each record; nothing else is shuffled."""
    numbered = number_rows(final.select(*order, "head"), [], order, "seq")
    return numbered.withColumn("block", F.floor((F.col("seq") - 1) / block_rows))


def _links_schema(blocks: DataFrame) -> str:
    fields = [f"`{name}` {kind}" for name, kind in blocks.dtypes if name != "head"]
    return ", ".join([*fields, "prev_hash string", "hash string"])


def build_chain(ledger: DataFrame, order: list[str], block_rows: int = 200_000) -> DataFrame:
    """One hash chain over all settled records, in ``order``.

    A chain is sequential by nature: record n needs the hash of record n-1.  The canonical
    text, the dear part, is made in parallel; linking then goes block by block, each block
    one bounded task, and only the last hash moves from block to block.  Use
    ``build_chain_blocks`` where independent blocks are enough.
    """
    spark = ledger.sparkSession
    final = _final(ledger)
    blocks = _blocks(final, order, block_rows)
    path = scratch_path(spark, "chain")
    blocks.repartition("block").write.partitionBy("block").parquet(f"{path}/heads")
    heads = spark.read.schema(blocks.schema).parquet(f"{path}/heads")
    schema = _links_schema(blocks)
    last_block = heads.agg(F.max("block")).first()[0]
    prev = GENESIS
    for block in range(0 if last_block is None else last_block + 1):
        part = heads.where(F.col("block") == block).groupBy("block").applyInPandas(_linker(prev), schema)
        target = f"{path}/links/part={block}"
        part.write.mode("overwrite").parquet(target)
        prev = spark.read.schema(schema).parquet(target).agg(F.max_by("hash", "seq")).first()[0]
    if last_block is None:
        links = spark.createDataFrame([], schema)
    else:
        links = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(f"{path}/links")
    return final.join(links.drop("block"), order)


def build_chain_blocks(ledger: DataFrame, order: list[str], block_rows: int = 200_000) -> DataFrame:
    """Independent chains, one per block of ``block_rows`` records, all linked in parallel."""
    final = _final(ledger)
    blocks = _blocks(final, order, block_rows)
    links = blocks.groupBy("block").applyInPandas(_linker(GENESIS), _links_schema(blocks))
    return final.join(links.drop("block"), order)


def verify_chain(chained: DataFrame, order: list[str]) -> DataFrame:
    """One row: ``ok``, ``total``, ``broken_at``, ``message``.

    A record is sound when its hash follows from its fields and its own previous hash, which
    needs no other row, and that previous hash is the one its predecessor stores.  Only keys
    and hashes are shuffled, and all ranges are checked in parallel.
    """
    prev = F.coalesce("prev_hash", F.lit(GENESIS))
    own = linked_hash(canonical_head(), prev) == F.col("hash")
    rows = chained.where(F.col("hash").isNotNull())
    slim = rows.select(*dict.fromkeys(["id", *order]), "hash", prev.alias("prev"), own.alias("own"))
    stored = carry_last(slim, order, "hash", "stored_prev")
    bad = ~F.col("own") | (F.col("prev") != F.coalesce("stored_prev", F.lit(GENESIS)))
    found = stored.agg(F.count("*").alias("total"), F.min_by("id", F.when(bad, F.struct(*order))).alias("broken_at"))
    message = (
        F.when(
            F.col("broken_at").isNotNull(),
            F.concat(
                F.lit("Integrity check FAILED at record #"),
                F.col("broken_at").cast("string"),
                F.lit(" — the audit log has been altered."),
            ),
        )
        .when(F.col("total") == 0, "No records yet.")
        .otherwise(
            F.concat(
                F.lit("Verified "),
                F.col("total").cast("string"),
                F.lit(" records — chain intact, no tampering detected."),
            )
        )
    )
    return found.select(F.col("broken_at").isNull().alias("ok"), "total", "broken_at", message.alias("message"))


def public_view(ledger: DataFrame) -> DataFrame:
    """Ledger records with the JSON columns parsed."""
    return ledger.withColumn("entities", F.from_json(F.coalesce("entities", F.lit("[]")), ENTITY_SCHEMA)).withColumn(
        "classes", F.from_json(F.coalesce("classes", F.lit("[]")), "array<string>")
    )


def latest(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest records first, 50 unless another page size is asked for."""
    return ledger.orderBy(F.col("id").desc()).limit(max(limit or 50, 1))


def latest_rows(requests: DataFrame, limit: int | None = None, before: int | None = None, rules: Rulebook = BUILT_IN) -> DataFrame:
    """A page of ``ledger_rows``, newest first, straight from the requests.

    The page is chosen by id before any text is searched.  ``before`` is the last id of the page above, so a later page costs
    what the first one does.
    """
    kept = requests.where(clean_text(F.col("text")) != "")
    kept = kept if before is None else kept.where(F.col("id") < before)
    return latest(ledger_rows(latest(kept, limit), rules), limit)


def by_id(ledger: DataFrame, request_id: int) -> DataFrame:
    return ledger.where(F.col("id") == request_id)

