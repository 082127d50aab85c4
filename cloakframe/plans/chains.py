"""Keyed hash chains over the settled ledger: appended in two parts, verified part by part, with inclusion proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import chains as H
from cloakframe.plans.checksql import spaced
from cloakframe.plans.governance import CHAIN_CTES, PROMPTS, settled_ledger
from cloakframe.plans.registry import plan
from cloakframe.session import materialise, scratch_path

ORDER = ["settled_at", "id"]
#: Records settled before this moment make the first part, the others the second.
CUT = "2024-02-01 03:00:00"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled records, in chains by destination and the last digit of their id."""
    chain = F.concat_ws("/", "destination", F.col("id") % 10)
    return settled_ledger(spark, sf_dir).where("status <> 'pending'").withColumn("chain", chain)


def store(spark: SparkSession, sf_dir: str, parts: int = 2) -> str:
    folder = scratch_path(spark, "chains")
    rows = materialise(records(spark, sf_dir))
    early = F.col("settled_at") < F.lit(CUT).cast("timestamp_ntz")
    H.create(spark, folder)
    for part in [rows] if parts == 1 else [rows.where(early), rows.where(~early)]:
        H.append(part, folder, ORDER)
    return folder


# Each chain by itself, without parts: what two appends must come to.
KEYED = f"""keyed AS MATERIALIZED (
  SELECT h.id, h.head, s.settled_at, s.settled_at < TIMESTAMP '{CUT}' AS early, concat(s.destination, '/', h.id % 10) AS chain,
         row_number() OVER (PARTITION BY concat(s.destination, '/', h.id % 10) ORDER BY s.settled_at, h.id) AS seq
  FROM heads h JOIN settled s ON s.id = h.id),
linked AS MATERIALIZED (
  SELECT chain, seq, id, early, repeat('0', 64) AS prev_hash, sha256(concat(head, repeat('0', 64), '"}}')) AS hash FROM keyed WHERE seq = 1
  UNION ALL
  SELECT k.chain, k.seq, k.id, k.early, l.hash, sha256(concat(k.head, l.hash, '"}}')) FROM linked l JOIN keyed k ON k.chain = l.chain AND k.seq = l.seq + 1)"""


def tree_ctes() -> str:
    """The tree over the chains' heads after each part, one level after the other."""
    out = ["""places AS (SELECT chain, row_number() OVER (ORDER BY min({'t': settled_at, 'i': id})) - 1 AS position FROM keyed GROUP BY chain)""",
           """lvl0 AS MATERIALIZED (SELECT b, position, sha256(concat_ws('|', chain, seq, hash)) AS hash FROM (
  SELECT b, l.chain, max(seq) AS seq, arg_max(hash, seq) AS hash FROM linked l, (VALUES (1), (2)) AS parts(b) WHERE early OR b = 2 GROUP BY b, l.chain) JOIN places USING (chain))"""]
    for level in range(H.LEVELS):
        out.append(f"""lvl{level + 1} AS MATERIALIZED (SELECT u.b, u.up AS position, sha256(string_agg(coalesce(n.hash, '{H.EMPTY[level]}'), '' ORDER BY slot)) AS hash
  FROM (SELECT DISTINCT b, position // {H.FAN} AS up FROM lvl{level}) u CROSS JOIN range({H.FAN}) AS slots(slot)
  LEFT JOIN lvl{level} n ON n.b = u.b AND n.position = u.up * {H.FAN} + slot GROUP BY u.b, u.up)""")
    return ",\n".join(out)


CTES = [*CHAIN_CTES, KEYED]


@plan("chain_append", spaced(PROMPTS, CTES, "SELECT chain, seq, id, prev_hash, hash FROM linked"))
def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(spark, store(spark, sf_dir)).select("chain", "seq", "id", "prev_hash", "hash")


@plan(
    "chain_roots",
    spaced(PROMPTS, [*CTES, tree_ctes()], f"""SELECT CAST(0 AS BIGINT) AS batch, '{H.EMPTY[-1]}' AS root, CAST(0 AS BIGINT) AS n_chains, CAST(0 AS BIGINT) AS n_links
UNION ALL SELECT b, hash, (SELECT count(*) FROM lvl0 WHERE lvl0.b = t.b), (SELECT count(*) FROM linked WHERE early = (t.b = 1)) FROM lvl{H.LEVELS} t"""),
)
def chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.roots(spark, store(spark, sf_dir)).select("batch", "root", "n_chains", "n_links")


@plan(
    "chain_verify_parts",
    spaced(PROMPTS, CTES, """SELECT CAST(CASE WHEN early THEN 1 ELSE 2 END AS BIGINT) AS batch, TRUE AS ok, count(*) AS n_links, count(DISTINCT chain) AS n_chains,
CAST(NULL AS BIGINT) AS broken_at, TRUE AS root_ok FROM linked GROUP BY early"""),
)
def chain_verify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store(spark, sf_dir)
    return H.verify(spark, folder, 1).unionAll(H.verify(spark, folder, 2))


@plan(
    "chain_verify_tampered",
    spaced(PROMPTS, CTES, """SELECT 'edited' AS change, FALSE AS ok, count(*) AS n_links, arg_min(id, {'c': chain, 's': seq}) FILTER (id % 7 = 3) AS broken_at, TRUE AS root_ok FROM linked WHERE NOT early
UNION ALL SELECT 'cut short', FALSE, count(*) FILTER (seq < last), NULL, FALSE FROM (SELECT *, max(seq) OVER (PARTITION BY chain) AS last FROM linked) WHERE NOT early
UNION ALL SELECT 'linked anew', FALSE, count(*), NULL, FALSE FROM linked WHERE NOT early"""),
)
def chain_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second part after an edit, after the last link of each chain was removed, and linked again from edited records."""
    folder = store(spark, sf_dir)
    part = H.links(spark, folder, 2)
    segments, siblings = (H._part(spark, folder, t, 2, s) for t, s in (("segments", H.SEGMENTS), ("siblings", H.NODES)))
    edited = part.withColumn("actor", F.when(F.col("id") % 7 == 3, "someone else").otherwise(F.col("actor")))
    ends = part.groupBy("chain").agg(F.max("seq").alias("seq"))
    begun = H._part(spark, folder, "starts", 2, H.HEADS)
    again = H._linked(edited.drop("seq", "prev_hash", "hash"), begun, ORDER)
    changes = {"edited": edited, "cut short": part.join(ends, ["chain", "seq"], "left_anti"), "linked anew": materialise(again)}
    out = None
    for name, changed in changes.items():
        row = H.verify_part(changed, segments, siblings, H.roots(spark, folder), 2).select(F.lit(name).alias("change"), "ok", "n_links", "broken_at", "root_ok")
        out = row if out is None else out.unionAll(row)
    return out


@plan(
    "chain_proofs",
    spaced(PROMPTS, CTES, "SELECT chain, max(seq) AS seq, arg_max(hash, seq) AS hash, TRUE AS proven, FALSE AS altered FROM linked GROUP BY chain"),
)
def chain_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's head proven against the last root, and a head with another number refused."""
    folder = store(spark, sf_dir)
    found = H.proofs(spark, folder, H.heads(spark, folder), 2)
    root = H.roots(spark, folder).where("batch = 2").select("root")
    rows = found.crossJoin(root)  # one row
    head = lambda seq: F.struct(F.col("chain").alias("chain"), seq.alias("seq"), F.col("hash").alias("hash"))
    return rows.select(
        "chain", "seq", "hash", H.proven(head(F.col("seq")), F.col("path"), F.col("root")).alias("proven"),
        H.proven(head(F.col("seq") + 1), F.col("path"), F.col("root")).alias("altered"))
