"""Hash chains that are built in parallel and appended to: one chain per key, and a hash tree over the heads of all chains.

A store is a folder of tables; every append adds a part (``batch=n``) to each of them:

* ``links``: the records of the part with chain, seq, prev_hash and hash.
* ``heads``: the state of all chains after the part: chain, position (its leaf in the tree), seq, hash.
* ``tree``: the nodes of the hash tree over those heads: level, position, hash.  ``FAN`` children make a node, ``LEVELS`` levels the root;
  places without a chain hold a fixed hash, so a leaf's place says that the chain did not exist before.
* ``segments``: per chain of the part its position; ``siblings``: the nodes of the earlier tree that stand beside changed ones.
* ``roots``: batch, root, n_chains, n_links, seal.  A seal covers the row and the seal before it.  This row is written last:
  a part without it does not exist, and the next append writes that part anew.

Chains are linked side by side: records are dealt by chain and sorted in their task, which holds one running hash.  A chain is
sequential by nature, so a key that holds much of the data should be given lanes (``chain_name``), each a chain of its own.

``verify_part`` reads a part and the roots, no earlier records: every hash must follow from its record, every link from the one before,
and the tree computed from the first previous hashes and the siblings must give the earlier root, from the last hashes and the same
siblings the later one.  So it also shows that no other chain was changed by the part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.catalogue import GENESIS
from cloakframe.functions.arrow_parts import slices
from cloakframe.operators.ledger import canonical_head, linked_hash
from cloakframe.operators.numbering import number_rows

FAN, LEVELS = 16, 7
AT_ONCE = 1 << 18  # bytes of canonical text that a task links at once
HEADS = "chain string, position long, seq long, hash string"
NODES = "level int, position long, hash string"
SEGMENTS = "chain string, position long"
ROOTS = "batch long, root string, n_chains long, n_links long, seal string"


def empty_nodes() -> list[str]:
    """The hash of a place without chains, by level; the last one is the root of no chains at all."""
    out = [hashlib.sha256(b"").hexdigest()]
    for _ in range(LEVELS):
        out.append(hashlib.sha256((out[-1] * FAN).encode()).hexdigest())
    return out


EMPTY = empty_nodes()


def chain_name(key: Column, record_id: Column, lanes: int = 1) -> Column:
    """The chain of a record: its key, and one of ``lanes`` lanes by its id, so that a hot key is many chains."""
    lane = F.pmod(F.xxhash64(record_id), F.lit(lanes)).cast("string")
    return F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), lane) if lanes > 1 else F.coalesce(key.cast("string"), F.lit(""))


def leaf(chain: Column, seq: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", chain, seq.cast("string"), digest), 256)


def sealed(before: Column, batch: Column, root: Column, n_chains: Column, n_links: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, batch, root, n_chains, n_links), 256)


def _part(spark: SparkSession, folder: str, table: str, batch: int, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{table}/batch={batch}")


def _write(df: DataFrame, folder: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch}")


def create(spark: SparkSession, folder: str) -> None:
    """An empty store: part 0, without links."""
    _write(spark.createDataFrame([], HEADS), folder, "heads", 0)
    _write(spark.createDataFrame([], NODES), folder, "tree", 0)
    first = spark.createDataFrame([(0, EMPTY[-1], 0, 0)], "batch long, root string, n_chains long, n_links long")
    _write(first.withColumn("seal", sealed(F.lit(GENESIS), *[F.col(c) for c in first.columns])), folder, "roots", 0)


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part that was completed."""
    return spark.read.schema(ROOTS).option("recursiveFileLookup", "true").parquet(f"{folder}/roots")


def heads(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """The head of every chain after a part, by default the last."""
    return _part(spark, folder, "heads", _last(spark, folder) if batch is None else batch, HEADS)


def links(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """The linked records of a part, or of all completed parts."""
    batches = [batch] if batch is not None else range(1, _last(spark, folder) + 1)
    parts = [f"{folder}/links/batch={b}" for b in batches]
    if not parts:
        raise ValueError("no part was appended yet")
    return spark.read.parquet(*parts)


def _last(spark: SparkSession, folder: str) -> int:
    return roots(spark, folder).agg(F.max("batch")).first()[0]


def _linked(records: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """The records with seq, prev_hash and hash, each chain from its start (chain, seq, hash)."""
    columns = records.columns
    out = StructType(list(records.schema)).add("seq", "long").add("prev_hash", "string").add("hash", "string")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, prev = None, 0, GENESIS
        for batch in (part for whole in batches for part in slices(whole, "_head", AT_ONCE)):
            numbers, prevs, hashes = [], [], []
            chains, heads_, begun = (batch.column(c).to_pylist() for c in ("chain", "_head", "_seq"))
            for chain, head, n in zip(chains, heads_, begun):
                if head is None:  # a chain's start comes before its records
                    current, seq, prev = chain, n, batch.column("_hash")[len(numbers)].as_py()
                elif chain != current:
                    current, seq, prev = chain, 0, GENESIS
                digest = None
                if head is not None:
                    digest = hashlib.sha256(f'{head}{prev}"}}'.encode()).hexdigest()
                    seq += 1
                numbers.append(seq), prevs.append(prev), hashes.append(digest)
                prev = digest or prev
            linked = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(numbers, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=out.names)
            yield linked.filter(pa.array([h is not None for h in hashes], pa.bool_()))

    rows = records.withColumn("_head", canonical_head())
    begin = starts.select("chain", F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
    both = rows.unionByName(begin, allowMissingColumns=True).withColumn("_first", F.col("_head").isNotNull())
    dealt = both.repartition("chain").sortWithinPartitions("chain", "_first", *order).drop("_first")
    return dealt.mapInArrow(link, out)


def _parents(nodes: DataFrame, level: int, values: list[str]) -> DataFrame:
    """The nodes above: ``FAN`` children each, the fixed hash where one is missing."""
    slot = (F.col("position") % FAN).cast("int")
    taken = [F.map_from_entries(F.collect_list(F.struct(slot, F.col(v)))).alias(v) for v in values]
    up = nodes.groupBy(F.expr(f"position DIV {FAN}").alias("position")).agg(*taken)

    def folded(held: str) -> Column:
        children = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(EMPTY[level])))
        return F.sha2(F.concat_ws("", children), 256)

    return up.select("position", *[folded(v).alias(v) for v in values])


def _grow(spark: SparkSession, folder: str, batch: int, state: DataFrame) -> str:
    """Write the tree over the heads level by level, each a sixteenth of the one below; the root."""
    rows = state.select(F.lit(0).alias("level"), "position", leaf(F.col("chain"), F.col("seq"), F.col("hash")).alias("hash"))
    for level in range(LEVELS + 1):
        at = f"{folder}/tree/batch={batch}/level={level}"
        rows.drop("level").write.mode("overwrite").parquet(at)
        below = spark.read.schema("position long, hash string").parquet(at)
        if level < LEVELS:
            rows = _parents(below, level, ["hash"])
    top = below.first()
    return top.hash if top else EMPTY[-1]


def tree(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{folder}/tree/batch={batch}")


def _touched(segments: DataFrame, level: int) -> DataFrame:
    return segments.select(F.expr(f"position DIV {FAN ** level}").alias("position")).distinct()


def _siblings(segments: DataFrame, old: DataFrame) -> DataFrame:
    """Nodes of the earlier tree that share a parent with a changed node and are not changed themselves."""
    parts = []
    for level in range(LEVELS):
        up = _touched(segments, level + 1).withColumnRenamed("position", "up")
        beside = old.where(F.col("level") == level).withColumn("up", F.expr(f"position DIV {FAN}")).join(up, "up", "left_semi")
        parts.append(beside.join(_touched(segments, level), "position", "left_anti").select("level", "position", "hash"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def append(records: DataFrame, folder: str, order: list[str]) -> int:
    """Link settled records (the ledger's columns and ``chain``) to their chains as one more part; its number.

    Records of a chain follow each other in ``order`` (not null, unique), after all records of earlier parts.  Building in several
    parts gives the same links, positions and root as building at once, if the parts follow each other in ``order``.
    """
    spark = records.sparkSession
    last = roots(spark, folder).orderBy(F.col("batch").desc()).first()
    batch = last.batch + 1
    state = _part(spark, folder, "heads", last.batch, HEADS)
    met = records.groupBy("chain").agg(F.min(F.struct(*order)).alias("first"))
    starts = met.join(state, "chain", "left")
    known = starts.where("position IS NOT NULL").select("chain", "position", "seq", "hash")
    fresh = number_rows(starts.where("position IS NULL").select("chain", "first"), [], ["first"], "n")
    fresh = fresh.select("chain", (F.col("n") - 1 + last.n_chains).alias("position"), F.lit(0).cast("long").alias("seq"), F.lit(GENESIS).alias("hash"))
    _write(known.unionByName(fresh), folder, "starts", batch)
    begun = _part(spark, folder, "starts", batch, HEADS)
    _write(_linked(records, begun, order), folder, "links", batch)
    added = links(spark, folder, batch)
    _write(begun.select("chain", "position"), folder, "segments", batch)
    ends = added.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash")).join(begun.select("chain", "position"), "chain")
    kept = state.join(begun.select("chain"), "chain", "left_anti")
    _write(kept.unionByName(ends.select("chain", "position", "seq", "hash")), folder, "heads", batch)
    segments = _part(spark, folder, "segments", batch, SEGMENTS)
    _write(_siblings(segments, tree(spark, folder, last.batch)), folder, "siblings", batch)
    after = _part(spark, folder, "heads", batch, HEADS)
    n_chains = after.count()
    if n_chains > FAN**LEVELS:
        raise ValueError(f"the tree has room for {FAN**LEVELS} chains")
    root = _grow(spark, folder, batch, after)
    row = spark.createDataFrame([(batch, root, n_chains, added.count())], "batch long, root string, n_chains long, n_links long")
    _write(row.withColumn("seal", sealed(F.lit(last.seal), *[F.col(c) for c in row.columns])), folder, "roots", batch)
    return batch


def verify_roots(rows: DataFrame) -> DataFrame:
    """Per part: batch, ok.  Its seal must follow from the row and from the seal before it; rows are as many as parts."""
    order = Window.orderBy("batch")
    before = F.coalesce(F.lag("seal").over(order), F.lit(GENESIS))
    follows = (F.col("batch") == F.coalesce(F.lag("batch").over(order) + 1, F.lit(0))) & (
        F.col("seal") == sealed(before, F.col("batch"), F.col("root"), F.col("n_chains"), F.col("n_links")))
    return rows.select("batch", follows.alias("ok"))


def verify_part(part: DataFrame, segments: DataFrame, siblings: DataFrame, ends: DataFrame, batch: int) -> DataFrame:
    """One row: batch, ok, n_links, n_chains, broken_at (id of the first unsound record by chain and seq), root_ok.

    ``part``, ``segments`` and ``siblings`` are the tables of the part, ``ends`` are the roots.
    """
    own = linked_hash(canonical_head(), F.col("prev_hash")) == F.col("hash")
    slim = part.select("chain", "seq", "id", "prev_hash", "hash", own.alias("own"))
    before = slim.select("chain", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before")).distinct()
    follows = F.col("before").isNull() | (F.col("before") == F.col("prev_hash"))
    checked = slim.join(before, ["chain", "seq"], "left").withColumn("sound", F.coalesce(F.col("own") & follows, F.lit(False)))
    first = F.min_by("id", F.when(~F.col("sound"), F.struct("chain", "seq")))
    found = checked.agg(F.count("*").alias("n_links"), first.alias("broken_at"), F.bool_and("sound").alias("sound"))
    runs = slim.groupBy("chain").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.min_by("prev_hash", "seq").alias("start"), F.max_by("hash", "seq").alias("end"))
    # A part of which links are missing leaves a gap in a chain, a chain without a place, or a place without a chain.
    whole = (F.col("high") - F.col("low") + 1 == F.col("n")) & F.col("position").isNotNull() & F.col("n").isNotNull()
    fresh = (F.col("low") == 1) & (F.col("start") == GENESIS)
    placed = runs.join(segments, "chain", "full").select(
        "position", whole.alias("whole"),
        F.when(fresh, EMPTY[0]).otherwise(leaf(F.col("chain"), F.col("low") - 1, F.col("start"))).alias("old"), leaf(F.col("chain"), F.col("high"), F.col("end")).alias("new"))
    entire = placed.agg(F.count("*").alias("n_chains"), F.bool_and("whole").alias("whole"))
    nodes = placed.where("position IS NOT NULL AND old IS NOT NULL AND new IS NOT NULL").select("position", "old", "new")
    for level in range(LEVELS):
        beside = siblings.where(F.col("level") == level).select("position", F.col("hash").alias("old"), F.col("hash").alias("new"))
        # A place given twice cannot be told apart by its hashes: one of them counts, and the roots decide.
        every = nodes.unionByName(beside).groupBy("position").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        nodes = _parents(every, level, ["old", "new"])
    reached = nodes.agg(F.max("old").alias("old"), F.max("new").alias("new"))
    root = lambda b: F.max(F.when(F.col("batch") == b, F.col("root")))
    stated = ends.agg(root(batch - 1).alias("root_before"), root(batch).alias("root_after"), F.max(F.when(F.col("batch") == batch, F.col("n_links"))).alias("stated_links"))
    row = found.crossJoin(entire).crossJoin(reached).crossJoin(stated)  # one row each
    unchanged = F.col("old").isNull() & (F.col("root_before") == F.col("root_after"))  # a part without links
    roots_ok = F.coalesce(unchanged | ((F.col("old") == F.col("root_before")) & (F.col("new") == F.col("root_after"))), F.lit(False))
    ok = F.coalesce("sound", F.lit(True)) & F.coalesce("whole", F.lit(True)) & roots_ok & (F.col("n_links") == F.col("stated_links"))
    return row.select(F.lit(batch).cast("long").alias("batch"), ok.alias("ok"), "n_links", "n_chains", "broken_at", roots_ok.alias("root_ok"))


def verify(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """``verify_part`` of a stored part."""
    segments, siblings = _part(spark, folder, "segments", batch, SEGMENTS), _part(spark, folder, "siblings", batch, NODES)
    return verify_part(links(spark, folder, batch), segments, siblings, roots(spark, folder), batch)


def proofs(spark: SparkSession, folder: str, chains: DataFrame, batch: int) -> DataFrame:
    """Per chain asked for that exists: chain, seq, hash and ``path``, by level the slot and the children of the node above."""
    asked = heads(spark, folder, batch).join(chains.select("chain").distinct(), "chain", "left_semi")
    steps = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.expr(f"position DIV {FAN ** (level + 1)}").alias("up"), F.expr(f"CAST(position DIV {FAN**level} % {FAN} AS INT)").alias("slot"))
        for level in range(LEVELS)]))
    wanted = asked.select("chain", "seq", "hash", steps.alias("s")).select("chain", "seq", "hash", "s.*")
    held = F.map_from_entries(F.collect_list(F.struct((F.col("position") % FAN).cast("int"), "hash"))).alias("held")
    groups = tree(spark, folder, batch).where(F.col("level") < LEVELS).groupBy("level", F.expr(f"position DIV {FAN}").alias("up")).agg(held)
    blank = F.element_at(F.array(*[F.lit(e) for e in EMPTY]), F.col("level") + 1)
    children = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.coalesce(F.try_element_at("held", i), blank))
    path = F.sort_array(F.collect_list(F.struct("level", "slot", children.alias("children")))).alias("path")
    return wanted.join(groups, ["level", "up"]).groupBy("chain", "seq", "hash").agg(path)


def proven(head: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from a leaf to the root; head is struct(chain, seq, hash).  Needs no table."""

    def climb(at: Column, step: Column) -> Column:
        fits = F.get(step["children"], step["slot"]) == at
        return F.when(fits, F.sha2(F.concat_ws("", step["children"]), 256)).otherwise("")

    reached = F.aggregate(path, leaf(head["chain"], head["seq"], head["hash"]), climb)
    return F.coalesce((F.size(path) == LEVELS) & (reached == root), F.lit(False))
