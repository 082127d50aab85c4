"""Reversible line deduplication: sharded cuckoo filters backed by exact reference tables.

* ``line_references``: the exact table, one row per document and distinct line key (128-bit hash of the stripped,
  ASCII-lower-cased line), dealt into shards by hash.  Inserting documents is a union, deleting them an anti join.
* ``reference_counts``: per key the number of documents that hold it and the largest doc_id among them.
* ``shard_filters``: per shard a cuckoo filter of the keys found in at least ``min_docs`` documents.
  ``updated_filters`` inserts the keys that came over that bound and deletes those that fell below it.
* ``drop_repeated_lines``: a line's key is tried against its shard's filter; only keys that pass are looked up in
  the exact counts, so most lines, being unique, never reach that join.

Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines, except in the
document with the largest doc_id that holds them.  A hot line is one row per document and is counted by partial
aggregation, tried in salted parts and joined with a split side, so it never meets in one task.

Defined cases: a null or empty text is one empty line and stays so; null doc_ids name no document: they are not counted
and lose nothing; rows that repeat a doc_id are one document, and each row is cleaned; extra columns are kept as they are;
an empty table gives no rows.  Texts are read whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.llm.arrow_parts import slices
from cloakframe.llm.cuckoo import CuckooFilter
from cloakframe.llm.keyed_stream import leaders_first, salt_of, streamed
from cloakframe.session import materialise

REFS = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
PART_ROWS, KEYS_PER_SHARD = 50_000, 200_000


def lines_of(texts: pa.Array) -> tuple[list[int], pa.Array]:
    """Offsets per text and all lines (null texts as empty)."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return parts.offsets.to_pylist(), parts.flatten()


def keys_of(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim_whitespace(lines))


def halves(key: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key.encode())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def line_references(documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per document and distinct line key: doc_id, hi, lo."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, lines = lines_of(batch.column("text"))
                keys = keys_of(lines)
                long_enough = pc.greater_equal(pc.utf8_length(keys), min_chars).to_pylist()
                keys = keys.to_pylist()
                ids, high, low = [], [], []
                for doc_id, start, end in zip(batch.column("doc_id").to_pylist(), offsets, offsets[1:]):
                    found = {keys[i] for i in range(start, end) if long_enough[i]}
                    for hi, lo in map(halves, found):
                        ids.append(doc_id), high.append(hi), low.append(lo)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], schema=REFS)

    named = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(find, "doc_id long, hi long, lo long")


def without_documents(references: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The reference table after deleting documents."""
    return references.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def reference_counts(references: DataFrame) -> DataFrame:
    """Per key: hi, lo, n_docs, last_doc."""
    once = references.distinct().withColumn("one", F.lit(1))
    return once.groupBy("hi", "lo").agg(F.sum("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards).cast("long"))


def shard_filters(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard that holds a key: shard, filter (bytes).  A shard holds a bounded number of keys."""

    def build(rows: pa.Table) -> pa.Table:
        made = CuckooFilter.of(rows.column("hi").to_numpy(), rows.column("lo").to_numpy())
        return pa.table({"shard": rows.column("shard")[:1], "filter": pa.array([made.to_bytes()], pa.binary())})

    return keys.select(shard_of(shards).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(build, "shard long, filter binary")


def updated_filters(filters: DataFrame, inserted: DataFrame, deleted: DataFrame, shards: int) -> DataFrame:
    """The filters after keys came (``inserted``) and went (``deleted``); both have hi, lo."""

    def change(key: tuple, held: pa.Table, moves: pa.Table) -> pa.Table:
        high, low, comes = (moves.column(n).to_numpy() for n in ("hi", "lo", "comes"))
        cuckoo = CuckooFilter.from_bytes(held.column("filter")[0].as_py()) if held.num_rows else CuckooFilter(0)
        cuckoo.delete(high[comes == 0], low[comes == 0])
        if not cuckoo.insert(high[comes == 1], low[comes == 1]):
            raise ValueError(f"shard {key[0].as_py()} is full: build its filter anew with more shards")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([cuckoo.to_bytes()], pa.binary())})

    moves = inserted.select("hi", "lo", F.lit(1).alias("comes")).unionAll(deleted.select("hi", "lo", F.lit(0).alias("comes")))
    moves = moves.select(shard_of(shards).alias("shard"), "hi", "lo", "comes")
    return filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(change, "shard long, filter binary")


def passing(references: DataFrame, filters: DataFrame, shards: int, parts: int) -> DataFrame:
    """The references whose key passes its shard's filter.  Each shard is read in ``parts`` salted parts."""

    def test(cuckoo, rows: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows.select(REFS.names)
        return rows.filter(pa.array(cuckoo.contains(rows.column("hi").to_numpy(), rows.column("lo").to_numpy())))

    count = F.lit(parts).cast("long").alias("parts")
    tried = references.select(shard_of(shards).alias("shard"), *REFS.names, count).withColumn("_salt", salt_of("doc_id", parts="parts"))
    stream = leaders_first(filters.select("shard", "filter", count), tried, ["shard"], "parts")
    lead = lambda rows: CuckooFilter.from_bytes(rows.column("filter")[0].as_py())
    return stream.mapInArrow(streamed(["shard"], REFS, lead, test), "doc_id long, hi long, lo long")


def lines_to_drop(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document that loses lines: doc_id, drops (array of hi, lo)."""
    references = materialise(line_references(documents, min_chars))
    counts = materialise(reference_counts(references).where(F.col("n_docs") >= min_docs))
    rows, keys = references.count(), counts.count()
    shards, parts = 1 + keys // KEYS_PER_SHARD, 1 + rows // PART_ROWS
    candidates = passing(references, shard_filters(counts, shards), shards, -(-parts // shards))
    hits = candidates.join(counts, ["hi", "lo"]).where("doc_id <> last_doc")
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))


def drop_repeated_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents with their text cleaned, and n_lines (before dropping) and n_dropped."""
    columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "drops")]
    plain = documents.select(*[F.col(c).cast("string") if c == "text" else F.col(c) for c in columns])
    drops = lines_to_drop(plain, min_chars, min_docs)
    joined = plain.join(drops.withColumnRenamed("doc_id", "drop_doc"), F.col("doc_id").cast("long") == F.col("drop_doc"), "left").drop("drop_doc")
    out = StructType(list(plain.schema)).add("n_lines", "long").add("n_dropped", "long")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, lines = lines_of(batch.column("text"))
                texts, dropped = batch.column("text").to_pylist(), [0] * batch.num_rows
                for row, drop in enumerate(batch.column("drops").to_pylist()):
                    if drop:
                        gone = {(d["hi"], d["lo"]) for d in drop}
                        own = lines.slice(offsets[row], offsets[row + 1] - offsets[row])
                        kept = [x for x, k in zip(own.to_pylist(), keys_of(own).to_pylist()) if len(k) < min_chars or halves(k) not in gone]
                        texts[row], dropped[row] = "\n".join(kept), len(own) - len(kept)
                counts = np.diff(np.asarray(offsets, dtype=np.int64))
                arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(clean, out)

