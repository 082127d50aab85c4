"""Token files: one concatenated array of ids in doc_id order, with Elias-Fano coded document boundaries.

A folder of token files holds two tables, both written by Spark, so that any store Spark reaches will do and a repeated task
replaces what it wrote:

* ``pages``: shard, page, start (ids of the shard before the page), n_docs, n_null (documents at its head without an id), n_ids,
  ``doc_ids`` and ``ends`` (Elias-Fano codes of the document ids and of where each document ends in the page), ``ids`` (little-endian
  numbers of 16 bits, or of 32 where the vocabulary needs them).  A page holds whole documents, about ``PAGE_IDS`` ids of them; a longer
  document is a page of its own.
* ``shards``: shard, start (ids of all earlier shards), a row per task that wrote.  This is all that stands in 64 bits.

The ids of all pages in the order of shard and page are the whole array.  ``Page`` opens one page: ``document(i)`` selects two ends and
slices the ids, without decoding the others.

Texts are encoded once and stored by row; the ids, not the texts, are then range-partitioned by doc_id.

Defined cases: a null or empty text is its end mark alone; rows with a null doc_id come first; rows that repeat a doc_id follow each
other by length, checksum and place in the input, and a hot one is dealt over many shards; doc_ids are read as 64-bit numbers; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm.arrow_parts import slices
from cloakframe.llm.elias_fano import EliasFano
from cloakframe.llm.tokens import encoder
from cloakframe.session import materialise

PAGE_IDS = 1 << 18
PAGES = "shard int, page int, start long, n_docs int, n_null int, n_ids long, doc_ids binary, ends binary, ids binary"
SHARDS = "shard int, start long"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_type(path: str, end_id: int) -> str:
    """The smallest little-endian type that holds every id of a vocabulary."""
    largest = max([end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def encoded(documents: DataFrame, path: str, end_id: int, spaceless: bool) -> DataFrame:
    """Per row of the documents: doc_id, n_ids, check, ids (bytes)."""
    kind = id_type(path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, end_id, spaceless=spaceless)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = tokens.encode(batch.column("text").to_pylist())
                data, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((size * offsets).astype(np.int64)), pa.py_buffer(data)])
                checks = [zlib.crc32(data[size * a : size * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(checks, pa.int64()), blobs.cast(pa.binary())],
                    names=["doc_id", "n_ids", "check", "ids"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "doc_id long, n_ids long, check long, ids binary")


def pages_of(batch: pa.RecordBatch, page_ids: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch page by page, with the ids in each."""
    stops = np.cumsum(batch.column("n_ids").to_numpy())
    page = (stops - 1) // page_ids
    starts = [0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield int(stops[b - 1] - (stops[a - 1] if a else 0)), batch.slice(a, b - a)


def write(documents: DataFrame, folder: str, path: str, end_id: int = 2, spaceless: bool = False, page_ids: int = PAGE_IDS) -> None:
    """Encode all documents (doc_id, text) and write them as token files into ``folder``."""
    spark = documents.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for n_ids, rows in pages_of(batch, page_ids):
                named = rows.column("doc_id").drop_null().to_numpy()
                ends = np.cumsum(rows.column("n_ids").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([start], pa.int64()), pa.array([rows.num_rows], pa.int32()),
                     pa.array([rows.num_rows - len(named)], pa.int32()), pa.array([n_ids], pa.int64()), pa.array([EliasFano.of(named).to_bytes()], pa.binary()),
                     pa.array([EliasFano.of(ends).to_bytes()], pa.binary()), pa.array([b"".join(rows.column("ids").to_pylist())], pa.binary())],
                    names=[f.split()[0] for f in PAGES.split(", ")])
                page, start = page + 1, start + n_ids

    stored = materialise(encoded(documents, path, end_id, spaceless).withColumn("row", F.monotonically_increasing_id()))
    order = ["doc_id", "n_ids", "check", "row"]
    dealt = stored.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "n_ids", "ids").mapInArrow(pack, PAGES).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/pages")
    # One row per task that wrote: a running sum over them fits any task.
    sizes = pages(spark, folder).groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    starts.write.mode("overwrite").parquet(f"{folder}/shards")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(f"{folder}/pages")


@dataclass
class Page:
    """One page of a token file, opened without decoding it."""

    n_null: int
    doc_ids: EliasFano
    ends: EliasFano
    ids: np.ndarray

    @staticmethod
    def of(row) -> Page:
        kind = f"<u{len(row['ids']) // row['n_ids']}"
        return Page(row["n_null"], EliasFano.from_bytes(row["doc_ids"]), EliasFano.from_bytes(row["ends"]), np.frombuffer(row["ids"], kind))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.doc_ids[i - self.n_null]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def read(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Per document, from its files: doc_id, start, n_tokens, ids_crc32 (of ids of 32 bits), and ids if they are to be kept."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page = Page.of(row)
                ends = page.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                named = page.doc_ids.values()
                data = page.ids.astype("<u4").tobytes()
                checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                arrays = [
                    pa.concat_arrays([pa.nulls(page.n_null, pa.int64()), pa.array(named, pa.int64())]), pa.array(starts + row["before"] + row["start"]),
                    pa.array(ends - starts), pa.array(checks, pa.int64())]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(page.ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = FOUND + (", ids array<int>" if keep_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards").select("shard", F.col("start").alias("before"))
    # As many rows as tasks wrote: bounded by the number of partitions, not by the documents.
    return pages(spark, folder).join(F.broadcast(shards), "shard").mapInArrow(unpack, schema)
