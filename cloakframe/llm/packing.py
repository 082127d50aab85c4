"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity.

``pieces`` tokenises whole texts and cuts only those longer than the capacity, the first piece being the short one.
``pack`` puts pieces into bins: each goes where the squares of the numbers of open bins per residual gap sum up to least
afterwards (ties: the smaller gap, an open bin before a new one).  The rule reads counts per gap only, so a step costs the
capacity and not the number of bins.  It runs on groups of about ``GROUP`` pieces, many at once; what lies in
bins that stayed under ``CLOSED`` of the capacity is packed again in fewer groups.  The last round, by falling length, is the one
that fits a group, or the one after a round that brought more than half of its pieces back (few pieces fit together).

Defined cases: a null or empty text is its end mark alone; null doc_ids are packed like others; rows that repeat an id are
pieces of their own; only doc_id and text are read of the input; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.llm.arrow_parts import slices
from cloakframe.llm.tokens import encoder
from cloakframe.session import materialise

GROUP, CLOSED = 100_000, 0.95
PARTS = 300_000  # word parts kept per Python worker, some 60 MB


def pieces(documents: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if they are to be kept."""
    fields = [("doc_id", documents.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    schema = ", ".join(f"{n} {t}" for n, t in [*fields, *([("ids", "array<int>")] if keep_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, end_id, most=PARTS)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids, offsets = tokens.encode(batch.column("text").to_pylist())
                sizes = np.diff(offsets)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(batch.num_rows), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = sizes - (counts - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = offsets[row] + start
                data = ids.astype("<u4").tobytes()
                checks = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(checks, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:  # the pieces of a batch follow each other without a gap
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed one after another."""
    open_bins = np.zeros(capacity + 1)  # by gap
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        # Taking a gap g changes the sum of squares by 1 - 2 N(g), leaving the gap r by 1 + 2 N(r); a gap of 0 counts no more.
        gaps = open_bins[n:capacity]
        change = 2 - 2 * gaps + 2 * open_bins[: capacity - n]
        if len(change):
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.inf
            best = int(change.argmin())
        if len(change) and change[best] <= 1 + 2 * open_bins[capacity - n]:
            gap = n + best
            place = holders[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, place, made = capacity, made, made + 1
        bins[k], offsets[k] = place, capacity - gap
        if gap > n:
            holders[gap - n].append(place)
            open_bins[gap - n] += 1
    return bins, offsets


def pack_groups(items: DataFrame, groups: int, capacity: int, falling: bool, turn: int) -> DataFrame:
    """Pack each group; add sequence_id, offset and filled (tokens in the bin)."""
    columns = items.columns
    schema = StructType(list(items.schema)).add("sequence_id", "long").add("offset", "long").add("filled", "long")

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([*([("length", "descending")] if falling else []), ("_order", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)[bins] if len(bins) else bins
        named = bins + (turn << 56) + (key[0].as_py() << 24)
        return pa.table([*(rows.column(c) for c in columns), pa.array(named), pa.array(offsets), pa.array(filled)], names=schema.names)

    dealt = items.withColumn("_order", F.xxhash64("_row")).withColumn("_group", F.pmod(F.xxhash64("_order"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(place, schema)


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces (doc_id, piece, length, ids_crc32 and more slim columns) with sequence_id and offset.

    Pieces are dealt into groups by the row they are stored in, not by what they hold, so equal ones spread as well.
    """
    found = materialise(found.withColumn("_row", F.monotonically_increasing_id()))
    columns = found.columns
    whole = found.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left, turn, last = [whole], found.where(F.col("length") < capacity), 0, False
    while (n := left.count()) > 0:
        groups = -(-n // GROUP)
        last = last or (groups == 1 and turn > 0)
        packed = materialise(pack_groups(left, groups, capacity, last, turn))
        if last:
            done.append(packed.drop("filled"))
            break
        done.append(packed.where(F.col("filled") >= CLOSED * capacity).drop("filled"))
        left = packed.where(F.col("filled") < CLOSED * capacity).select(*columns)
        last, turn = 2 * left.count() > n, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence from pieces with ids: sequence_id, ids.  A sequence is never longer than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
