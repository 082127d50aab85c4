"""Which known values occur in which texts of the same scope, without comparing all pairs.

Every value is anchored at its rarest character gram, of five characters or, for shorter values, of their own
length.  Texts emit the hashes of their distinct grams that pass a fixed-size bitmap of all anchors, so only a small share
of positions is shuffled; anchors and emitted grams meet in an equi-join, and the few candidates are
verified against the text.  The result is exact for values of any length; empty and null values occur nowhere,
and rows with a null in the scope belong to no scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.session import materialise

GRAM = 5
BITS = 1 << 27  # 16 MiB of bitmap, whatever the number of values
BUCKET = 32768  # bits per row of Spark's bitmap aggregate
SALTS = 16
CODES = 1 << 18  # code points hashed at a time


def gram_hashes(texts: list[str], size: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every character gram of several texts, in order: the row of its text and its hash."""
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    # A gram that would run into the next text is none.
    first = np.flatnonzero(np.arange(len(codes)) + size <= np.cumsum(lengths)[row])
    row = row[first]
    out = seeds[row]
    for i in range(size):
        out = (out ^ codes[first + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return row, out


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of at most CODES code points together; a longer text is a block of its own."""
    begin, held = 0, 0
    for row, length in enumerate(lengths):
        if row > begin and held + length > CODES:
            yield begin, row
            begin, held = row, 0
        held += length
    if begin < len(lengths):
        yield begin, len(lengths)


def _distinct_grams(texts: list[str], scope_hash: np.ndarray, sizes: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct grams of each text that pass the bitmap."""
    lengths = np.array([len(text) for text in texts])
    largest = np.array([0, *sizes])[np.searchsorted(sizes, lengths, side="right")]
    at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in sizes:
        own = np.flatnonzero(lengths >= size if bitmap is not None else largest == size)
        if not len(own):
            continue
        # The size is part of the hash: grams of different sizes never meet.
        seeds = scope_hash[own] + np.uint64(size * 0x632BE59BD9B4E019 % (1 << 64))
        row, hashes = gram_hashes([texts[i] for i in own], size, seeds)
        if bitmap is not None:
            slot = hashes & np.uint64(BITS - 1)
            passed = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            row, hashes = row[passed], hashes[passed]
        at.append(own[row])
        found.append(hashes)
    row, hashes = np.concatenate(at), np.concatenate(found)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _emit(scope: list[str], carry: list[str], text: str, sizes: list[int], bitmap: np.ndarray | None):
    """One row per text and distinct gram; without a bitmap a text emits grams of one size, the largest it can fill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [body or "" for body in batch[text]]
            scope_hash = batch["scope_hash"].to_numpy(dtype=np.int64).view(np.uint64)
            for begin, end in _blocks(np.array([len(body) for body in bodies], dtype=np.int64)):
                row, hashes = _distinct_grams(bodies[begin:end], scope_hash[begin:end], sizes, bitmap)
                rows = batch[[*scope, *carry]].iloc[begin + row].reset_index(drop=True)
                rows["gram"] = hashes.view(np.int64)
                yield rows

    return run


def _schema(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def _bitmap(anchors: DataFrame) -> tuple[np.ndarray, list[int]]:
    """One bit per anchor hash, at most BITS bits reach the driver; and the sizes of the anchors, five at most."""
    slot = F.col("gram").bitwiseAND(F.lit(BITS - 1))
    rows = (
        anchors.select(slot.alias("slot"), "size")
        .groupBy(F.floor(F.col("slot") / BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("slot") % BUCKET).cast("long")).alias("bits"), F.collect_set("size").alias("sizes"))
        .collect()
    )
    bitmap = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows:
        start = row["bucket"] * BUCKET // 8
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        bitmap[start : start + len(bits)] = bits
    return bitmap, sorted({size for row in rows for size in row["sizes"]})


def occurrences(texts: DataFrame, text_key: str, text: str, scope: list[str], values: DataFrame, value: str) -> DataFrame:
    """(scope, text_key, found): per text the array of value rows that occur in it.

    ``values`` is unique on (scope, value); its other columns come along in ``found``.
    """
    scoped = F.lit(True)
    for column in scope:
        scoped &= F.col(column).isNotNull()
    here = F.xxhash64(*scope).alias("scope_hash") if scope else F.lit(0).cast("long").alias("scope_hash")
    texts, values = texts.where(scoped), values.where(scoped & (F.length(value) > 0))
    # Values are short: by their bytes all of them would be one task.  They are read several times and so are worked out once.
    values = materialise(values.repartition(values.sparkSession.sparkContext.defaultParallelism, *scope, value))
    every_size = list(range(1, GRAM + 1))
    grams = values.select(*scope, value, here).mapInPandas(
        _emit(scope, [value], value, every_size, None), _schema(values, [*scope, value]) + ", gram long"
    )
    shared = grams.groupBy(*scope, "gram").agg(F.count("*").alias("freq"))
    anchors = (
        grams.join(shared, [*scope, "gram"])
        .groupBy(*scope, value)
        .agg(F.min(F.struct("freq", "gram"))["gram"].alias("gram"))
    )
    rest = [c for c in values.columns if c not in scope]
    anchored = materialise(anchors.join(values, [*scope, value]).select(*scope, "gram", F.struct(*rest).alias("known")))
    bitmap, sizes = _bitmap(anchored.withColumn("size", F.least(F.length(F.col("known")[value]), F.lit(GRAM))))
    spark = texts.sparkSession
    shared_bits = spark.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _emit(scope, [text_key], text, sizes, shared_bits.value)(batches)

    emitted = texts.select(*scope, text_key, text, here).mapInPandas(
        emit, _schema(texts, [*scope, text_key]) + ", gram long"
    )
    # A gram of a hot scope may come from a third of all texts: spread it over salts.
    salted = emitted.withColumn("salt", F.pmod(F.xxhash64(text_key), F.lit(SALTS)).cast("int"))
    # Its size is that of the stored anchors to the planner, so it is kept from being broadcast with all its copies.
    spread = anchored.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")
    candidates = (
        salted.join(spread, [*scope, "gram", "salt"])
        .groupBy(*scope, text_key)
        .agg(F.collect_list("known").alias("found"))
    )
    checked = texts.select(*scope, text_key, text).join(candidates, [*scope, text_key])
    kept = F.filter(F.col("found"), lambda k: F.contains(F.col(text), k[value]))
    return checked.select(*scope, text_key, kept.alias("found")).where(F.size("found") > 0)
