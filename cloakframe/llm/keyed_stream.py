"""Streaming joins in Arrow batches: a few leader rows per key, then the key's many followers.

Leaders and followers are dealt out by key and a salt, sorted so that a key's leaders come first, and read as one stream.
A task holds the leaders of one key and one batch of followers, however many followers a key has; the salt spreads a hot
key over several tasks, each with a copy of its leaders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaders_first(leaders: DataFrame, followers: DataFrame, keys: list[str], salts: str) -> DataFrame:
    """The union of both, dealt by ``keys`` and ``_salt`` and sorted with leaders first (``_leads``).

    Both sides have ``keys`` and the long column ``salts`` (how many parts the key has); followers have ``_salt`` too.
    """
    copies = leaders.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col(salts) - 1)))
    both = copies.withColumn("_leads", F.lit(0)).unionByName(followers.withColumn("_leads", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "_leads")


def salt_of(*columns: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.col(parts))


def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch cut where the values of ``names`` change (rows come sorted by them)."""
    if not batch.num_rows:
        return
    import numpy as np

    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for name in names:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        part = batch.slice(start, end - start)
        yield tuple(part.column(n)[0].as_py() for n in names), part


def streamed(keys: list[str], schema: pa.Schema, lead: Callable, follow: Callable, keep_unled: bool = False) -> Callable:
    """A function for mapInArrow: ``lead(rows)`` makes a key's state, ``follow(state, rows)`` an output batch.

    ``lead`` gets all leaders of the key; followers without a leader are passed over, or with ``keep_unled`` get the state None.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, state = None, [], None
        for batch in batches:
            for key, rows in runs(batch, [*keys, "_salt", "_leads"]):
                if key[:-1] != current:
                    current, waiting, state = key[:-1], [], None
                if key[-1] == 0:
                    waiting.append(rows)
                else:
                    if waiting:
                        state, waiting = lead(pa.Table.from_batches(waiting)), []
                    if state is not None or keep_unled:
                        yield follow(state, rows).cast(schema)
        return

    return over
