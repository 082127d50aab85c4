"""Resampling documents towards a target distribution by hashed features, an array of gains and a seeded draw.

1. ``features``: the runs of 1 to ``runs`` words of every whole text, each hashed into one of ``buckets`` buckets; a stored row per
   document holds its array of buckets.
2. ``bucket_counts``: how often each bucket occurs, counted per task before the shuffle.  Both tables of counts have ``buckets`` rows
   whatever the input, so they may come to the driver and go back to the tasks as one array of gains.
3. ``weighted``: a document's weight is the sum of the gains at its buckets; a seeded hash of its id adds Gumbel noise, so taking
   the highest scores draws without replacement in proportion to the exponential of the weights.
4. ``draw``: the cutoff is not sorted for.  A quantile sketch gives a bracket of scores around it; exact counts above and inside
   either prove that the cutoff lies inside or widen the bracket.  Only the bracket is sorted, and the rows above it are
   numbered by ranges.

Defined cases: a null or empty text, or one without words, has no features and weight 0; rows with a null doc_id are scored like an
empty id but take no part in the draw; rows that repeat a doc_id are candidates of their own, equal ones in any order; texts of any
length are read whole; other columns are ignored, whatever their names; an empty table gives no rows, an empty target counts 0
everywhere.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.arrow_parts import slices
from cloakframe.operators.numbering import number_rows
from cloakframe.session import materialise

ACCURACY = 10_000  # of the quantile sketch: it is off by this share of the rows at most

#: Bytes of words: digits, letters (capitals are lowered before) and everything beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one binary array, and how many each text has."""
    blobs = [(t or "").encode() for t in texts.to_pylist()]
    data = LOWER[np.frombuffer(b"".join(blobs), np.uint8)]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    inside = WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    opens[first] = inside[first]  # a word never goes on into the next text
    starts = np.flatnonzero(opens)
    # With everything between words left out, a word ends where the next one starts.
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[starts], kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    return words, np.diff(np.searchsorted(starts, bounds))


def hashed(words: pa.Array, counts: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, and how many each text has."""
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    own = np.array([zlib.crc32(w) % buckets for w in distinct], np.int32)
    found, owner = [own[codes]], [np.repeat(np.arange(len(counts)), counts)]
    for size in range(2, runs + 1):
        at = np.flatnonzero(owner[0][size - 1 :] == owner[0][: len(codes) - size + 1]) if len(codes) >= size else np.empty(0, np.int64)
        parts = np.stack([codes[at + i] for i in range(size)], axis=1) if len(at) else np.empty((0, size), np.int64)
        met, back = np.unique(parts, axis=0, return_inverse=True)
        joined = np.array([zlib.crc32(b" ".join(distinct[c] for c in run)) % buckets for run in met.tolist()], np.int32)
        found.append(joined[back.ravel()])
        owner.append(owner[0][at])
    values, owners = np.concatenate(found), np.concatenate(owner)
    return values[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(counts))


def features(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """Per row: doc_id, n_words, n_features, buckets.  ``texts`` has doc_id and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, n_words = words_of(batch.column("text"))
                values, n = hashed(words, n_words, runs, buckets)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    rows = texts.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, n_features long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: ``buckets`` numbers, each task's share added up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the logarithm of how much likelier the target is to hold it, smoothed by one, rounded down."""
    size = len(source)
    t_all, s_all = int(target.sum()) + size, int(source.sum()) + size
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def weighted(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Per row: weight (the sum of its gains) and score (weight and noise)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("buckets")
            values = gain[held.flatten().to_numpy(zero_copy_only=False)]
            ends = np.cumsum(batch.column("n_features").to_numpy())
            sums = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(sums))], names=[*kept, "weight"])

    kept = [c for c in found.columns if c != "buckets"]
    kinds = ", ".join(f"{n} {t}" for n, t in found.drop("buckets").dtypes)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(key, F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.mapInArrow(weigh, f"{kinds}, weight long").withColumn("score", F.col("weight") + noise)


def bracket(candidates: DataFrame, n: int, k: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Scores (low, high) between which the k-th highest of the n candidates lies, and how many lie above.

    The sketch only proposes; exact counts decide, and a bracket that misses the cutoff is widened.
    """
    margin = 2 / accuracy
    while True:
        places = F.array(F.lit(max(0.0, 1 - k / n - margin)), F.lit(min(1.0, 1 - k / n + margin)))
        low, high = candidates.select(F.percentile_approx("score", places, F.lit(accuracy))).first()[0]
        above, under = candidates.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") < low)).first()
        if above <= k <= n - under:
            return low, high, above
        margin *= 4


def draw(scored: DataFrame, percent: int, least_words: int, accuracy: int = ACCURACY) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the ``percent`` of the candidates with the highest scores, null for all others."""
    candidate = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    able = scored.where(candidate)
    n = able.count()
    k = percent * n // 100
    nothing = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", nothing).drop("row")
    low, high, above = bracket(able, n, k, accuracy)
    order = ["down", "doc_id", "row"]
    numbered = lambda rows: number_rows(rows.withColumn("down", -F.col("score")), [], order, "rank").drop("down")
    top = numbered(able.where(F.col("score") > high))
    middle = numbered(able.where(F.col("score").between(low, high))).withColumn("rank", F.col("rank") + above)
    middle = middle.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    others = scored.where(~candidate | (F.col("score") < low)).withColumn("rank", nothing)
    return others.unionByName(top).unionByName(middle).drop("row")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    ``documents`` has doc_id and text, ``target`` has text.
    """
    found = materialise(features(documents, runs, buckets))
    wanted = features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), runs, buckets)
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(found, buckets))
    scored = materialise(weighted(found, gain, seed).withColumn("row", F.monotonically_increasing_id()))
    return draw(scored, percent, least_words)
