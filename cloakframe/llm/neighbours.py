"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected on ``DIMS`` random directions, shifted, cut into cells of about equal share and ordered along a Hilbert
curve; this is done ``curves`` times with other directions and shifts.  Spark range-partitions all orders at once; in a
partition every query is compared with the ``window`` vectors before and behind it.  The ends of each partition are handed on
once more, so windows reach over borders.  The best of all windows are merged and ranked by exact distance.

The window grows with the rows (a ``SHARE``-th of them, ``window`` at least, ``MOST`` at most).  After ``curves`` curves recall is measured
against an exact search of at most ``SAMPLE`` queries; below ``recall`` further passes follow, and when four times the curves do not
reach it either, every query is searched exactly.

Equal vectors form one class that is searched once and stands for its smallest ids, so a vector that a third of all rows
share costs one row per curve.  Work grows with rows times curves (sorting) and queries times curves times window.

Nearness is the Euclidean distance in double precision of the original vectors, ties to the smaller id.

Defined cases: vectors that are null, zero, of another length than the commonest (of several, the smallest), or hold null or non-finite
components take no part, nor do rows with a null id; a row repeated with its id counts once; with fewer than k
candidates all that were found are returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialise

DIMS, BITS = 16, 3
TASK_ROWS = 100_000
SHARE, MOST = 128, TASK_ROWS // 8
SAMPLE, LOT, BLOCK = 200, 4096, 1024
ORDERED = "curve int, key long, id long, wanted boolean, vector array<float>"
FOUND = "border long, curve int, key long, id long, wanted boolean, vector array<float>, near long, distance double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cells (n x dims, 0 to 2^bits - 1) along the Hilbert curve of that many dimensions.

    A cell's coordinates are turned level by level into the transposed index, whose bits are then read across.
    """
    x = [column.astype(np.int64) for column in cells.T]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, column in enumerate(x):
            upper = (column >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ column) & low)
            if i:
                x[i] = column ^ swap
                x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            else:
                x[0] = np.where(upper, x[0] ^ low, x[0])
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for column in x:
            place = (place << 1) | (((column ^ turn) >> level) & 1)
    return place


def curve_places(vectors: np.ndarray, curve: int, mean: np.ndarray, variance: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, curve])
    directions = np.linalg.qr(rng.normal(size=(vectors.shape[1], vectors.shape[1])))[0][:, :DIMS]
    scale = np.sqrt((directions**2 * variance[:, None]).sum(axis=0)) + 1e-12
    shifted = (vectors - mean) @ directions / scale + rng.uniform(-0.5, 0.5, size=directions.shape[1])
    share = 1 / (1 + np.exp(-1.702 * np.clip(shifted, -20, 20)))  # close to the normal distribution function
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def usable(rows: DataFrame, dim: int) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vector") == dim) & finite & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())


def classes(rows: DataFrame, wanted: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (id: the smallest, vector, wanted, members: their ``most`` smallest ids), and the queries with their class."""
    keyed = rows.distinct().select("*", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"), wanted.alias("asks"))
    order = Window.partitionBy("h", "g").orderBy("id")
    first = keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)  # cut before the shuffle too
    heads = first.groupBy("h", "g").agg(F.min("id").alias("id"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("members"))
    asking = keyed.where("asks").select("h", "g").distinct().withColumn("wanted", F.lit(True))
    joined = materialise(heads.join(asking, ["h", "g"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))))
    queries = keyed.where("asks").select("h", "g", F.col("id").alias("query_id")).join(joined.select("h", "g", "id"), ["h", "g"])
    return joined.select("id", "vector", "wanted", "members"), queries.select("query_id", "id")


def ordered(heads: DataFrame, curves: int, mean: np.ndarray, variance: np.ndarray, seed: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector")).astype(np.float64)
            for curve in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), curve, np.int32)), pa.array(curve_places(vectors, curve, mean, variance, seed)),
                     batch.column("id"), batch.column("wanted"), batch.column("vector")],
                    names=["curve", "key", "id", "wanted", "vector"])

    return heads.select("id", "wanted", "vector").mapInArrow(place, ORDERED)


def best_in_windows(table: pa.Table, window: int, k: int) -> tuple[list[int], list[int], list[float]]:
    """For each wanted row of a sorted table, its k nearest among ``window`` rows on both sides, on its own curve."""
    wanted = np.flatnonzero(table.column("wanted").to_numpy())
    queries, near, distances = [], [], []
    if len(wanted):
        table = table.combine_chunks()
        curve, ids = table.column("curve").to_numpy(), table.column("id").to_numpy()
        vectors = matrix(table.column("vector").chunk(0))
        for at in wanted.tolist():
            low = max(at - window, int(np.searchsorted(curve, curve[at], "left")))
            high = min(at + window + 1, int(np.searchsorted(curve, curve[at], "right")))
            gap = vectors[low:high].astype(np.float64) - vectors[at].astype(np.float64)
            far = np.sqrt((gap * gap).sum(axis=1))
            close = np.flatnonzero(far <= np.partition(far, k)[k]) if len(far) > k else np.arange(len(far))
            best = close[np.lexsort((ids[low:high][close], far[close]))[: k + 1]]
            queries += [int(ids[at])] * len(best)
            near += ids[low:high][best].tolist()
            distances += far[best].tolist()
    return queries, near, distances


def search_partitions(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Results (near, distance) inside each partition, and its first and last rows (border) once more."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, place = pa.Table.from_batches(held), TaskContext.get().partitionId()
        queries, near, distances = best_in_windows(table, window, k)
        n, names = len(queries), ["border", "curve", "key", "id", "wanted", "vector", "near", "distance"]
        nothing = lambda kind, size: pa.nulls(size, kind)
        vector = table.schema.field("vector").type
        yield pa.RecordBatch.from_arrays(
            [nothing(pa.int64(), n), nothing(pa.int32(), n), nothing(pa.int64(), n), pa.array(queries, pa.int64()), nothing(pa.bool_(), n),
             nothing(vector, n), pa.array(near, pa.int64()), pa.array(distances, pa.float64())], names=names)
        for border, part in ((place, table.slice(0, window)), (place + 1, table.slice(max(0, len(table) - window)))):
            for b in part.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, border)), *(b.column(c) for c in names[1:6]), nothing(pa.int64(), b.num_rows), nothing(pa.float64(), b.num_rows)],
                    names=names)

    return rows.mapInArrow(search, FOUND)


def search_borders(found: DataFrame, window: int, k: int) -> DataFrame:
    """Results over each border: two windows of rows at most meet there."""

    def search(rows: pa.Table) -> pa.Table:
        queries, near, distances = best_in_windows(rows.sort_by([(c, "ascending") for c in ("curve", "key", "id")]), window, k)
        return pa.table({"id": pa.array(queries, pa.int64()), "near": pa.array(near, pa.int64()), "distance": pa.array(distances, pa.float64())})

    return found.where("border IS NOT NULL").groupBy("border").applyInArrow(search, "id long, near long, distance double")


def exact(heads: DataFrame, asked: np.ndarray, points: np.ndarray, k: int) -> DataFrame:
    """For each of the ``asked`` ids (at ``points``) its k + 1 nearest of each partition: id, near, distance."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = points.astype(np.float64)
        square = (own * own).sum(axis=1)
        best = [(np.empty(0, np.int64), np.empty(0))] * len(asked)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, vectors = part.column("id").to_numpy(), matrix(part.column("vector")).astype(np.float64)
                size = (vectors * vectors).sum(axis=1)
                for i in range(0, len(asked), BLOCK):
                    block = square[i : i + BLOCK, None] + size - 2 * own[i : i + BLOCK] @ vectors.T
                    # Rounding of this form must not lose a neighbour: what is as near as the last one, or almost, is measured again.
                    last = np.partition(block, k, axis=1)[:, k] if len(ids) > k else np.full(len(block), np.inf)
                    slack = 1e-12 * (square[i : i + BLOCK] + size.max())
                    for j, row in enumerate(block <= (last + slack)[:, None], i):
                        near = np.flatnonzero(row)
                        gap = vectors[near] - own[j]
                        near, far = np.r_[best[j][0], ids[near]], np.r_[best[j][1], np.sqrt((gap * gap).sum(axis=1))]
                        order = np.lexsort((near, far))[: k + 1]
                        best[j] = near[order], far[order]
        n = [len(near) for near, _ in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))],
                names=["id", "near", "distance"])

    return heads.select("id", "vector").mapInArrow(search, "id long, near long, distance double")


def last_distances(heads: DataFrame, k: int) -> tuple[dict[int, float], int]:
    """Of at most ``SAMPLE`` queries: the distance of the k-th nearest other class (or of the last, if there are fewer), and how many there are."""
    some = heads.where("wanted").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vector").collect()
    if not some:
        return {}, 0
    found = exact(heads, np.array([r.id for r in some]), np.array([r.vector for r in some]), k).where("near <> id")
    lists = found.groupBy("id").agg(F.expr(f"slice(sort_array(collect_list(distance)), 1, {k})").alias("far"))
    far = {r.id: r.far for r in lists.collect()}
    return {i: f[-1] for i, f in far.items()}, sum(len(f) for f in far.values())


def recall_of(results: list[DataFrame], last: dict[int, float], total: int) -> float:
    """The share of the sampled queries' true neighbours among the results."""
    if not total:
        return 1.0
    pairs = union(results).where(F.col("id").isin(list(last)) & (F.col("near") != F.col("id"))).groupBy("id", "near").agg(F.min("distance").alias("distance"))
    bounds = F.create_map(*[F.lit(x) for i, far in last.items() for x in (i, far * (1 + 1e-12))])
    return pairs.where(F.col("distance") <= F.element_at(bounds, F.col("id"))).count() / total


def union(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionAll(more)
    return merged


def exact_in_lots(heads: DataFrame, k: int) -> list[DataFrame]:
    lots, held = [], []
    asking = heads.where("wanted").select("id", "vector").toLocalIterator()
    for r in asking:
        held.append(r)
        if len(held) == LOT:
            lots, held = [*lots, materialise(exact(heads, *arrays(held), k))], []
    return [*lots, materialise(exact(heads, *arrays(held), k))] if held else lots


def arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.id for r in rows]), np.array([r.vector for r in rows], np.float32)


def nearest(
    rows: DataFrame, wanted: Column, k: int = 10, curves: int = 48, window: int = 256, seed: int = 17, per_pass: int = 16, recall: float = 0.93,
) -> DataFrame:
    """For each row with ``wanted`` (a condition on id): query_id, rank (from 1), vec_id, score.  ``rows`` has id and vector."""
    rows = rows.select(F.col("id").cast("long"), F.col("vector").cast("array<float>"))
    lengths = rows.where("id IS NOT NULL AND size(vector) > 0").groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    head = lengths.orderBy(F.col("rows").desc(), "n").select("n").first()
    dim = head.n if head else 1
    heads, queries = classes(usable(rows, dim), wanted, k + 1)
    parts = [F.struct(F.avg(F.col("vector")[i].cast("double")), F.var_pop(F.col("vector")[i].cast("double"))) for i in range(dim)]
    spread = heads.agg(*[p.alias(f"d{i}") for i, p in enumerate(parts)], F.count("*").alias("n")).first()
    mean, variance = (np.array([spread[f"d{i}"][j] or 0.0 for i in range(dim)]) for j in (0, 1))
    window = max(window, min(-(-spread["n"] // SHARE), MOST))
    results = [heads.where("wanted").select("id", F.col("id").alias("near"), F.lit(0.0).alias("distance"))]
    last, total, first = *last_distances(heads, k), 0
    while total and (first < curves or recall_of(results, last, total) < recall):
        if first >= 4 * curves:
            results = [*results[:1], *exact_in_lots(heads, k)]
            break
        n = per_pass if first >= curves else min(per_pass, curves - first)  # in passes, so that shuffled copies of the vectors stay a small multiple
        tasks = max(1, -(-spread["n"] * n // max(TASK_ROWS, 16 * window)))
        placed = ordered(heads, n, mean, variance, seed + first).repartitionByRange(tasks, "curve", "key", "id")
        found = materialise(search_partitions(placed.sortWithinPartitions("curve", "key", "id"), window, k))
        results += [found.where("border IS NULL").select("id", "near", "distance"), materialise(search_borders(found, window, k))]
        first += n
    merged = union(results)
    pairs = merged.groupBy("id", "near").agg(F.min("distance").alias("distance"))
    rank = lambda: F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))
    close = pairs.withColumn("n", rank()).where(F.col("n") <= k + 1).drop("n")
    members = heads.select(F.col("id").alias("near"), "members")
    single = close.join(members, "near").select("id", "distance", F.explode("members").alias("near"))
    lists = single.withColumn("n", rank()).where(F.col("n") <= k + 1).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "near"))).alias("found"))
    own = queries.join(lists, "id").select("query_id", F.expr(f"slice(filter(found, f -> f.near <> query_id), 1, {k})").alias("found"))
    return own.select("query_id", F.posexplode("found").alias("i", "f")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("f.near").alias("vec_id"), F.col("f.distance").alias("score"))
