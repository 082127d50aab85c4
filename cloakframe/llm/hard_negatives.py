"""Hard negatives by exact inner-product search over candidate lists that clusters of anchors share.

Anchors are clustered by direction.  For a cluster with centre c, whose members lie within an angle t of it, no member m can score
more with a candidate x than ``|m| |x| cos(max(0, angle(x, c) - t))``.  Without ``|m|`` this bound is the same for all members, so a
cluster's candidates are sorted by it once and every member walks that one list from the top.  A member stops when the bound of
what comes next, times its own length, is under the worst score it still needs: nothing further down can enter its result.

On Spark a list is cut into segments of at most ``VALUES`` vector components by a histogram of exact counts per bound (``BINS`` numbers a
cluster, whatever the input), a bin too large for one segment into blocks.  The walk goes in waves of 1, 2, 4, ... segments: only
candidates of the wave's segments are sent, only to clusters that still walk, and in a segment members stream past the sorted
vectors in blocks of matrix products.  After a wave the results are merged, and members with a certificate drop out.  So what is moved
follows the length of the walks; where bounds are weak (random directions) that is the whole list, and the result is the same.

Both searches are such walks: the best rows of an anchor's own label (positives), then for each positive the best rows of other labels
whose score lies between ``low`` and ``high`` percent of the positive's (negatives).

The centres are fitted on at most ``SAMPLE`` anchors (k-means on directions); every anchor is then assigned and every row
listed, so the sample decides the speed of the walks and nothing else.  Scores are exact where vectors hold whole numbers and
sums stay under 2^53; higher scores come first, ties by the smaller id.

Defined cases: rows with a null id or label, a null or empty vector, or null or non-finite components take no part, nor do vectors of
another length than the commonest (of several, the smallest); of rows that repeat an id the one with the smallest label, then
vector, counts; zero vectors score 0 with all; a positive with a negative score has no negatives; an anchor without another row of
its label has no rows; labels are whole numbers; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.keyed_stream import leaders_first, salt_of, streamed
from cloakframe.session import materialise

SAMPLE, ROUNDS = 4096, 12
BINS, VALUES = 1024, 1 << 21
MEMBERS, STEP, AT_ONCE = 4096, 2048, 512
FOUND = "id long, want int, near long, score double"
ROW = pa.schema([("id", pa.int64()), ("want", pa.int32()), ("near", pa.int64()), ("score", pa.float64())])


def usable(rows: DataFrame) -> DataFrame:
    """id, label, vector, norm of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    sound = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite)
    sizes = sound.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.col("rows").desc(), "n").select("n").first()
    sound = sound.where(F.size("vector") == (common.n if common else 1))
    again = materialise(sound.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not again.isEmpty():
        one = sound.join(again, "id").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
        sound = sound.join(again, "id", "left_anti").unionByName(one)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return materialise(sound.withColumn("norm", norm))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, clusters: int, seed: int) -> np.ndarray:
    """K-means on directions, started from vectors far from each other."""
    unit = directions(sample)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(unit)))]
    while len(chosen) < min(clusters, len(unit)):
        chosen.append(int((unit @ unit[chosen].T).max(axis=1).argmin()))
    held = unit[chosen]
    for _ in range(ROUNDS):
        near = (unit @ held.T).argmax(axis=1)
        sums = np.stack([unit[near == c].sum(axis=0) for c in range(len(held))])
        held = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, directions(sums), held)
    return held


@dataclass
class Lists:
    """How the list of each cluster is cut: its centre, the members' widest angle, and the segment of each bin of bounds."""

    centre: np.ndarray
    angle: np.ndarray
    top: float  # no bound is larger
    segment: np.ndarray | None = None  # by cluster and bin
    blocks: list[list[int]] | None = None  # by cluster and segment
    upper: list[list[float]] | None = None  # the largest bound in a segment

    def bounds(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        cosine = vectors @ self.centre.T / np.maximum(norms, 1e-300)[:, None]
        apart = np.arccos(np.clip(cosine, -1, 1)) - self.angle
        return norms[:, None] * np.cos(np.maximum(apart, 0))

    def bins(self, bounds: np.ndarray) -> np.ndarray:
        return np.clip(((1 - bounds / max(self.top, 1e-300)) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def cut(self, counts: np.ndarray, most: int) -> None:
        """Bins in falling order of bounds, gathered into segments of at most ``most`` rows; a larger bin is a segment of blocks."""
        self.segment, self.blocks, self.upper = np.zeros(counts.shape, np.int64), [], []
        for c, row in enumerate(counts.tolist()):
            blocks, upper, held = [], [], most
            for b, n in enumerate(row):
                if n and held + n > most:
                    blocks.append(-(-n // most))
                    upper.append(self.top * (1 - 2 * b / BINS) + 1e-9 * self.top)
                    held = 0
                held += n
                self.segment[c, b] = max(len(blocks) - 1, 0)
            self.blocks.append(blocks)
            self.upper.append(upper)


def assigned(anchors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Anchors with their cluster and the angle to its centre."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = directions(matrix(batch.column("vector"), batch.num_rows)) @ centre.T
                near = cosine.argmax(axis=1)
                # A zero vector scores 0 whatever the bound, so it need not widen its cluster.
                turn = np.where(batch.column("norm").to_numpy() > 0, np.arccos(np.clip(cosine.max(axis=1), -1, 1)), 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(turn)], names=[*batch.schema.names, "cluster", "turn"])

    return anchors.mapInArrow(assign, "id long, label long, vector array<double>, norm double, cluster int, turn double")


def histogram(rows: DataFrame, lists: Lists) -> np.ndarray:
    """Rows per cluster and bin: numbers of a fixed count, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                bins = lists.bins(lists.bounds(matrix(batch.column("vector"), batch.num_rows), batch.column("norm").to_numpy()))
                for c in range(shape[0]):
                    total[c] += np.bincount(bins[:, c], minlength=BINS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["cluster", "bin", "n"])

    shape = (len(lists.centre), BINS)
    out = np.zeros(shape, np.int64)
    for r in rows.select("vector", "norm").mapInArrow(count, "cluster int, bin int, n long").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.cluster, r.bin] = r.n
    return out


def listed(rows: DataFrame, lists: Lists, parts: dict[int, int], first: int, end: int) -> DataFrame:
    """The candidates in the segments ``first`` to ``end`` of the clusters that still walk (``parts``: into how many parts their members go)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = lists.bounds(matrix(batch.column("vector"), batch.num_rows), batch.column("norm").to_numpy())
            bins, ids = lists.bins(bounds), batch.column("id").to_numpy()
            for c, n in parts.items():
                segment = lists.segment[c, bins[:, c]]
                at = np.flatnonzero((segment >= first) & (segment < end))
                if len(at):
                    own = batch.take(pa.array(at))
                    block = ids[at] % np.array(lists.blocks[c])[segment[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c, np.int32)), pa.array(segment[at]), pa.array(block), own.column("id"), own.column("label"), own.column("vector"),
                         pa.array(bounds[at, c]), pa.array(np.full(len(at), n, np.int64))],
                        names=["cluster", "segment", "block", "id", "label", "vector", "bound", "parts"])

    return rows.mapInArrow(place, "cluster int, segment long, block long, id long, label long, vector array<double>, bound double, parts long")


def sent(members: DataFrame, lists: Lists, parts: dict[int, int], first: int, end: int) -> DataFrame:
    """Each member once for every segment and block of the wave in its cluster's list."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = batch.column("cluster").to_numpy()
            for c, n in parts.items():
                own = batch.take(pa.array(np.flatnonzero(clusters == c)))
                if own.num_rows:
                    for segment in range(first, min(end, len(lists.blocks[c]))):
                        for block in range(lists.blocks[c][segment]):
                            more = [pa.array(np.full(own.num_rows, x, np.int64)) for x in (segment, block, n)]
                            yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "segment", "block", "parts"])

    kinds = ", ".join(f"{n} {t}" for n, t in members.dtypes)
    return members.mapInArrow(spread, f"{kinds}, segment long, block long, parts long").withColumn("_salt", salt_of("id", parts="parts"))


def walker(k: int, same_label: bool, low: float | None, high: float | None):
    """``lead`` and ``follow`` of a segment: the sorted list, and what each member finds on it."""

    def lead(rows: pa.Table) -> tuple:
        rows = rows.combine_chunks()
        bound = rows.column("bound").to_numpy()
        order = np.argsort(-bound, kind="stable")
        vectors = matrix(rows.column("vector").chunk(0), len(rows))
        return rows.column("id").to_numpy()[order], rows.column("label").to_numpy()[order], bound[order], vectors[order]

    def follow(held: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.concat_batches([walk(held, rows.slice(at, AT_ONCE)) for at in range(0, rows.num_rows, AT_ONCE)])

    def walk(held: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, bounds, vectors = held
        n = rows.num_rows
        own_id, own_label, norm = (rows.column(c).to_numpy() for c in ("id", "label", "norm"))
        own, need, base = (matrix(rows.column(c), n) for c in ("vector", "need", "base"))
        need, wants = need.copy(), need.shape[1]
        best, near = np.full((n, wants, k), -np.inf), np.full((n, wants, k), np.iinfo(np.int64).max)
        for at in range(0, len(ids), STEP):
            reach = norm * bounds[at] * (1 + 1e-9) + 1e-9  # of the scores from here on
            going = np.flatnonzero(reach >= need.min(axis=1))
            if not len(going):
                break
            part = slice(at, at + STEP)
            score = own[going] @ vectors[part].T
            same = labels[part] == own_label[going, None]
            able = same & (ids[part] != own_id[going, None]) if same_label else ~same
            for w in range(wants):
                enter = able & (score >= need[going, w, None])
                if low is not None:
                    enter &= (100 * score >= low * base[going, w, None]) & (100 * score <= high * base[going, w, None])
                for r in np.flatnonzero(enter.any(axis=1)).tolist():
                    m, new = going[r], np.flatnonzero(enter[r])
                    scores, found = np.r_[best[m, w], score[r, new]], np.r_[near[m, w], ids[part][new]]
                    order = np.lexsort((found, -scores))[:k]
                    best[m, w], near[m, w] = scores[order], found[order]
                    need[m, w] = max(need[m, w], best[m, w, -1])
        m, w, i = np.nonzero(best > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(own_id[m]), pa.array(w.astype(np.int32)), pa.array(near[m, w, i]), pa.array(best[m, w, i])], schema=ROW)

    return lead, follow


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "want").orderBy(F.col("score").desc(), "near")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_cluster(values: list[float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, v in enumerate(values) for x in (c, v)]), F.col("cluster"))


def walked(rows: DataFrame, members: DataFrame, lists: Lists, k: int, same_label: bool, low: float | None = None, high: float | None = None) -> DataFrame:
    """The k best of each want of each member: id, want, near, score, rank.

    Members have id, label, vector, norm, cluster, ``base`` (the score that a want is measured by) and ``need`` (the least score it can use).
    """
    keys = ["cluster", "segment", "block"]
    lead, follow = walker(k, same_label, low, high)
    found, first, size = rows.sparkSession.createDataFrame([], FOUND), 0, 1
    while True:
        walking = {r.cluster: r.n for r in members.groupBy("cluster").agg(F.count("*").alias("n")).collect() if len(lists.blocks[r.cluster]) > first}
        if not walking:
            return best(found, k)
        end, parts = first + size, {c: -(-n // MEMBERS) for c, n in walking.items()}
        stream = leaders_first(listed(rows, lists, parts, first, end), sent(members, lists, parts, first, end), keys, "parts").drop("parts")
        new = stream.mapInArrow(streamed(keys, ROW, lead, follow), FOUND)
        found = materialise(best(found.unionByName(new), k).drop("rank"))
        # A want with k results needs no score under its worst; a member whose wants are out of reach has its certificate.
        full = found.groupBy("id", "want").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        least = full.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("want", "least"))).alias("least"))
        raised = F.transform("need", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("least", i), x)))
        members = members.join(least, "id", "left").withColumn("need", raised).drop("least")
        reach = F.col("norm") * by_cluster([u[end] if len(u) > end else -np.inf for u in lists.upper]) * (1 + 1e-9) + 1e-9
        members = materialise(members.where(F.array_min("need") <= reach))
        first, size = end, 2 * size


def hard_negatives(
    rows: DataFrame, wanted: Column, positives: int = 5, negatives: int = 10, low: float = 30, high: float = 90, clusters: int = 8, seed: int = 17,
) -> DataFrame:
    """Per anchor (``wanted``, a condition on id) and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label and vector.
    """
    rows = usable(rows)
    anchors = rows.where(wanted)
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    spark = rows.sparkSession
    if not sample:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    vectors = np.array([r.vector for r in sample])
    centre = centres(vectors, min(clusters, max(1, len(vectors) // 8)), seed)
    members = materialise(assigned(anchors, centre))
    angle = np.zeros(len(centre))
    for r in members.groupBy("cluster").agg(F.max("turn").alias("turn")).collect():
        angle[r.cluster] = r.turn + 1e-7
    lists = Lists(centre, angle, rows.agg(F.max("norm")).first()[0])
    lists.cut(histogram(rows, lists), max(1, VALUES // vectors.shape[1]))
    number = lambda values: F.array(*values).cast("array<double>")
    asking = members.drop("turn").withColumn("base", number([F.lit(float("nan"))])).withColumn("need", number([F.lit(float("-inf"))]))
    own = materialise(walked(rows, asking, lists, positives, True))
    # Each positive is a want of its own; what cannot be reached is never walked for.
    scores = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    base = [F.coalesce(F.try_element_at("scores", F.lit(i + 1)), F.lit(float("nan"))) for i in range(positives)]
    floor = lambda x: F.when(F.isnan(x) | (x < 0), float("inf")).otherwise(x * low / 100 * (1 - 1e-9) - 1e-9)
    asking = members.drop("turn").join(scores, "id").withColumn("base", number(base)).withColumn("need", F.transform("base", floor)).drop("scores")
    asking = materialise(asking.where(F.array_min("need") < float("inf")))
    found = walked(rows, asking, lists, negatives, False, low, high)
    mine = own.select(F.col("id").alias("anchor_id"), F.col("near").alias("positive_id"), (F.col("rank") - 1).alias("want"), F.col("score").alias("positive_score"))
    other = found.select(F.col("id").alias("anchor_id"), "want", "rank", F.col("near").alias("negative_id"), F.col("score").alias("negative_score"))
    return mine.join(other, ["anchor_id", "want"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
