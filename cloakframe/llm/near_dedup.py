"""Near-duplicate groups by SetSketch registers: sketch, band, estimate, verify on full sets, connect.

1. Documents with equal shingle sets form a class; only classes go on.  A class is named by its smallest doc_id.
2. Classes whose registers agree in a band share a bucket.  In a bucket not all pairs are formed: the rest is compared with a
   centre, the member that shares most buckets with others, and what it links becomes one component.
3. A pair is first estimated from the registers by likelihood and dropped only when the estimate is ``SLACK`` under the bound (over
   five standard errors).  The rest is verified on full shingle sets, streamed past their centre's set.
4. Two members of a bucket that are still in different components have met the same centre, and one of them is outside its
   component: those outsiders are held in blocks and all members around that component are streamed past them.  Pairs of
   one component are never formed, pairs of two are compared but only links come out, and no link is lost.
5. Verified links are connected by large and small stars.

With 40 bands of 5 registers, a link of similarity 0.85 misses all buckets with probability 1e-10, one of 0.80 with 1e-7.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; a text with fewer words than a shingle has one shingle, all its words; texts of any length are read whole;
rows with a null doc_id get a null component, are kept and link nothing; rows that repeat a doc_id are one document, linked with
what any of them is linked with, and each comes back with its own n_shingles; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.arrow_parts import slices
from cloakframe.llm.components import components
from cloakframe.llm.keyed_stream import leaders_first, salt_of, streamed
from cloakframe.llm.set_sketch import band_keys, registers, similarity
from cloakframe.llm.shingles import shingle_sets
from cloakframe.session import materialise

BANDS, ROWS, SLACK = 40, 5, 0.14
FOLLOWERS, BLOCK = 256, 128
SKETCH = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, registers binary"


def set_key(found: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """Per document: the size of its shingle set, the set's 128-bit key, band keys and registers (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                elements, sizes = shingle_sets(batch.column("text"), width)
                found = registers(elements, sizes, BANDS * ROWS)
                keys = band_keys(found, BANDS, ROWS)
                full = np.flatnonzero(sizes > 0)
                ends = np.cumsum(sizes[full])
                names = [set_key(elements[e - n : e]) for e, n in zip(ends.tolist(), sizes[full].tolist())]
                at = np.full(len(sizes), -1)
                at[full] = np.arange(len(full))
                rows = pa.array(at, mask=at < 0)
                pick = lambda values, kind: pa.array(values, kind).take(rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pick([n[0] for n in names], pa.int64()), pick([n[1] for n in names], pa.int64()),
                     bands.take(rows), pick([r.tobytes() for r in found], pa.binary())],
                    names=["doc_id", "n_shingles", "hi", "lo", "bands", "registers"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, SKETCH)


def likely(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""
    side = lambda s: heads.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, second = (np.stack([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()]) for c in ("r_a", "r_b"))
                sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
                keep = pa.array(similarity(first, second, *sizes) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    possible = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")  # sets of too different size cannot be this similar
    return sized.where(possible).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, "a long, b long")


def full_sets(documents: DataFrame, heads: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles (bytes of the sorted hashes) of the wanted nodes, made again from their texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                elements, sizes = shingle_sets(batch.column("text"), width)
                ends = np.cumsum(sizes)
                parts = [elements[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                keys = [set_key(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["hi", "lo", "shingles"])

    wanted = heads.select("node", "hi", "lo").join(nodes, "node")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(build, "hi long, lo long, shingles binary")
    return sets.join(wanted, ["hi", "lo"]).select("node", "hi", "lo", "shingles").dropDuplicates(["hi", "lo"]).select("node", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, checked on full sets.

    The set of b is streamed past the set of a; a centre with many partners is dealt out in parts.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(centre: dict | None, rows: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for a, shingles in zip(rows.column("a").to_pylist(), rows.column("shingles").to_pylist()):
            first, second = centre[a], np.frombuffer(shingles, np.uint64)
            places = np.searchsorted(first, second)
            shared = int((first[np.minimum(places, len(first) - 1)] == second).sum())
            kept.append(100 * shared >= percent * (len(first) + len(second) - shared))
        return rows.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def lead(rows: pa.Table) -> dict:
        return {a: np.frombuffer(s, np.uint64) for a, s in zip(rows.column("a").to_pylist(), rows.column("shingles").to_pylist())}

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("long").alias("parts"))
    leaders = parts.join(sets.withColumnRenamed("node", "a"), "a")
    followers = pairs.join(parts, "a").join(sets.withColumnRenamed("node", "b"), "b").withColumn("_salt", salt_of("b", parts="parts"))
    stream = leaders_first(leaders.select("a", "shingles", "parts"), followers.select("a", "b", "shingles", "parts", "_salt"), ["a"], "parts")
    return stream.select("a", "b", "shingles", "_salt", "_leads").mapInArrow(streamed(["a"], schema, lead, compare), "a long, b long")


def links(documents: DataFrame, heads: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between nodes that connect all similar ones."""
    spread = heads.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = spread.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(spread.join(sizes, ["band", "key"]))
    # The member that shares most buckets with others is the best centre of its buckets.
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = F.struct("weight", (-F.col("node")).alias("order"))
    centres = members.join(weight, "node").groupBy("band", "key").agg((-F.max(heavy)["order"]).alias("a"))
    met = materialise(members.join(centres, ["band", "key"]).where("a <> node").select("a", F.col("node").alias("b")).distinct())
    close = materialise(likely(met, heads, percent / 100 - SLACK))
    star = materialise(verified(close, full_sets(documents, heads, ends_of(close), width), percent))
    rest = materialise(outsiders(met, components(star)))
    wanted = rest.select("node").distinct()
    return star.unionAll(compared(rest, heads, full_sets(documents, heads, wanted, width), percent))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()


def outsiders(met: DataFrame, label: DataFrame) -> DataFrame:
    """Members around each component: centre (the component), node, label, outside (in another component), blocks, parts.

    The members around a component are the nodes that have met one of its centres, each once however many it met.  Two
    nodes of one bucket have met its centre.  If they lie in different components now, one of them is outside the
    centre's component, so it is enough to compare the outsiders of each component with all members around it.
    """
    named = lambda side: F.coalesce(F.col(f"{side}_label"), F.col(side))
    for side in ("a", "b"):
        met = met.join(label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_label")), side, "left")
    known = met.select(named("a").alias("centre"), F.col("b").alias("node"), named("b").alias("label")).distinct()
    known = known.withColumn("outside", F.col("label") != F.col("centre"))
    split = known.groupBy("centre").agg(
        F.count_if("outside").alias("n_out"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    split = split.where("n_out > 0 AND low <> high")
    return known.join(split.select(
        "centre", F.ceil(F.col("n_out") / BLOCK).cast("long").alias("blocks"), F.ceil(F.col("n") / FOLLOWERS).cast("long").alias("parts")), "centre")


def compared(rest: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the outsiders of a component and the members around it that lie in others.

    Outsiders are held in blocks, members streamed past them in parts: first sizes and registers decide, then the full
    sets.  Only links come out, so a group of copies does not become pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = percent / 100 - SLACK

    def unpacked(rows) -> tuple:
        return (
            rows.column("node").to_numpy(), rows.column("label").to_numpy(),
            np.stack([np.frombuffer(r, np.uint16) for r in rows.column("registers").to_pylist()]),
            [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()])

    def follow(held: tuple, rows: pa.RecordBatch) -> pa.RecordBatch:
        nodes, labels, marks, full = unpacked(rows)
        found = ([], [])
        sizes = np.array([len(x) for x in full], float)
        for node, label, mark, own in zip(*held):
            ratio = np.minimum(sizes, len(own)) / np.maximum(sizes, len(own))
            maybe = np.flatnonzero((labels != label) & (ratio >= percent / 100 - 1e-9) & ((marks == mark).mean(axis=1) >= least - 0.05))
            if len(maybe):
                sized = similarity(marks[maybe], np.broadcast_to(mark, (len(maybe), len(mark))), sizes[maybe], np.full(len(maybe), float(len(own))))
                for i in maybe[sized >= least].tolist():
                    places = np.minimum(np.searchsorted(own, full[i]), len(own) - 1)
                    shared = int((own[places] == full[i]).sum())
                    if 100 * shared >= percent * (len(own) + len(full[i]) - shared):
                        found[0].append(int(node))
                        found[1].append(int(nodes[i]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    full = rest.join(heads.select("node", "registers"), "node").join(sets, "node")
    names = ["centre", "block", "node", "label", "registers", "shingles", "parts"]
    leaders = full.where("outside").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select(names)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    followers = full.withColumn("block", every).select(names).withColumn("_salt", salt_of("node", "centre", parts="parts"))
    stream = leaders_first(leaders, followers, ["centre", "block"], "parts").drop("parts")
    return stream.mapInArrow(streamed(["centre", "block"], schema, unpacked, follow), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    found = materialise(sketches(documents, width))
    slim = found.select("doc_id", "n_shingles", "hi", "lo")
    named = slim.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(named.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    heads = materialise(
        found.where("n_shingles > 0").join(classes.withColumnRenamed("node", "doc_id"), ["hi", "lo", "doc_id"])
        .dropDuplicates(["hi", "lo"]).select(F.col("doc_id").alias("node"), "hi", "lo", "n_shingles", "bands", "registers"))
    # A doc_id that repeats with another text links the classes of its rows.
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    own = named.join(again, "doc_id").join(classes, ["hi", "lo"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    label = components(links(documents, heads, width, percent).unionAll(own))
    by_class = classes.join(label, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    return slim.join(by_class, ["hi", "lo"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
