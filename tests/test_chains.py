"""Keyed chains against a plain recomputation: parts, lanes, tampering, proofs, and appends that were cut off."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.catalogue import GENESIS
from cloakframe.operators import chains as H
from cloakframe.operators.ledger import HASHED_FIELDS, canonical_head
from cloakframe.session import scratch_path

SCHEMA = ", ".join(f"{name} {'long' if name == 'id' else 'string'}" for name in HASHED_FIELDS) + ", moment long, chain string"


def records(spark, n=240, chains=45):
    """A third of all records lies in one chain."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        values = {name: rng.choice([None, "x", 'quoted "y"', "é\n"]) for name in HASHED_FIELDS}
        values |= {"id": 1000 + i, "classes": rng.choice([None, '["b","a"]']), "status": "completed"}
        rows.append((*[values[f] for f in HASHED_FIELDS], i // 2, "hot" if rng.random() < 0.33 else f"k{rng.randrange(chains)}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


ORDER = ["moment", "id"]


def plain_links(df):
    """chain, seq, id, prev_hash, hash, one record after the other."""
    last, out = {}, []
    for r in df.withColumn("head", canonical_head()).orderBy(*ORDER).collect():
        seq, prev = last.get(r.chain, (0, GENESIS))
        digest = hashlib.sha256(f'{r.head}{prev}"}}'.encode()).hexdigest()
        out.append((r.chain, seq + 1, r.id, prev, digest))
        last[r.chain] = (seq + 1, digest)
    return sorted(out), last


def plain_root(df, last):
    order = list(dict.fromkeys(r.chain for r in df.orderBy(*ORDER).collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = {i: sha(f"{c}|{last[c][0]}|{last[c][1]}") for i, c in enumerate(order)}
    for level in range(H.LEVELS):
        nodes = {up: sha("".join(nodes.get(up * H.FAN + s, H.EMPTY[level]) for s in range(H.FAN))) for up in {p // H.FAN for p in nodes}}
    return nodes[0]


@pytest.fixture(scope="module")
def built(spark):
    df = records(spark).cache()
    folder = scratch_path(spark, "chains")
    H.create(spark, folder)
    for low, high in ((0, 50), (50, 50), (50, 51), (51, 120)):  # one of the parts is empty
        H.append(df.where(f"moment >= {low} AND moment < {high}"), folder, ORDER)
    return df, folder


def test_parts_equal_building_at_once(spark, built):
    df, folder = built
    want, last = plain_links(df)
    pick = ["chain", "seq", "id", "prev_hash", "hash"]
    assert sorted(map(tuple, H.links(spark, folder).select(pick).collect())) == want
    once = scratch_path(spark, "chains")
    H.create(spark, once)
    H.append(df, once, ORDER)
    root = lambda at, b: H.roots(spark, at).where(F.col("batch") == b).first().root
    assert root(once, 1) == root(folder, 4) == plain_root(df, last)
    assert {r.chain: (r.seq, r.hash) for r in H.heads(spark, folder).collect()} == last
    assert root(folder, 1) == root(folder, 2) and root(folder, 0) == H.EMPTY[-1]


def test_every_part_verifies_and_the_roots_are_sealed(spark, built):
    _df, folder = built
    rows = [H.verify(spark, folder, b).first() for b in range(1, 5)]
    assert [(r.batch, r.ok, r.root_ok, r.broken_at) for r in rows] == [(b, True, True, None) for b in range(1, 5)] and sum(r.n_links for r in rows) == 240
    ends = H.roots(spark, folder)
    assert all(r.ok for r in H.verify_roots(ends).collect())
    for change in (ends.withColumn("n_links", F.when(F.col("batch") == 2, 5).otherwise(F.col("n_links"))), ends.where("batch <> 1"),
                   ends.withColumn("root", F.when(F.col("batch") == 3, "0").otherwise(F.col("root")))):
        assert not all(r.ok for r in H.verify_roots(change).collect())


def test_changes_of_a_part_are_found(spark, built):
    df, folder = built
    part, segments = H.links(spark, folder, 4), H._part(spark, folder, "segments", 4, H.SEGMENTS)
    siblings, ends = H._part(spark, folder, "siblings", 4, H.NODES), H.roots(spark, folder)
    check = lambda p=part, g=segments, s=siblings: H.verify_part(p, g, s, ends, 4).first()
    assert check().ok
    first = part.orderBy("chain", "seq").first()
    edited = check(part.withColumn("approver", F.when(F.col("id") == first.id, "other").otherwise(F.col("approver"))))
    assert not edited.ok and edited.broken_at == first.id and edited.root_ok
    assert not check(part.where(F.col("id") != first.id)).ok
    assert not check(part.where("chain <> 'hot'")).ok
    assert not check(part.unionByName(part.where(F.col("id") == first.id))).ok
    assert not check(part.withColumn("seq", F.col("seq") + 1)).ok
    assert not check(s=siblings.withColumn("hash", F.lit("0" * 64))).ok and not check(g=segments.withColumn("position", F.col("position") + 1)).ok
    # Another record of its own time, linked in place of a stored one: each hash fits, the root does not.
    forged = df.where("moment >= 51").withColumn("actor", F.lit("forged"))
    begun = H._part(spark, folder, "starts", 4, H.HEADS)
    row = check(H._linked(forged, begun, ORDER))
    assert not row.ok and not row.root_ok and row.broken_at is None


def test_heads_are_proven_by_the_root_alone(spark, built):
    _df, folder = built
    asked = spark.createDataFrame([("hot",), ("k1",), ("nowhere",)], "chain string")
    found = {r.chain: r for r in H.proofs(spark, folder, asked, 4).collect()}
    root = H.roots(spark, folder).where("batch = 4").first().root
    assert set(found) == {"hot", "k1"} and all(len(r.path) == H.LEVELS for r in found.values())
    rows = spark.createDataFrame([(r.chain, r.seq + d, r.hash, r.path, d) for r in found.values() for d in (0, 1)], H.proofs(spark, folder, asked, 4).schema.add("d", "integer"))
    head = F.struct("chain", "seq", "hash")
    assert all((r.d == 0) == r.ok for r in rows.select("d", H.proven(head, F.col("path"), F.lit(root)).alias("ok")).collect())
    assert not any(r.ok for r in rows.select(H.proven(head, F.slice("path", 2, 9), F.lit(root)).alias("ok")).collect())


def test_an_append_that_was_cut_off_leaves_no_part(spark, built, monkeypatch):
    df, _folder = built
    folder = scratch_path(spark, "chains")
    H.create(spark, folder)
    early, late = df.where("moment < 60"), df.where("moment >= 60")
    H.append(early, folder, ORDER)
    real = H._write

    def dies(rows, at, table, batch):
        if table == "siblings":
            raise RuntimeError("killed")
        real(rows, at, table, batch)

    monkeypatch.setattr(H, "_write", dies)
    with pytest.raises(RuntimeError):
        H.append(late.limit(3), folder, ORDER)
    monkeypatch.undo()
    assert H.links(spark, folder).count() == early.count() and H.roots(spark, folder).count() == 2
    assert H.append(late, folder, ORDER) == 2 and H.verify(spark, folder, 2).first().ok
    assert H.heads(spark, folder).agg(F.sum("seq")).first()[0] == 240


def test_lanes_split_a_hot_key(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("key"), "id")
    sizes = [r["count"] for r in rows.groupBy(H.chain_name(F.col("key"), F.col("id"), 8).alias("chain")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250
    assert rows.select(H.chain_name(F.lit(None), F.col("id"))).first()[0] == ""


def test_a_task_links_a_bounded_number_of_records_at_once(spark, monkeypatch):
    """Whatever the size of the batches it is handed, and with the same links."""
    sizes = []
    plain = type(spark.range(1)).mapInArrow

    def spied(df, link, schema):
        whole = df.toArrow().combine_chunks().to_batches()
        sizes.extend(b.num_rows for b in link(iter(whole)))
        return plain(df, link, schema)

    df = records(spark, 3000, 20).withColumn("actor", F.repeat(F.lit("a"), F.lit(1000))).coalesce(1)
    monkeypatch.setattr(type(df), "mapInArrow", spied)
    starts = spark.createDataFrame([], H.HEADS)
    linked = H._linked(df, starts, ORDER).select("chain", "seq", "id", "prev_hash", "hash")
    assert sum(sizes) == 3000 and max(sizes) < 500
    assert sorted(map(tuple, linked.collect())) == plain_links(df)[0]
