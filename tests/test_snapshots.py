"""Commits of several tables at once, erasure that leaves most files alone, and replies of any shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import replies as M
from cloakframe.operators import snapshots as N
from cloakframe.session import scratch_path

KEYS = {"messages": "conv_id", "vault": "conv_id"}


def tables(spark, low, high):
    rows = spark.range(low, high).withColumnRenamed("id", "conv_id")
    return {"messages": rows.withColumn("text", F.concat(F.lit("text "), "conv_id")), "vault": rows.where("conv_id % 2 = 0").withColumn("mark", F.lit("[NAME_1]"))}


def ids(df):
    return sorted(r.conv_id for r in df.collect())


def test_commit_all_or_nothing(spark, monkeypatch):
    folder = scratch_path(spark, "store")
    assert N.version(spark, folder) == -1
    assert N.commit(spark, folder, tables(spark, 0, 40), KEYS) == 0
    assert N.commit(spark, folder, tables(spark, 40, 60), KEYS) == 1
    assert ids(N.read(spark, folder, "messages")) == list(range(60)) and ids(N.read(spark, folder, "vault", 0)) == list(range(0, 40, 2))
    real, seen = N._store, []

    def dies(df, *rest):
        seen.append(rest)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return real(df, *rest)

    monkeypatch.setattr(N, "_store", dies)
    with pytest.raises(RuntimeError):
        N.commit(spark, folder, tables(spark, 60, 70), KEYS)
    monkeypatch.undo()
    assert N.version(spark, folder) == 1 and ids(N.read(spark, folder, "messages")) == list(range(60))
    assert N.unlisted(spark, folder, 0).count() > 0  # what the killed commit left
    # Two that start from the same version: the second has to look again.
    N.commit(spark, folder, tables(spark, 60, 61), KEYS, base=1)
    with pytest.raises(N.Conflict):
        N.commit(spark, folder, tables(spark, 70, 71), KEYS, base=1)
    assert ids(N.read(spark, folder, "messages")) == list(range(61))
    N.commit(spark, folder, {"messages": tables(spark, 5, 6)["messages"]}, KEYS, replace=True)
    assert ids(N.read(spark, folder, "messages")) == [5] and len(ids(N.read(spark, folder, "vault"))) == 31
    with pytest.raises(KeyError):
        N.read(spark, folder, "nothing")


def test_erasure_leaves_most_files_alone(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = scratch_path(spark, "store")
        for i in range(5):
            N.commit(spark, folder, tables(spark, 100 * i, 100 * i + 100), KEYS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    gone = spark.createDataFrame([(211,), (212,), (212,), (9999,), (None,)], "conv_id long")
    at, anew, alone = N.erase(spark, folder, gone, "conv_id", ["messages", "vault"])
    assert anew <= 4 and alone >= 30
    assert ids(N.read(spark, folder, "messages", at)) == [i for i in range(500) if i not in (211, 212)]
    assert ids(N.read(spark, folder, "vault", at)) == [i for i in range(0, 500, 2) if i != 212]
    assert len(ids(N.read(spark, folder, "messages", at - 1))) == 500 and N.unlisted(spark, folder, at).count() == anew
    every = spark.range(500).withColumnRenamed("id", "conv_id")
    at, _anew, _alone = N.erase(spark, folder, every, "conv_id", ["messages", "vault"])
    assert N.read(spark, folder, "messages").count() == 0 and N.read(spark, folder, "vault").columns == ["conv_id", "mark"]
    assert N.erase(spark, folder, every, "conv_id", ["messages"])[1] == 0


def test_replies_of_any_shape(spark):
    texts = [None, "", "[]", "{}", "{", '{"groups":null,"drafts":[null,1,[],{}]}', 'x {"groups":[{"tier":1.5,"members":[true,"[A_1]",["no"]]}]} y',
             '```JSON\n{"drafts":[{"id":"[B_1]","en":"[A_1]","ar":{"no":1}}]}\n```', '{"groups":[{"members":{"a":1}}],"groups2":1}']
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    groups = M.grouping_rows(df, "n")
    assert sorted((r.n, r.tier, r.members, r["count"]) for r in groups.collect()) == [(6, "1.5", ["true", "[A_1]"], 2), (8, None, [], 0)]
    drafts = M.draft_rows(df, "n")
    assert sorted(map(tuple, drafts.collect())) == [(5, 3, "", "", ""), (7, 0, "[B_1]", "[A_1]", "")]
    vault = spark.createDataFrame([(2, "[A_1]", "Ann"), (1, "[B_1]", "Ben of [A_1]")], "ord int, placeholder string, value string")
    assert sorted(map(tuple, M.restored_drafts(drafts, "n", vault).collect())) == [(5, 3, "Customer", "", ""), (7, 0, "Ben of Ann", "Ann", "")]
    assert sorted((r.n, r.g_ord, r.m_ord, r.member) for r in M.restored_members(groups, "n", vault).collect()) == [(6, 0, 0, "true"), (6, 0, 1, "Ann")]
