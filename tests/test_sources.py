"""Reading and writing tables, audit appends, vault cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import audit as Q
from cloakframe.operators import tables as T
from cloakframe.operators import vault as V
from cloakframe.operators.access import revoke_by_prefix
from cloakframe.operators.letters import draft_targets, headline
from cloakframe.session import scratch_path
from cloakframe.sources.portfolio import read_portfolio, write_by_tier


def test_csv_portfolio_keeps_text_and_fills_blanks(spark):
    path = scratch_path(spark, "csv")
    rows = [("Ann, Lee", "28412345678", None), ('Bob "B"', "", "Line\nbreak")]
    spark.createDataFrame(rows, "`Customer Name` string, QID string, Note string").coalesce(1).write.option("header", "true").option(
        "escape", '"'
    ).csv(path)
    got = [tuple(r) for r in read_portfolio(spark, path).collect()]
    assert sorted(got) == sorted([("Ann, Lee", "28412345678", ""), ('Bob "B"', "", "Line\nbreak")])


def test_sink_by_tier(spark):
    path = scratch_path(spark, "tiers")
    df = spark.createDataFrame([(1, "a", "Low risk"), (2, "b", "High risk"), (3, "c", "Low risk")], "n long, name string, tier string")
    write_by_tier(df, path, "n")
    back = spark.read.parquet(path)
    assert sorted(tuple(r) for r in back.select("n", "name", "Risk Tier", "tier").collect()) == [
        (1, "a", "Low risk", "Low risk"), (2, "b", "High risk", "High risk"), (3, "c", "Low risk", "Low risk")
    ]


def test_audit_append_and_page(spark):
    path = scratch_path(spark, "audit")
    entries = spark.createDataFrame([(None, "login", "", None, "1.1.1.1", None), ("ann", "", "t", None, "", "ua")],
                                    "actor string, action string, target string, meta struct<a:int>, ip string, user_agent string")
    Q.append_audit(entries, path)
    Q.append_audit(entries, path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert {(r["actor"], r["action"], r["target"], r["ip"]) for r in back.collect()} == {("unknown", "login", None, "1.1.1.1"), ("ann", "unknown", "t", None)}
    log = back.withColumn("id", F.monotonically_increasing_id()).withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01'"))
    assert Q.query_audit(log, limit=0).count() == 4
    assert Q.query_audit(log, limit=3, offset=2).count() == 2
    assert Q.count_audit(log, Q.AuditFilter(actor="ann")).first()["n"] == 2


def test_vault_cells(spark):
    df = spark.createDataFrame([("Omar",), ("é",)], "v string")
    key, other = V.key_from_hex("11" * 32), V.key_from_hex("22" * 32)
    cells = df.withColumn("cell", V.encrypt(F.col("v"), key))
    got = cells.select("v", V.decrypt(F.col("cell"), key).alias("ok"), V.decrypt(F.col("cell"), other).alias("bad")).collect()
    assert [(r["ok"], r["bad"]) for r in got] == [("Omar", ""), ("é", "")]


def test_insert_if_absent_keeps_the_first(spark):
    held = spark.createDataFrame([(1, "[A_1]", "old")], "conv_id long, placeholder string, v string")
    new = spark.createDataFrame([(1, "[A_1]", "x", 1), (1, "[A_2]", "late", 3), (1, "[A_2]", "first", 2)], "conv_id long, placeholder string, v string, ord int")
    assert [(r["placeholder"], r["v"]) for r in V.insert_new(held, new).collect()] == [("[A_2]", "first")]


def test_prefixes_of_any_length(spark):
    sessions = spark.createDataFrame([("abcdefgh1", None), ("abcdzzzz2", None), ("dead00001", "2024")], "token string, revoked_at string")
    requests = spark.createDataFrame([("abcdefgh",), ("abcd",), ("dead",), ("",)], "prefix string")
    got = {r["prefix"]: r["token"] for r in revoke_by_prefix(sessions, requests).collect()}
    assert got["abcdefgh"] == "abcdefgh1" and got["abcd"] == "abcdefgh1" and got["dead"] is None


def test_letters_fall_back_to_all_rows_when_none_is_overdue(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(600)], "n long, dpd double")
    assert draft_targets(df).count() == 600
    assert draft_targets(df.withColumn("dpd", F.col("n") % 3 * 1.0)).count() == 400
    one = spark.createDataFrame([(1, 3.0), (2, 0.0)], "n long, dpd double")
    assert [r["n"] for r in draft_targets(one).collect()] == [1]
    text = one.limit(1).select(headline(F.lit(1), F.lit("write notes"), F.lit(False)).alias("h")).first()["h"]
    assert text == "Drafted 1 bilingual message — English and Arabic."


def test_prompt_batches_cover_every_row(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "n long, name string")
    got = T.prompt_batches(df, "n", ["name"], "H\n", "do", "!", 10).orderBy("batch").collect()
    assert [r["n_rows"] for r in got] == [10, 10, 5]
    assert got[2]["prompt"] == "H\nname\n" + "\n".join(f"n{i}" for i in range(20, 25)) + "\n\nTASK: do!"
