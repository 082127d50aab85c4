"""Texts made of short rows are dealt out evenly, and what is costly is worked out once per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import tables as T
from cloakframe.plans import load_all
from cloakframe.session import scratch_path
from cloakframe.sources.views import load


def customers(spark, folder: str, n: int = 4000) -> None:
    """One file of one row group."""
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_prompts_of_one_file_are_searched_by_every_core_beside_many_documents(spark):
    folder = scratch_path(spark, "dealt")
    customers(spark, folder)
    texts = spark.range(80).select(F.col("id").alias("doc_id"), F.lit("mail a@x.qa").alias("text")).repartition(20)
    texts.write.parquet(f"{folder}/documents.parquet")
    texts.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")).write.parquet(f"{folder}/pages.parquet")
    for view, kept in (("corpus", "kind = 'prompt'"), ("prompts", "true"), ("replies", "true"), ("model_replies", "true")):
        rows = load(spark, folder, view)
        shares = [r["count"] for r in rows.where(kept).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 4000 and max(shares) <= 2 * 4000 / spark.sparkContext.defaultParallelism, view
    assert load(spark, folder, "corpus").count() == 4160


def test_streamed_prompts_are_searched_by_every_core(spark):
    folder = scratch_path(spark, "dealt-stream")
    customers(spark, folder)
    done = load_all()["stream_rules_screen"](spark, folder)
    shares = [r["count"] for r in done.groupBy(F.input_file_name()).count().collect()]
    assert sum(shares) == 4000 and len(shares) >= spark.sparkContext.defaultParallelism and max(shares) < 2000


def test_a_reply_is_stripped_and_parsed_once(spark):
    said = '```json {"groups":[{"tier":"High risk","members":[" a ","b"]},{"tier":"Low risk","members":["b"]}]} ```'
    replies = spark.createDataFrame([(1, said), (2, "none {"), (3, None), (4, "{broken}")], "id long, text string").repartition(2)
    tiers = T.reply_tiers(T.parse_replies(replies), "id", "name")
    assert sorted(map(tuple, tiers.collect())) == [("a", "High risk"), ("b", "Low risk")]
    assert tiers._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3
    assert T.parse_replies(replies).where("json IS NOT NULL").count() == 1
