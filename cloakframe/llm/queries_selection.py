"""Queries op11 to op13, which choose rows for training and write token files, with their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cloakframe.llm import token_files
from cloakframe.llm.hard_negatives import hard_negatives
from cloakframe.llm.importance import resample
from cloakframe.llm.registry import query, table
from cloakframe.session import scratch_path

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT a AS anchor_id, b AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, b) AS rank, b AS negative_id, positive_score, s AS negative_score
FROM pos JOIN p ON a = anchor_id AND NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, b) <= 10"""


def whole(x):
    """floor(256 * x) as a double; null for what is not finite.  From 2^53 on every double is whole."""
    scaled = 256 * x.cast("double")
    floored = F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), floored)


@query("op11_hard_negatives", OP11_SQL)
def mined_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", whole).alias("vector"))
    mined = hard_negatives(rows, F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90)
    return mined.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


OP12_SQL = r"""
WITH lookup AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) AS word FROM texts),
bytes AS (SELECT word, list_transform(range(CAST(length(hex(encode(word))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bs
  FROM (SELECT DISTINCT word FROM words)),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, lookup),
used AS (SELECT side, id, bucket FROM words JOIN bucket USING (word)),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM used GROUP BY bucket),
total AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g FROM counted, total),
weighed AS (SELECT id, count(*) AS n, CAST(sum(g) AS BIGINT) AS w FROM used JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed ON id = doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


@query("op12_importance_resampling", OP12_SQL)
def importance_resampling(spark, sf_dir):
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, runs=1, buckets=10_000, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_token_files")
def written_tokens(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, spaceless=True)
    return token_files.read(spark, folder)
