"""Queries opN that move rows between documents, with their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cloakframe.llm import compression_classifier
from cloakframe.llm.line_dedup import drop_repeated_lines
from cloakframe.llm.mixing import mix
from cloakframe.llm.near_dedup import near_duplicates
from cloakframe.llm.neighbours import nearest
from cloakframe.llm.packing import pack, pieces
from cloakframe.llm.pseudonyms import pseudonymise
from cloakframe.llm.registry import query, table

LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
SHARE, SEED, EPOCHS = 0.9, 17, 3
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def with_domain(documents):
    """A domain for each source: its number modulo four."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]{1,9}$', 0) AS int)"), F.lit(0))
    return documents.withColumn("domain", F.concat(F.lit("d"), (number % 4).cast("string")))


def op2_sql() -> str:
    ctes, parent, given = [], [], "(SELECT least((SELECT CAST(floor(sum(tokens) * 0.9) AS HUGEINT) FROM leaves), (SELECT sum(cap) FROM leaves)) AS given)"
    for depth, level in enumerate(LEVELS):
        path = [*parent, level]
        weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        join = f"JOIN g{depth - 1} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {given}"
        ctes.append(f"""
n{depth} AS (SELECT * FROM (SELECT {', '.join(path)}, sum(cap) AS cap, {weight} AS weight FROM leaves GROUP BY {', '.join(path)}) {join}),
f{depth} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * weight
    + cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= given * weight AS full_
    FROM n{depth} WINDOW w AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {level})),
g{depth} AS (SELECT {', '.join(path)}, CASE WHEN full_ THEN cap ELSE (given - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({by}), 0)) * weight
    // sum(CASE WHEN NOT full_ THEN weight END) OVER ({by}) END AS given FROM f{depth})""")
        parent = path
    keys = ", ".join(LEVELS)
    return f"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '[0-9]{{1,9}}$', 0) AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, greatest(1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)) AS tokens FROM documents),
leaves AS (SELECT {keys}, sum(tokens) AS tokens, 3 * sum(tokens) AS cap FROM d GROUP BY {keys}),
{','.join(ctes)},
b AS (SELECT {keys}, given // tokens AS whole, given % tokens AS rest FROM leaves JOIN g2 USING ({keys}) WHERE given > 0),
p AS (SELECT d.*, whole, rest, sum(d.tokens) OVER (PARTITION BY {keys}
        ORDER BY md5('{SEED}|' || CAST(whole AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN b USING ({keys}))
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(CAST(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT))) AS BIGINT) AS epoch FROM p"""


@query("op2_source_mix", op2_sql())
def source_mix(spark, sf_dir):
    rows = with_domain(table(spark, sf_dir, "documents"))
    return mix(rows, LEVELS, WEIGHTS, SHARE, SEED, EPOCHS).select("doc_id", *LEVELS, "tokens", "epoch")


@query("op3_pseudonyms")
def pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), "check-key").select("doc_id", "text", "found")


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, i, line, coalesce(doc_id <> last, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query("op10_line_dedup", OP10_SQL)
def line_dedup(spark, sf_dir):
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_compression_classifier")
def quality_scores(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_classifier.fit(documents, table(spark, sf_dir, "labels"))
    scored = compression_classifier.score(documents, model)
    return scored.select(
        "doc_id", compression_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "good_bytes", "bad_bytes", "n_bytes")


@query("op7_packing")
def packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), VOCABULARY))


@query("op8_neighbours")
def neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, F.col("id") % 100 == 0)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


@query("op6_near_dedup", OP6_SQL)
def near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
