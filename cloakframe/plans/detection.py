"""Detection, overlap resolution, redaction and the facts derived from entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.catalogue import DETECTORS, SCREENING
from cloakframe.functions.masking import mask_value
from cloakframe.functions.redaction import (
    count_placeholders,
    distinct_classes,
    entity_summary,
    settled,
    top_sensitivity,
    with_redaction,
    with_spans,
)
from cloakframe.functions.spans import all_spans, catalogue_field, detector_expr, gate_flags
from cloakframe.functions.text import clean_text
from cloakframe.plans.checksql import (
    digit_sum_ok,
    mask_sql,
    matches_sql,
    redacted_ctes,
    spaced,
    spans_ctes,
    trim_sql,
)
from cloakframe.plans.registry import plan
from cloakframe.sources.views import load

KEY = ["kind", "id"]
CORPUS = ["corpus"]
KEPT = spans_ctes("corpus")
REDACTED = redacted_ctes("corpus")
SCAN = {"documents": "doc_id", "pages": "page_id"}


def span_rows(df: DataFrame, spans: str, detectors=DETECTORS, keys: list[str] | None = None) -> DataFrame:
    """One row per span, with its position and masked value."""
    keys = keys or KEY
    rows = df.select(*keys, F.explode_outer(spans).alias("s")).where("s is not null")
    kind = catalogue_field(F.col("s.det"), detectors, "type")
    return rows.select(
        *keys,
        kind.alias("type"),
        F.col("s.start").cast("long").alias("start_pos"),
        (F.col("s.start") + F.length("s.value")).cast("long").alias("end_pos"),
        mask_value(kind, F.col("s.value")).alias("masked"),
    )


SPAN_COLS = f"kind, id, type, start AS start_pos, start + length(value) AS end_pos, {mask_sql()} AS masked"


def _register_detector(det: int, detectors, prefix: str) -> None:
    detector = detectors[det]
    ranked = detectors is DETECTORS

    @plan(
        f"{prefix}_{detector.type.lower()}",
        spaced(CORPUS, [f"m AS ({matches_sql(detector, det, 'corpus', ranked=ranked)})"], f"SELECT {SPAN_COLS} FROM m"),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = load(spark, sf_dir, "corpus")
        gated = corpus.withColumn("gates", gate_flags("text", [detector]))
        found = settled(gated, F.expr(detector_expr("text", "gates", detectors, det, ranked)), "found")
        return span_rows(found, "found", detectors)


for _i in range(len(DETECTORS)):
    _register_detector(_i, DETECTORS, "detect")
for _i in range(len(SCREENING)):
    _register_detector(_i, SCREENING, "screen")


@plan("scan_prompts", spaced(["prompts"], [], f"SELECT prompt_id, destination, {trim_sql('text')} AS text FROM prompts WHERE {trim_sql('text')} <> ''"))
def scan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = load(spark, sf_dir, "prompts").withColumn("text", clean_text(F.col("text")))
    return cleaned.where(F.col("text") != "")


@plan(
    "luhn",
    f"""SELECT o_orderkey, digits, {digit_sum_ok('digits')} AS valid
FROM (SELECT o_orderkey, concat('4', lpad(CAST(o_orderkey * 7919 AS VARCHAR), 15, '0')) AS digits FROM orders)""",
)
def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 15, "0"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits"))
    return rows.withColumn("valid", F.call_function("luhn_check", F.col("digits")))


@plan("entity_spans", spaced(CORPUS, [KEPT], f"SELECT {SPAN_COLS} FROM spans"))
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = load(spark, sf_dir, "corpus")
    gated = corpus.withColumn("gates", gate_flags("text"))
    found = settled(gated, all_spans("text", "gates"), "found")
    return span_rows(found, "found")


@plan("resolve_overlaps", spaced(CORPUS, [KEPT], f"SELECT {SPAN_COLS} FROM kept"))
def resolve_overlaps_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(with_spans(load(spark, sf_dir, "corpus")), "spans")


@plan("redact_text", spaced(CORPUS, [KEPT, REDACTED], "SELECT kind, id, redacted, n_spans FROM redacted"))
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    return done.select(*KEY, "redacted", F.size("spans").cast("long").alias("n_spans"))


@plan(
    "entity_summary",
    spaced(CORPUS, [KEPT, REDACTED], "SELECT kind, id, placeholder, type, cls, sensitivity, label, masked FROM entity"),
)
def entity_summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    return done.select(*KEY, F.inline(entity_summary(F.col("entities"))))


@plan(
    "mask_values",
    spaced(CORPUS, [KEPT], f"SELECT type, {mask_sql()} AS masked, count(*) AS n FROM kept GROUP BY ALL"),
)
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = span_rows(with_spans(load(spark, sf_dir, "corpus")), "spans")
    return rows.groupBy("type", "masked").agg(F.count("*").alias("n"))


@plan(
    "top_sensitivity",
    spaced(CORPUS, [KEPT, REDACTED], """SELECT s.kind, s.id, CASE max(e.rank) WHEN 3 THEN 'restricted' WHEN 2 THEN 'confidential' WHEN 1 THEN 'internal' END AS tier
FROM corpus s LEFT JOIN entity e ON s.kind = e.kind AND s.id = e.id GROUP BY s.kind, s.id"""),
)
def top_sensitivity_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    return done.select(*KEY, top_sensitivity(F.col("entities")).alias("tier"))


@plan(
    "distinct_classes",
    spaced(CORPUS, [KEPT, REDACTED], """SELECT kind, id, string_agg(cls, ',' ORDER BY f) AS classes
FROM (SELECT kind, id, cls, min(first_start) AS f FROM entity GROUP BY kind, id, cls) GROUP BY kind, id"""),
)
def distinct_classes_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus")).where(F.size("entities") > 0)
    return done.select(*KEY, F.array_join(distinct_classes(F.col("entities")), ",").alias("classes"))


@plan(
    "count_placeholders",
    spaced(CORPUS, [KEPT, REDACTED], "SELECT kind, id, len(list_distinct(regexp_extract_all(redacted, '\\[[A-Z]+_[0-9]+\\]'))) AS n FROM redacted"),
)
def count_placeholders_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus"))
    return done.select(*KEY, count_placeholders(F.col("redacted")).cast("long").alias("n"))


@plan(
    "first_seen_numbering",
    spaced(CORPUS, [KEPT, REDACTED], """SELECT kind, id, type, placeholder, first_start AS first_pos,
row_number() OVER (PARTITION BY kind, id, type ORDER BY first_start) AS idx FROM entity"""),
)
def first_seen_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_redaction(load(spark, sf_dir, "corpus")).select(*KEY, "spans", F.posexplode("entities").alias("p", "e"))
    first = F.array_min(
        F.transform(
            F.filter(
                F.col("spans"),
                lambda s: (s["value"] == F.col("e.value"))
                & (catalogue_field(s["det"], DETECTORS, "type") == F.col("e.type")),
            ),
            lambda s: s["start"],
        )
    )
    return done.select(
        *KEY,
        F.col("e.type").alias("type"),
        F.col("e.placeholder").alias("placeholder"),
        first.cast("long").alias("first_pos"),
        F.regexp_extract("e.placeholder", "([0-9]+)\\]$", 1).cast("long").alias("idx"),
    )
