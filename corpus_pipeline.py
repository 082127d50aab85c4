"""The corpus pipeline: filter, clean, deduplicate, mix and pack the documents table.

Each stage reads what its predecessor kept and its decisions take effect; all but the last return the columns of
documents (doc_id, text, lang, source, n_chars), the last one a row per piece of a packed sequence.  ``run`` cuts the
lineage between stages with a table in the shared folder, as the check tool does with its Parquet files.

Nulls, empty texts, repeated rows and empty tables are defined by each operator; no stage drops a row for them except the
classifier (a text about which nothing is known gets the prior and stays) and the mix, whose budget takes effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import compression_classifier
from cloakframe.llm.line_dedup import drop_repeated_lines
from cloakframe.llm.mixing import mix
from cloakframe.llm.near_dedup import near_duplicates
from cloakframe.llm.packing import pack, pieces
from cloakframe.llm.queries_tables import LEVELS, SEED, WEIGHTS, with_domain
from cloakframe.llm.registry import table
from cloakframe.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes when label 1 is less likely than this.
REJECT_BELOW = 0.5
#: Share of all tokens that the mix may hand out.
MIX_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the compression classifier, trained on the labelled rows of the documents table, does not reject."""
    model = compression_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = compression_classifier.score(docs.select(*COLUMNS), model)
    return scored.where((F.col("score") >= REJECT_BELOW) | (F.col("n_bytes") == 0)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; n_chars follows the text."""
    cleaned = drop_repeated_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, similarity 0.8)."""
    gone = near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix domains, languages and sources to their target weights; a document is taken once at most."""
    return mix(with_domain(docs.select(*COLUMNS)), LEVELS, WEIGHTS, MIX_SHARE, SEED, max_epochs=1).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 1024."""
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("source mix", sources),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the vocabulary; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
