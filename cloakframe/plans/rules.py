"""Rules that come as data, at work in text, policy, chat, table and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.redaction import with_redaction
from cloakframe.operators import conversation as C
from cloakframe.operators import ledger as L
from cloakframe.operators import tables as T
from cloakframe.plans.checksql import spaced
from cloakframe.plans.conversations import CHAT, MESSAGES
from cloakframe.plans.governance import KEPT, PROMPTS, REDACTED, VERDICT, requests_of
from cloakframe.plans.portfolio import HEADERS, PORTFOLIO, VAULT
from cloakframe.plans.registry import plan
from cloakframe.plans.streams import utc
from cloakframe.rulebook import Rulebook, compile_rules
from cloakframe.sources.views import VIEWS, load
from cloakframe.streaming import jobs as J

DETECTOR_ROWS = "rank int, type string, cls string, sensitivity string, label string, pattern string, ignore_case boolean, value_group int, literals array<string>, check string"


def rules(spark: SparkSession) -> Rulebook:
    """A ticket number is internal and stays at home; a product column names a segment."""
    detectors = spark.createDataFrame([
        (1, "TICKET", "support", "internal", "Support ticket", r"\bticket ([0-9]{1,9})\b", True, 1, ["icket"], None),
        (2, "COLLEAGUE", "identity", "internal", "Assistant", r"\bassistant-[0-9]{1,4}\b", False, 0, None, None),
    ], DETECTOR_ROWS)
    headers = spark.createDataFrame([(1, "SEGMENT", "Customer segment", ["Product"])], "rank int, type string, label string, words array<string>")
    policy = spark.createDataFrame([("external-cloud", "internal", "block")], "dest string, tier string, rule string")
    return compile_rules(spark, detectors, headers, policy)


# A prompt of the last kind holds a ticket number and nothing else; the others are as they were.
TEXTS = "SELECT prompt_id, CASE WHEN prompt_id % 12 = 11 THEN 'No sensitive data in ticket [TICKET_1]' ELSE redacted END AS redacted FROM redacted"


@plan("rules_redact_text", spaced(PROMPTS, [KEPT, REDACTED], TEXTS))
def rules_redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_redaction(load(spark, sf_dir, "prompts"), detectors=rules(spark).detectors).select("prompt_id", "redacted")


@plan(
    "rules_policy",
    spaced(PROMPTS, [KEPT, REDACTED, VERDICT], """SELECT prompt_id, dest, CASE WHEN prompt_id % 12 = 11 THEN 'internal' ELSE tier END AS tier,
CASE WHEN prompt_id % 12 = 11 THEN 'block' ELSE decision END AS decision FROM verdict"""),
)
def rules_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assess(load(spark, sf_dir, "prompts"), rules(spark)).select("prompt_id", "dest", "tier", "decision")


@plan(
    "rules_redact_table",
    spaced(PORTFOLIO, [VAULT, """seg AS (SELECT segment, concat('[SEGMENT_', row_number() OVER (ORDER BY min(row_ord)), ']') AS mark FROM portfolio GROUP BY segment)"""],
           "SELECT r.* EXCLUDE (segment), s.mark AS segment FROM redacted r JOIN seg s ON s.segment = r.segment"),
)
def rules_redact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = load(spark, sf_dir, "portfolio"), rules(spark)
    vault = T.table_vault(rows, "row_ord", HEADERS, own)
    return T.redact_table(rows, "row_ord", vault, HEADERS, own)


@plan(
    "rules_chat",
    spaced(MESSAGES, CHAT, "SELECT conv_id, turn, concat(redacted, ' [COLLEAGUE_1]') AS redacted, protected_count + 1 AS protected_count FROM chat"),
)
def rules_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn names the same colleague, whom only the added rule knows."""
    named = F.concat("text", F.lit(" assistant-"), (F.col("conv_id") % 1000).cast("string"))
    talk = load(spark, sf_dir, "messages").withColumn("text", F.when(F.col("role") == "user", named).otherwise(F.col("text")))
    return C.redact_conversations(talk, rules(spark)).select("conv_id", "turn", "redacted", "protected_count")


@plan(
    "stream_rules_screen",
    spaced(PROMPTS, [KEPT, REDACTED, VERDICT], f"""SELECT t.prompt_id AS id, t.redacted AS prompt_redacted, CASE WHEN t.prompt_id % 12 = 11 THEN 'block' ELSE decision END AS decision
FROM ({TEXTS}) t JOIN verdict v ON v.prompt_id = t.prompt_id"""),
)
def stream_rules_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    J.spread(J.read_stream(spark, sf_dir, "customer")).createOrReplaceTempView("customer_screened")
    prompts = spark.sql(VIEWS["prompts"].replace("@customer", "customer_screened"))
    return J.run_available(J.screen_requests(requests_of(prompts), rules(spark)), "screened").select("id", "prompt_redacted", "decision")
