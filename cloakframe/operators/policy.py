"""Destination policy: sensitivity tier and data classes against where a request goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.text import capitalise
from cloakframe.rulebook import BUILT_IN, Rulebook


def policy_table(spark: SparkSession, rules=c.POLICY) -> DataFrame:
    rows = ", ".join(f"('{d}', '{t}', '{decision}')" for d, t, decision in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(dest, tier, rule)")


def blocked_class(classes: Column) -> Column:
    """First class that may never leave, or null."""
    return F.get(F.filter(classes, lambda name: name.isin(*c.NEVER_EXTERNAL)), F.lit(0))


def decide(df: DataFrame, destination: str, sensitivity: str, classes: str, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Add ``dest``, ``tier``, ``decision`` and ``reason``.

    The rule table is bounded, see ``rulebook``, so it is broadcast; a pair without a rule is allowed.
    """
    known = rules.destinations()
    prepared = df.withColumn(
        "dest", F.when(F.col(destination).isin(*known), F.col(destination)).otherwise(c.DEFAULT_DESTINATION)
    ).withColumn("tier", F.coalesce(F.col(sensitivity), F.lit("none")))
    joined = prepared.join(F.broadcast(policy_table(df.sparkSession, rules.policy)), ["dest", "tier"], "left")
    external = F.col("dest") != c.DEFAULT_DESTINATION
    never = F.when(external, blocked_class(F.col(classes)))
    decision = F.when(never.isNotNull(), "block").otherwise(F.coalesce("rule", F.lit("allow")))
    who = capitalise(F.col("tier"))
    reason = (
        F.when(never.isNotNull(), F.concat(F.lit(c.REASON_BLOCKED_CLASS[0]), never, F.lit(c.REASON_BLOCKED_CLASS[1])))
        .when(F.col("rule") == "require-approval", F.concat(who, F.lit(c.REASON_APPROVAL)))
        .when(F.col("rule") == "block", F.concat(who, F.lit(c.REASON_NOT_PERMITTED)))
        .when(~external, c.REASON_SOVEREIGN)
        .otherwise(F.concat(who, F.lit(c.REASON_PERMITTED)))
    )
    return joined.withColumn("decision", decision).withColumn("reason", reason).drop("rule")


def status_of(decision: Column) -> Column:
    chain = None
    for name, status in c.STATUS_OF_DECISION.items():
        chain = F.when(decision == name, status) if chain is None else chain.when(decision == name, status)
    return chain
