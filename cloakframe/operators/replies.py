"""Model replies as VARIANT: groupings and drafts without a fixed schema, restored part by part.

A reply that holds no JSON object gives no rows.  Within an object every field is read on its own: one of another type than expected
counts as missing, an entry that is no object is left out, and the sound ones beside it stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.rules import reply_json
from cloakframe.functions.text import trim_space
from cloakframe.operators.restore import restore_text


def reply_object(text: Column) -> Column:
    """The object inside a reply as VARIANT, or null."""
    return F.try_parse_json(reply_json(text))


def entries(value: Column, field: str) -> Column:
    """The elements of an array field; none if it is no array."""
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def scalar(value: Column) -> Column:
    """A string, number or truth value as text; null for anything else."""
    return F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(value, "$", "string"))


def field(value: Column, name: str) -> Column:
    """A field as text, '' where it is missing."""
    return F.coalesce(scalar(F.try_variant_get(value, f"$.{name}", "variant")), F.lit(""))


def grouping_rows(replies: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row per group of each reply: order, headline, g_ord, tier, rule, summary, members (as they stand), count."""
    objects = replies.select(order, reply_object(F.col(text)).alias("reply"))
    groups = objects.select(order, field(F.col("reply"), "headline").alias("headline"), F.posexplode(entries(F.col("reply"), "groups")).alias("g_ord", "g"))
    members = F.filter(F.transform(entries(F.col("g"), "members"), scalar), lambda m: m.isNotNull())
    rows = groups.where(is_object(F.col("g"))).select(
        order, "headline", "g_ord", F.nullif(field(F.col("g"), "tier"), F.lit("")).alias("tier"), field(F.col("g"), "rule").alias("rule"),
        field(F.col("g"), "summary").alias("summary"), members.alias("members"))
    return rows.withColumn("count", F.size("members").cast("long"))


def draft_rows(replies: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row per draft of each reply: order, d_ord, id (else its name), en, ar."""
    objects = replies.select(order, reply_object(F.col(text)).alias("reply"))
    drafts = objects.select(order, F.posexplode(entries(F.col("reply"), "drafts")).alias("d_ord", "d")).where(is_object(F.col("d")))
    called = F.coalesce(F.nullif(field(F.col("d"), "id"), F.lit("")), field(F.col("d"), "name"))
    return drafts.select(order, "d_ord", called.alias("id"), field(F.col("d"), "en").alias("en"), field(F.col("d"), "ar").alias("ar"))


def _restored(parts: DataFrame, key: list[str], vault: DataFrame) -> DataFrame:
    """Each part is a text of its own, so that no value can reach into another part."""
    return restore_text(parts, [*key, "_part", "_place"], [], "_text", vault, "_clear", nested=True)


def _parts(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    texts = F.explode(F.create_map(*[x for name in names for x in (F.lit(name), F.col(name))])).alias("_part", "_text")
    return rows.select(*key, texts).withColumn("_place", F.lit(0))


def _clear(name: str) -> Column:
    return F.max(F.when(F.col("_part") == name, F.col("_clear")))


def restored_groups(groups: DataFrame, order: str, vault: DataFrame) -> DataFrame:
    """The groups with headline and summary restored; members are rows of ``restored_members``.

    ``vault`` has ord, placeholder and value.
    """
    key, names = [order, "g_ord"], ["headline", "summary"]
    clear = _restored(_parts(groups, key, names), key, vault).groupBy(*key).agg(*[_clear(name).alias(name) for name in names])
    return groups.drop("members", *names).join(clear, key)


def restored_members(groups: DataFrame, order: str, vault: DataFrame) -> DataFrame:
    """One row per member of a group, restored: order, g_ord, tier, m_ord, member."""
    key = [order, "g_ord"]
    parts = groups.select(*key, "tier", F.lit("member").alias("_part"), F.posexplode("members").alias("_place", "_text"))
    return _restored(parts, key, vault).select(*key, "tier", F.col("_place").alias("m_ord"), F.col("_clear").alias("member"))


def restored_drafts(drafts: DataFrame, order: str, vault: DataFrame) -> DataFrame:
    """Letters from the drafts: order, d_ord, name, en, ar, with real values."""
    key = [order, "d_ord"]
    called = F.coalesce(F.nullif(_clear("id"), F.lit("")), F.lit(c.NO_NAME))
    return _restored(_parts(drafts, key, ["id", "en", "ar"]), key, vault).groupBy(*key).agg(called.alias("name"), _clear("en").alias("en"), _clear("ar").alias("ar"))


def tiers_of(groups: DataFrame, order: str, name: str) -> DataFrame:
    """Tier per member placeholder over all groups; the last mention wins."""
    members = groups.select(order, "g_ord", "tier", F.posexplode("members").alias("m_ord", "m"))
    return members.groupBy(trim_space(F.col("m")).alias(name)).agg(F.max_by("tier", F.struct(order, "g_ord", "m_ord")).alias("tier"))
