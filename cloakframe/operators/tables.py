"""Customer tables: redact identity columns, tier rows by risk, render and restore."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.masking import mask_value
from cloakframe.functions.redaction import placeholder, settled
from cloakframe.functions.rules import (
    classify_names,
    csv_cell,
    debt_to_income,
    finance_names,
    plain_number,
    reply_json,
    risk_tier,
    tier_order,
    tier_rule,
    to_number,
    type_label,
)
from cloakframe.operators.numbering import number_rows
from cloakframe.rulebook import BUILT_IN, Rulebook
from cloakframe.session import materialise


def _headers(df: DataFrame, order: str, headers: Mapping[str, str] | None) -> dict[str, str]:
    return {col: (headers or {}).get(col, col) for col in df.columns if col != order}


def identity_cells(df: DataFrame, order: str, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN) -> DataFrame:
    """One row per non-empty cell of an identity column: order, col_ord, type, value."""
    names = _headers(df, order, headers)
    found = classify_names(names, rules.headers)
    cells = [
        F.struct(F.lit(i).alias("col_ord"), F.lit(found[col][0]).alias("type"), F.col(col).cast("string").alias("value"))
        for i, col in enumerate(names)
        if col in found
    ]
    if not cells:
        raise ValueError("no column header names an identity")
    return df.select(order, F.inline(F.array(*cells))).where("value IS NOT NULL AND value <> ''")


def table_vault(df: DataFrame, order: str, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN) -> DataFrame:
    """Placeholder per (type, cell), numbered per type by first appearance in row-major order.

    Columns of the same type share their numbers.  One shuffle aggregates equal cells (with
    map-side combine, so a value in a third of all rows is no hot spot); numbering is
    range-partitioned.
    """
    cells = identity_cells(df, order, headers, rules)
    first = cells.groupBy("type", "value").agg(F.min(F.struct(order, "col_ord")).alias("first"))
    flat = first.select("type", "value", F.col(f"first.{order}").alias("first_row"), F.col("first.col_ord").alias("first_col"))
    numbered = number_rows(flat, ["type"], ["first_row", "first_col"], "idx")
    return numbered.select(
        placeholder(F.col("type"), F.col("idx")).alias("placeholder"),
        "type",
        type_label(F.col("type"), rules.headers).alias("label"),
        "value",
        mask_value(F.col("type"), F.col("value")).alias("masked"),
        "idx",
        "first_row",
        "first_col",
    )


def redact_table(
    df: DataFrame, order: str, vault: DataFrame, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN
) -> DataFrame:
    """The table with identity cells replaced by the placeholders of its vault.

    All identity cells travel in one narrow join instead of one wide join per column; Spark
    broadcasts the vault when its measured size allows and splits hot values otherwise.
    """
    names = _headers(df, order, headers)
    found = classify_names(names, rules.headers)
    at = {col: i for i, col in enumerate(names)}
    marked = identity_cells(df, order, headers, rules).join(vault.select("type", "value", "placeholder"), ["type", "value"])
    per_row = marked.groupBy(order).agg(
        *[F.max(F.when(F.col("col_ord") == at[col], F.col("placeholder"))).alias(f"mark_{at[col]}") for col in found]
    )
    joined = df.join(per_row, order, "left")
    return joined.select(
        order,
        *[F.coalesce(f"mark_{at[col]}", F.col(col).cast("string")).alias(col) if col in found else F.col(col) for col in names],
    )


def summarise_vault(vault: DataFrame) -> DataFrame:
    """Per type: label, number of protected values, first masked sample, in first-seen order."""
    place = F.struct("first_row", "first_col")
    return (
        vault.groupBy("type", "label")
        .agg(F.count("*").alias("count"), F.min_by("masked", place).alias("sample"), F.min(place).alias("seen"))
        .orderBy("seen")
        .drop("seen")
    )


def with_figures(df: DataFrame, order: str, headers: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``dpd``, ``debt`` and ``income`` as numbers, read before redaction."""
    found = finance_names(_headers(df, order, headers))

    def figure(name: str) -> Column:
        return to_number(F.col(found[name])) if found[name] else F.lit(0.0)

    return (
        df.withColumn("dpd", figure("days_past_due"))
        .withColumn("debt", figure("debt"))
        .withColumn("income", figure("income"))
    )


def with_risk(df: DataFrame, order: str, headers: Mapping[str, str] | None = None) -> DataFrame:
    """Add the figures, ``dti`` and ``tier`` per row."""
    figures = with_figures(df, order, headers)
    rated = figures.withColumn("dti", debt_to_income(F.col("debt"), F.col("income")))
    return rated.withColumn("tier", risk_tier(F.col("dpd"), F.col("dti")))


def tier_summary(rated: DataFrame) -> DataFrame:
    """One row per tier that occurs; the members stay rows of ``rated``."""
    groups = rated.groupBy("tier").agg(F.count("*").alias("count"))
    return groups.select(
        "tier",
        tier_rule(F.col("tier")).alias("rule"),
        "count",
        F.concat(F.col("count").cast("string"), F.lit(" customer(s) in this tier.")).alias("summary"),
    )


def addressee(df: DataFrame, order: str, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN) -> str | None:
    """The column a customer is called by: the first name column, else the first column of all."""
    names = _headers(df, order, headers)
    found = classify_names(names, rules.headers)
    return next((col for col in names if col in found and found[col][0] == "NAME"), next(iter(names), None))


def tier_grouping(rated: DataFrame, order: str, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN) -> DataFrame:
    """The grouping by rules, one row per member: headline, tier, rule, summary, count, order, member.

    ``rated`` has the columns of the table and ``tier``.  Counts are three rows at most; members are never gathered.
    """
    table = rated.select(*[col for col in rated.columns if col not in ("tier", "dpd", "debt", "income", "dti")])
    called = addressee(table, order, headers, rules)
    member = F.coalesce(F.col(called).cast("string"), F.lit("")) if called else F.lit("")
    rows = rated.select("tier", order, member.alias("member"))
    return rows.join(F.broadcast(tier_summary(rated)), "tier").withColumn("headline", F.lit(c.GROUPING_HEADLINE))


def tier_by_name(rated: DataFrame, name: str) -> DataFrame:
    """One tier per name: tiers are written High, Medium, Low, and the last writer wins."""
    return (
        rated.groupBy(name)
        .agg(F.max(F.struct(tier_order(F.col("tier")).alias("rank"), "tier")).alias("last"))
        .select(name, F.col("last.tier").alias("tier"), F.col("last.rank").cast("long").alias("rank"))
    )


def tier_rows(df: DataFrame, name: str, tiers: DataFrame) -> DataFrame:
    """Rows with the tier of their name, ``Unclassified`` when it has none."""
    joined = df.drop("tier").join(tiers.select(name, "tier"), name, "left")
    return joined.withColumn("tier", F.coalesce("tier", F.lit(c.UNCLASSIFIED)))


def sort_by_tier(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(tier_order(F.col("tier")), order)


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """A row as one CSV line; a cell is quoted when it holds a comma, quote or line break."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cells = [csv_cell(plain_number(F.col(col)) if col in numeric else F.col(col).cast("string")) for col in columns]
    return F.concat_ws(",", *cells)


def csv_header(names: list[str]) -> str:
    return ",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if any(ch in n for ch in '",\n') else n for n in names)


def prompt_batches(
    redacted: DataFrame, order: str, columns: list[str], head: str, task: str, tail: str, batch_rows: int
) -> DataFrame:
    """Prompts of at most ``batch_rows`` redacted rows each, covering the whole table.

    A table of up to ``batch_rows`` rows gives one prompt.
    """
    lines = redacted.select(order, csv_lines(redacted, columns).alias("line"))
    numbered = number_rows(lines, [], [order], "seq")
    batch = F.floor((F.col("seq") - 1) / batch_rows).alias("batch")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    prompt = F.concat(F.lit(f"{head}{csv_header(columns)}\n"), body, F.lit(f"\n\nTASK: {task}{tail}"))
    return numbered.groupBy(batch).agg(F.count("*").alias("n_rows"), prompt.alias("prompt"))


GROUPING_SCHEMA = "headline string, groups array<struct<tier:string,rule:string,members:array<string>,summary:string>>"


def parse_replies(replies: DataFrame, text: str = "text") -> DataFrame:
    """Add ``json`` (the object in the reply, null when there is none that parses) and ``grouping``."""
    body = settled(replies, reply_json(F.col(text)), "_body").drop("json", "grouping")
    checked = settled(body, F.when(F.try_parse_json("_body").isNotNull(), F.col("_body")), "json").drop("_body")
    return settled(checked, F.from_json("json", GROUPING_SCHEMA), "grouping")


def reply_tiers(parsed: DataFrame, order: str, name: str) -> DataFrame:
    """Tier per member placeholder over all grouping replies; the last mention wins."""
    groups = parsed.select(order, F.posexplode("grouping.groups").alias("g_ord", "g"))
    members = groups.select(order, "g_ord", F.col("g.tier").alias("tier"), F.posexplode("g.members").alias("m_ord", "m"))
    last = F.max_by("tier", F.struct(order, "g_ord", "m_ord"))
    return members.groupBy(F.trim("m").alias(name)).agg(last.alias("tier"))


def stored_vault(df: DataFrame, order: str, headers: Mapping[str, str] | None = None, rules: Rulebook = BUILT_IN) -> DataFrame:
    """The vault, numbered once and kept, for plans that read it several times."""
    return materialise(table_vault(df, order, headers, rules))
