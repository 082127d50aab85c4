"""The screening profile: every match gets its own number, first textual occurrence replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.catalogue import SCREENING, WARNING_WORDS
from cloakframe.functions.redaction import placeholder, settled, splice, with_spans
from cloakframe.functions.spans import catalogue_field
from cloakframe.functions.text import has_any


def with_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``findings``: struct(type, placeholder, start, value) in text order.

    Equal values get different placeholders.  The number of a finding is its place among those of its detector, found by sorting.
    """
    found = with_spans(df, text, SCREENING, ranked=False)
    by_det = F.expr("sort_array(transform(spans, (s, i) -> struct(s.det AS det, i AS i)))")
    before = F.expr(f"transform(sequence(0, {len(SCREENING) - 1}), d -> size(filter(by_det, o -> o.det < d)))")
    numbers = F.expr("transform(sort_array(transform(by_det, (o, k) -> struct(o.i AS i, k - before[o.det] + 1 AS n))), x -> x.n)")
    # What a lambda looks up is settled first: Spark would otherwise work it out again for every element.
    numbered = settled(settled(settled(found, by_det, "by_det"), before, "before"), numbers, "numbers")

    def finding(span: Column, i: Column) -> Column:
        kind = catalogue_field(span["det"], SCREENING, "type")
        mark = placeholder(kind, F.get(F.col("numbers"), i))
        return F.struct(kind.alias("type"), mark.alias("placeholder"), span["start"].alias("start"), span["value"].alias("value"))

    return settled(numbered, F.transform("spans", finding), "findings").drop("spans", "by_det", "before", "numbers")


def replace_first(text: Column, target: Column, replacement: Column) -> Column:
    at = F.position(target, text)
    return F.when(at == 0, text).otherwise(
        F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(target), F.length(text)))
    )


def screened_text(text: Column, findings: Column) -> Column:
    """The text with the first occurrence of each finding's value replaced, one finding after the other.

    Where values occur nowhere but at their findings, and cannot come about in placeholders, that is the text with its findings
    replaced in place, which takes one pass.
    """
    values = F.array_distinct(F.transform(findings, lambda f: f["value"]))
    occurring = F.aggregate(
        values, F.lit(0), lambda n, v: n + F.floor((F.octet_length(text) - F.octet_length(F.replace(text, v, F.lit("")))) / F.octet_length(v)).cast("int"))
    like_marks = F.exists(values, lambda v: v.rlike(r"[\[\]]|^([A-Z_]+[0-9]*|_?[0-9]{1,7})$"))
    in_place = splice(text, findings, lambda f, _i: f["placeholder"])
    one_by_one = F.aggregate(findings, text, lambda out, f: replace_first(out, f["value"], f["placeholder"]))
    return F.when((F.size(findings) > 1) & (occurring == F.size(findings)) & ~like_marks, in_place).otherwise(one_by_one)


def is_warning(text: Column) -> Column:
    return has_any(F.coalesce(text, F.lit("")), f"(?:{WARNING_WORDS})")


def rollup(messages: DataFrame) -> DataFrame:
    """Per conversation: values guarded in all messages, and messages that are not transient."""
    return messages.groupBy("conv_id").agg(
        F.sum(F.size("findings")).cast("long").alias("protected_count"),
        F.count_if(F.col("role") != "system").alias("message_count"),
    )
