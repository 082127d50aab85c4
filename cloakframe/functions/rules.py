"""Scalar rules: header classification, lenient numbers, risk tiers, routing, JSON replies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.text import trim_space


def header_key(header: Column) -> Column:
    return F.lower(trim_space(F.coalesce(header, F.lit(""))))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def header_type(header: Column, rules=c.HEADER_RULES) -> Column:
    """Identity type of a column header, or null: the first rule with a contained keyword."""
    key = header_key(header)
    chain = F.when(key == "", F.lit(None).cast("string"))
    for kind, _label, words in rules:
        chain = chain.when(contains_any(key, words), kind)
    return chain


def type_label(kind: Column, rules=c.HEADER_RULES) -> Column:
    chain = None
    for name, label, _words in rules:
        chain = F.when(kind == name, label) if chain is None else chain.when(kind == name, label)
    return chain


def classify_names(headers: dict[str, str], rules=c.HEADER_RULES) -> dict[str, tuple[str, str]]:
    """The same rule for the headers of one table: column to (type, label)."""
    found = {}
    for column, header in headers.items():
        key = header.strip().lower()
        for kind, label, words in rules:
            if key and any(word in key for word in words):
                found[column] = (kind, label)
                break
    return found


def finance_names(headers: dict[str, str]) -> dict[str, str | None]:
    """First column whose header holds a finance hint, per figure."""
    return {
        figure: next((col for col, head in headers.items() if any(h in head.strip().lower() for h in hints)), None)
        for figure, hints in c.FINANCE_HINTS.items()
    }


def figure_clashes(headers: dict[str, str]) -> list[str]:
    """Columns that count both as an identity and as a figure; figures are read before redaction."""
    figures = set(finance_names(headers).values())
    return [column for column in classify_names(headers) if column in figures]


def to_number(cell: Column) -> Column:
    """Keep digits, dot and minus; anything that is then not a finite number counts as 0."""
    kept = F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), "[^0-9.-]", "")
    value = F.when(kept.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), kept.try_cast("double"))
    return F.when(value.isNull() | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def debt_to_income(debt: Column, income: Column) -> Column:
    return F.when(income > 0, debt / (income * 12)).when(debt > 0, 99.0).otherwise(0.0)


def risk_tier(days: Column, dti: Column) -> Column:
    return (
        F.when((days >= 90) | (dti >= 0.6), "High risk")
        .when((days >= 30) | (dti >= 0.35), "Medium risk")
        .otherwise("Low risk")
    )


def tier_order(tier: Column) -> Column:
    chain = None
    for name, rank, _rule in c.TIER_RULES:
        chain = F.when(tier == name, rank) if chain is None else chain.when(tier == name, rank)
    return chain.otherwise(9)


def tier_rule(tier: Column) -> Column:
    chain = None
    for name, _rank, rule in c.TIER_RULES:
        chain = F.when(tier == name, rule) if chain is None else chain.when(tier == name, rule)
    return chain


def task_of(instruction: Column) -> Column:
    """``draft`` when a drafting word stands alone in the instruction, else ``group``."""
    words = rf"(?i)(?<!\w)(?:{'|'.join(c.DRAFT_WORDS)})(?!\w)"
    return F.when(F.coalesce(instruction, F.lit("")).rlike(words), "draft").otherwise("group")


def plain_number(value: Column) -> Column:
    """A number as text without exponent or trailing zeros."""
    short = value.cast("string")
    spelled = short.cast("decimal(38,18)").cast("string")
    digits = F.when(F.contains(short, F.lit("E")), F.regexp_replace(spelled, "0+$", "")).otherwise(short)
    return F.regexp_replace(digits, r"\.0?$", "")


def grouped_number(value: Column) -> Column:
    """Thousands separators and at most three decimals."""
    return F.call_function("format_number", value, F.lit("#,##0.###"))


def csv_cell(cell: Column) -> Column:
    text = F.coalesce(cell, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def reply_json(reply: Column) -> Column:
    """The JSON object inside a model reply as text, or null: fences off, first ``{`` to last ``}``."""
    text = trim_space(F.coalesce(reply, F.lit("")))
    open_fence = rf"(?i)\A```(?:json)?{c.SPACE}*+"
    bare = F.regexp_replace(F.regexp_replace(text, open_fence, ""), rf"(?<!{c.SPACE}){c.SPACE}*+```\z", "")

    def cut(bare: Column) -> Column:
        first = F.position(F.lit("{"), bare)
        from_end = F.position(F.lit("}"), F.reverse(bare))
        last = F.length(bare) - from_end + 1
        return F.when((first > 0) & (from_end > 0) & (last >= first), F.substring(bare, first, last - first + 1))

    # Through a lambda, so that the text is stripped once and not once per place that reads it.
    return F.transform(F.array(bare), cut)[0]
