"""Bilingual customer letters from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.rules import grouped_number, plain_number
from cloakframe.operators.responders import fill


def draft_targets(figures: DataFrame) -> DataFrame:
    """Every overdue row, or all rows when none is overdue."""
    any_late = figures.agg(F.coalesce(F.max(F.col("dpd") > 0), F.lit(False)).alias("any_late"))
    flagged = figures.crossJoin(F.broadcast(any_late))  # one row
    return flagged.where("dpd > 0 OR NOT any_late").drop("any_late")


def letters(targets: DataFrame, name: str, has_debt: bool = True) -> DataFrame:
    """Add ``en`` and ``ar`` for rows with ``dpd`` and ``debt``."""
    days = plain_number(F.col("dpd"))

    def letter(body: str, late: str) -> Column:
        clause = F.when(F.col("dpd") != 0, fill(late, {"days": days})).otherwise("")
        amount = grouped_number(F.col("debt")) if has_debt else F.lit("")
        return fill(body, {"id": F.coalesce(name, F.lit("")), "amount": amount, "late": clause})

    return targets.withColumn("en", letter(c.LETTER_EN, c.LETTER_EN_LATE)).withColumn(
        "ar", letter(c.LETTER_AR, c.LETTER_AR_LATE)
    )


def headline(count: Column, instruction: Column, overdue_only: Column) -> Column:
    what = F.when(instruction.rlike(f"(?i){c.REMINDER_WORDS}"), "payment reminder").otherwise("message")
    return F.concat(
        F.lit("Drafted "),
        count.cast("string"),
        F.lit(" bilingual "),
        what,
        F.when(count == 1, "").otherwise("s"),
        F.when(overdue_only, " for every overdue account").otherwise(""),
        F.lit(" — English and Arabic."),
    )
