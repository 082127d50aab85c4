"""Masked display forms of protected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.catalogue import SPACE, WORD_MASKED_TYPES

BULLET = "•"


def _bullets(count: Column) -> Column:
    return F.repeat(F.lit(BULLET), count)


def mask_value(entity_type: Column, value: Column) -> Column:
    """First letter and domain of an email, first letter of each word, or the last three characters."""
    halves = F.split(value, "@", -1)
    user = halves[0]
    email = F.concat(
        F.substring(user, 1, 1),
        _bullets(F.greatest(F.lit(2), F.length(user) - 1)),
        F.lit("@"),
        F.coalesce(F.get(halves, F.lit(1)), F.lit("")),
    )
    by_word = F.array_join(
        F.transform(
            F.split(value, SPACE + "+", -1),
            lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), _bullets(F.length(w) - 1))).otherwise(w),
        ),
        " ",
    )
    tail = F.concat(F.lit(BULLET * 4), F.right(F.regexp_replace(value, SPACE, ""), F.lit(3)))
    return (
        F.when(entity_type == "EMAIL", email)
        .when(entity_type.isin(*WORD_MASKED_TYPES), by_word)
        .otherwise(tail)
    )
