"""Redaction of one text to typed placeholders, and the facts derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.catalogue import DETECTORS, RANK_TIER, TIER_RANK, Detector
from cloakframe.functions.masking import mask_value
from cloakframe.functions.spans import BLOCK, all_spans, catalogue_field, gate_flags, resolve_overlaps

PLACEHOLDER = r"\[[A-Z]+_[0-9]+\]"


def placeholder(entity_type: Column, index: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_"), index.cast("string"), F.lit("]"))


def splice(text: Column, spans: Column, replacement) -> Column:
    """Rebuild a text with each span replaced; ``replacement`` maps (span, index) to a string.

    A place in a text is found by counting from its start, so the text is first cut into the stretches of ``BLOCK`` spans each
    and the gaps are cut out of those.
    """

    def end_of(i: Column) -> Column:
        span = F.get(spans, i)
        return F.coalesce(span["start"] + F.length(span["value"]), F.lit(0))

    def block(b: Column) -> Column:
        low = b * BLOCK
        high = F.least(low + BLOCK, F.size(spans)) - 1
        begin = end_of(low - 1)
        stretch = F.struct(begin.alias("begin"), F.substring(text, begin + 1, end_of(high) - begin).alias("text"))

        def pieces(part: Column) -> Column:
            def piece(i: Column) -> Column:
                prev_end, span = end_of(i - 1), F.get(spans, i)
                return F.concat(F.substring(part["text"], prev_end - part["begin"] + 1, span["start"] - prev_end), replacement(span, i))

            return F.array_join(F.transform(F.sequence(low, high), piece), "")

        return F.transform(F.array(stretch), pieces)[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    tail = F.substring(text, end_of(F.size(spans) - 1) + 1, F.length(text))
    spliced = F.concat(F.array_join(F.transform(blocks, block), ""), tail)
    return F.when(F.size(spans) == 0, text).otherwise(spliced)


def with_spans(
    df: DataFrame, text: str = "text", detectors: Sequence[Detector] = DETECTORS, ranked: bool = True
) -> DataFrame:
    """Add ``spans``: the resolved, non-overlapping entities of each text.

    Each step is its own projection, so Spark evaluates every regex pass once.
    """
    found = df.withColumn("gates", gate_flags(text, detectors)).withColumn(
        "raw_spans", all_spans(text, "gates", detectors, ranked)
    )
    return settled(found, resolve_overlaps("raw_spans"), "spans").drop("gates", "raw_spans")


def settled(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column so that later filters read it instead of repeating its expression.

    Spark pushes a filter through a projection by copying the projected expression into
    the filter; it does not do so through a generator.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))


def with_redaction(df: DataFrame, text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Add ``spans``, ``entities`` (one per distinct value, with value) and ``redacted``.

    Placeholders are numbered per type by first appearance in the text.  Equal values are brought together by sorting, so a
    text with thousands of distinct values costs little more than its sort.
    """
    found = with_spans(df, text, detectors).withColumn(
        "by_value", F.expr("sort_array(transform(spans, (s, i) -> struct(s.det AS det, s.value AS value, i AS i)))")
    )
    # Where in that order another value begins, and where it ends.
    begun = found.withColumn("begins", F.expr("""
        filter(transform(zip_with(by_value, concat(array(CAST(NULL AS struct<det: int, value: string, i: int>)), slice(by_value, 1, greatest(size(by_value) - 1, 0))),
                                  (x, last) -> x IS NOT NULL AND NOT coalesce(x.det = last.det AND x.value = last.value, false)),
                         (new, k) -> IF(new, k, -1)), k -> k >= 0)"""))
    # One row per distinct value in (type, first place) order; its number is its place among those of its type.
    values = begun.withColumn("values", F.expr("""
        sort_array(transform(begins, (k, g) -> struct(by_value[k].det AS det, by_value[k].i AS i, g AS g, by_value[k].value AS value)))"""))
    # What a lambda looks up is settled first: Spark would otherwise work it out again for every element.
    before = F.expr(f"transform(sequence(0, {len(detectors) - 1}), d -> size(filter(values, v -> v.det < d)))")
    numbered = settled(values, before, "before").withColumn(
        "numbers", F.expr("transform(values, (v, k) -> struct(v.i AS i, v.g AS g, v.det AS det, v.value AS value, k - before[v.det] + 1 AS n))")
    )
    # The number of each span, back in the order of the text.
    of_group = F.expr("transform(sort_array(transform(numbers, x -> struct(x.g AS g, x.n AS n))), x -> x.n)")
    of_span = F.expr("""
        transform(sort_array(flatten(transform(begins, (k, g) -> transform(
            slice(by_value, k + 1, coalesce(get(begins, g + 1), size(by_value)) - k), x -> struct(x.i AS i, group_numbers[g] AS n))))), x -> x.n)""")
    marks = settled(settled(numbered, of_group, "group_numbers"), of_span, "marks")

    def entity(key: Column) -> Column:
        kind = catalogue_field(key["det"], detectors, "type")
        return F.struct(
            placeholder(kind, key["n"]).alias("placeholder"),
            kind.alias("type"),
            catalogue_field(key["det"], detectors, "cls").alias("cls"),
            catalogue_field(key["det"], detectors, "sensitivity").alias("sensitivity"),
            catalogue_field(key["det"], detectors, "label").alias("label"),
            mask_value(kind, key["value"]).alias("masked"),
            key["value"].alias("value"),
        )

    def mark(span: Column, i: Column) -> Column:
        return placeholder(catalogue_field(span["det"], detectors, "type"), F.get(F.col("marks"), i))

    done = marks.withColumn("entities", F.transform(F.sort_array("numbers"), entity)).withColumn(
        "redacted", splice(F.col(text), F.col("spans"), mark))
    return done.drop("by_value", "begins", "values", "before", "numbers", "group_numbers", "marks")


def entity_summary(entities: Column) -> Column:
    """The entities without their raw values: safe to store."""
    fields = ("placeholder", "type", "cls", "sensitivity", "label", "masked")
    return F.transform(entities, lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def top_sensitivity(entities: Column) -> Column:
    """Highest tier present, or null when there is no entity."""
    ranks = F.transform(entities, lambda e: _rank(e["sensitivity"]))
    return tier_name(F.array_max(ranks))


def _rank(tier: Column) -> Column:
    out = F.lit(0)
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def tier_rank(tier: Column) -> Column:
    return _rank(tier)


def tier_name(rank: Column) -> Column:
    chain = F.lit(None).cast("string")
    for number, name in RANK_TIER.items():
        chain = F.when(rank == number, name).otherwise(chain)
    return chain


def distinct_classes(entities: Column) -> Column:
    """Data classes in order of first appearance."""
    return F.array_distinct(F.transform(entities, lambda e: e["cls"]))


def placeholders_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def count_placeholders(text: Column) -> Column:
    return F.size(F.array_distinct(placeholders_in(text)))
