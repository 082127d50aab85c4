"""Mixing sources to target weights: a budget handed down a tree, then a seeded token-prefix of each leaf.

The tree has one level per column of ``levels`` (domain, language, source).  A node's children get shares of its budget in
proportion to their weights, but none more than its subtree can give (tokens times ``max_epochs``); what one cannot use goes
to its siblings by weight, and only what the whole family cannot use goes back to the parent's siblings.  A leaf
takes whole epochs, then the longest prefix of one more epoch whose tokens fit what is left.  An epoch is an order of the
leaf's rows by a seeded hash of epoch and doc_id.

Only column expressions, joins and aggregates.  Rows of a leaf are counted in hash slices of some thousand rows; a
window runs over a leaf's slices and over the rows of the one slice that the budget cuts, never over a leaf.  Rows
then meet one row per leaf, so texts are not shuffled.

Defined cases: a null in a level column is the node '' of its level; a null or empty text has one token at least; a
null doc_id hashes as ''; rows that repeat an id in a leaf have the same place, so they are taken or left together; a weight
of 0 excludes a node; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialise

SLICE_ROWS = 4096
EXACT = "decimal(38,0)"


def text_tokens(text: str = "text") -> Column:
    """An estimate that needs no vocabulary: a token for each four code points begun, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def node(level: str) -> Column:
    return F.coalesce(F.col(level).cast("string"), F.lit(""))


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    known = F.coalesce(*[F.when(F.col(level) == name, F.lit(w)) for name, w in weights.items()], F.lit(1)) if weights else F.lit(1)
    return known.cast(EXACT)


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """Add ``budget`` (tokens) to leaves that have ``levels`` and ``tokens``: one row per leaf, no more than the tree has."""
    tree = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(EXACT))
    for depth, level in enumerate(levels):  # what the weight of a node, or of one above it, excludes cannot be given
        tree = tree.withColumn("cap", F.when(weight_of(level, weights.get(level, {})) > 0, F.col("cap")).otherwise(F.lit(0).cast(EXACT)))
    given = tree.agg(F.least(F.lit(budget).cast(EXACT), F.sum("cap")).alias("given"))
    for depth, level in enumerate(levels):
        path, parent = list(levels[: depth + 1]), list(levels[:depth])
        nodes = tree.groupBy(*path).agg(F.sum("cap").cast(EXACT).alias("cap")).withColumn("weight", weight_of(level, weights.get(level, {})))
        nodes = nodes.where("weight > 0")
        nodes = nodes.join(given, parent) if parent else nodes.crossJoin(given)  # one row
        family = Window.partitionBy(*parent)
        by_need = family.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), level)
        nodes = (
            nodes.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(EXACT))
            .withColumn("weights_left", F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(EXACT))
            # Full if giving everyone left as much per weight as this child can use would still fit.
            .withColumn("full", F.col("caps_before") * F.col("weight") + F.col("cap") * F.col("weights_left") <= F.col("given") * F.col("weight"))
            .withColumn("full_caps", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)).cast(EXACT))
            .withColumn("open_weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(1)).cast(EXACT))
        )
        share = F.expr("CAST((given - full_caps) * weight DIV open_weight AS DECIMAL(38,0))")
        given = nodes.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("given"))
    return leaves.join(given, list(levels)).withColumn("budget", F.col("given").cast("long")).drop("given")


def place(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(
    documents: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float, seed: int = 17, max_epochs: int = 1,
    tokens: Column | None = None,
) -> DataFrame:
    """The chosen rows with all columns, ``tokens`` and ``epoch`` (from 0); the budget is ``share`` of all tokens, rounded down."""
    levels = list(levels)
    names = [f"_{level}" for level in levels]
    named = documents.withColumns({"tokens": text_tokens() if tokens is None else tokens} | {n: node(c) for n, c in zip(names, levels)})
    slim = materialise(named.select("doc_id", "tokens", *names))
    leaves = materialise(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    level_weights = {f"_{level}": w for level, w in weights.items()}
    budgets = leaf_budgets(leaves, names, level_weights, int(total * share), max_epochs).where("budget > 0")
    plan = materialise(budgets.select(
        *names,
        F.expr("budget DIV tokens").alias("whole"),
        F.expr("budget % tokens").alias("rest"),
        # Slices of the hash's first 16 bits, a power of two of them, enough for the leaf's rows.
        F.expr(f"CAST(65536 / pow(2, least(16, ceil(log2(1 + n / {SLICE_ROWS})))) AS bigint)").alias("width"),
    ))
    placed = slim.join(plan.where("rest > 0"), names).withColumn("place", place(seed, F.col("whole")))
    placed = placed.withColumn("slice", F.expr("CAST(conv(substr(place, 1, 4), 16, 10) AS bigint) DIV width"))
    slices = placed.groupBy(*names, "slice").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*names).orderBy("slice")
    cut_slice = (
        slices.withColumn("to_here", F.sum("tokens").over(run)).where("to_here > rest")
        .groupBy(*names).agg(F.min_by(F.struct("slice", (F.col("to_here") - F.col("tokens")).alias("ahead")), "slice").alias("cut"))
        .select(*names, F.col("cut.slice").alias("cut_slice"), F.col("cut.ahead").alias("ahead"))
    )
    here = placed.join(cut_slice, names).where("slice = cut_slice")
    inside = Window.partitionBy(*names).orderBy("place")  # rows of one place come together
    last = (
        here.withColumn("to_here", F.col("ahead") + F.sum("tokens").over(inside)).where("to_here <= rest")
        .groupBy(*names).agg(F.max("place").alias("last_place"))
    )
    cuts = materialise(plan.join(cut_slice.select(*names, "cut_slice"), names, "left").join(last, names, "left"))
    place_here = place(seed, F.col("whole"))
    slice_here = F.expr("CAST(conv(substr(_place, 1, 4), 16, 10) AS bigint) DIV width")
    chosen = named.join(cuts, names).withColumn("_place", place_here).withColumn("_slice", slice_here)
    extra = (F.col("rest") > 0) & ((F.col("_slice") < F.col("cut_slice")) | ((F.col("_slice") == F.col("cut_slice")) & (F.col("_place") <= F.col("last_place"))))
    epochs = F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    chosen = chosen.withColumn("_epochs", epochs).where("_epochs > 0")
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1))).select(*documents.columns, "tokens", "epoch")
