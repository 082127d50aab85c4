"""Put protected values back in place of their placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.redaction import PLACEHOLDER, placeholders_in
from cloakframe.session import materialise


def restore_from(text: Column, entries: Column) -> Column:
    """Replace placeholder by value, one vault entry after the other.

    A restored value that itself holds a later placeholder is replaced again.
    """
    return F.aggregate(
        entries, F.coalesce(text, F.lit("")), lambda out, e: F.replace(out, e["placeholder"], e["value"])
    )


def _pieces(text: Column, live: Column) -> Column:
    """A text as pieces (s, live): plain stretches and placeholders in turn; those in ``live`` are to be replaced."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.split(text, PLACEHOLDER)
    plain = lambda s: F.struct(s.alias("s"), F.lit(False).alias("live"))
    mark = lambda t: F.struct(t.alias("s"), F.array_contains(live, t).alias("live"))
    later = F.zip_with(tokens, F.slice(gaps, F.lit(2), F.size(gaps)), lambda t, g: F.array(mark(t), plain(g)))
    return F.concat(F.array(plain(gaps[0])), F.flatten(later))


def _open(parts: str) -> Column:
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p["live"]), lambda p: p["s"]))


def _in_pieces(nodes: DataFrame, key: list[str], scope: list[str], text: str, vault: DataFrame, later: bool) -> DataFrame:
    """Add ``parts`` of ``text``; live are the placeholders of the vault, with ``later`` only those that come after the node's own ``ord``."""
    named = vault.select(*scope, F.col("placeholder").alias("token"), F.col("ord").alias("token_ord"))
    own = ["ord"] if later else []
    held = nodes.select(*dict.fromkeys([*key, *scope, *own]), F.explode(F.array_distinct(placeholders_in(F.col(text)))).alias("token"))
    met = held.join(named, [*scope, "token"])
    met = met.where("token_ord > ord") if later else met
    live = met.groupBy(*key).agg(F.collect_set("token").alias("live"))
    joined = nodes.join(live, key, "left")
    none = F.expr("CAST(array() AS array<string>)")
    return joined.withColumn("parts", _pieces(F.coalesce(F.col(text), F.lit("")), F.coalesce("live", none))).drop("live")


def _put_in(nodes: DataFrame, scope: list[str], turn: int) -> DataFrame:
    """One round: closed values go into all nodes that name them, open ones that are ``given`` into lines and into those that are not."""
    given = F.pmod(F.xxhash64(*scope, "placeholder", F.lit(turn)), F.lit(2)) == 0
    nodes = nodes.withColumn("closed", F.size(_open("parts")) == 0).withColumn("given", ~F.col("line") & given)
    wanted = nodes.select("node", *scope, F.col("given").alias("keeps"), F.explode(_open("parts")).alias("token"))
    values = nodes.where("NOT line").select(*scope, F.col("placeholder").alias("token"), F.col("parts").alias("inner"), "closed", "given")
    found = wanted.join(values, [*scope, "token"])
    # What no node names takes no further part; a closed value stays while an open one that is handed on names it.
    named = found.select(*scope, F.col("token").alias("placeholder")).distinct()
    rest = nodes.where("line").unionByName(nodes.where("NOT line").join(named, [*scope, "placeholder"], "left_semi"))
    taken = found.where("closed OR (given AND NOT keeps)")
    swaps = taken.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("token", "inner"))).alias("swaps"))
    swap = lambda p: F.when(p["live"], F.coalesce(F.col("swaps")[p["s"]], F.array(p))).otherwise(F.array(p))
    put = F.when(F.col("swaps").isNull(), F.col("parts")).otherwise(F.flatten(F.transform("parts", swap)))
    return rest.join(swaps, "node", "left").withColumn("parts", put).drop("swaps", "closed", "given")


def _restore_nested(texts: DataFrame, row_key: list[str], scope: list[str], text: str, vault: DataFrame, out: str) -> DataFrame:
    """Restore texts whose vault values lead to later placeholders, by contracting the graph of placeholders.

    A value's own placeholder counts where it comes later in the vault, as in one-after-the-other replacement, so there are no cycles.  Each round puts
    every value without open placeholders into all that name it, and of the others a random half into the other half and
    the lines; what nobody names any more is dropped.  A chain loses about a quarter of its links per round, so its length counts by
    its logarithm, and a link is handed on instead of being paired with all that lead to it.  Rows that repeat a ``row_key`` are
    one line; rows without one are left as they are.
    """
    row = F.struct(*row_key)
    lines = texts.select(*dict.fromkeys([*row_key, *scope, text])).dropDuplicates(row_key)
    lines = _in_pieces(lines, row_key, scope, text, vault, False).select(F.lit(True).alias("line"), row.alias("row"), *scope, "parts")
    values = _in_pieces(vault.select(*scope, "placeholder", "ord", "value"), [*scope, "placeholder"], scope, "value", vault, True)
    both = lines.unionByName(values.select(F.lit(False).alias("line"), *scope, "placeholder", "parts"), allowMissingColumns=True)
    nodes, turn = materialise(both.withColumn("node", F.monotonically_increasing_id())), 0
    while not nodes.where(F.col("line") & (F.size(_open("parts")) > 0)).isEmpty():
        turn += 1
        nodes = materialise(_put_in(nodes, scope, turn))
    done = nodes.where("line").select("row.*", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias(out))
    return texts.join(done, row_key, "left").withColumn(out, F.coalesce(out, text, F.lit("")))


def restore_text(
    texts: DataFrame,
    row_key: list[str],
    scope: list[str],
    text: str,
    vault: DataFrame,
    out: str,
    nested: bool = False,
) -> DataFrame:
    """Add ``out``: ``text`` with the values of its vault scope restored.

    ``vault`` holds (scope, ord, placeholder, value).  Only entries whose placeholder occurs
    in a text travel to it: texts explode to (scope, placeholder), join the vault on that
    unique key and regroup per text, so a scope of any size is never collected in one place.
    Values found by detectors never hold placeholders; cells of a table may, and then ``nested`` also restores
    what they lead to.
    """
    if nested and not vault.where(F.col("value").rlike(PLACEHOLDER)).isEmpty():
        return _restore_nested(texts, row_key, scope, text, vault, out)
    wanted = texts.select(
        *dict.fromkeys([*row_key, *scope]),
        F.explode(F.array_distinct(placeholders_in(F.col(text)))).alias("placeholder"),
    )
    entries = (
        wanted.join(vault.select(*scope, "placeholder", "ord", "value"), [*scope, "placeholder"])
        .groupBy(*row_key)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "placeholder", "value"))).alias("entries"))
    )
    joined = texts.join(entries, row_key, "left")
    plain = F.coalesce(text, F.lit(""))
    return joined.withColumn(
        out, F.when(F.col("entries").isNull(), plain).otherwise(restore_from(F.col(text), F.col("entries")))
    ).drop("entries")
