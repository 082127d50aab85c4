"""Relational chat formatting: one training text per conversation, with a loss mask, by column expressions only.

Template of a block (adjacent turns of one role are merged into one block)::

    <turn>ROLE<text>FIRST TEXT<part>SECOND TEXT</turn>\\n

Inside roles and texts a backslash is doubled and every ``<`` is followed by a backslash, so a control string never
occurs in them and ``unescape`` gives the text back.  The loss mask is an array of spans of the formatted text,
in code points from 0, one span for each text of a loss role.

Defined cases: a null text or role counts as empty; a null turn sorts first; rows that repeat a turn all stay,
ordered by role and text; null conversation ids form one conversation; other columns are ignored; an empty table gives
no rows.  A conversation is one output value, so its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.redaction import settled

OPEN, BODY, PART, CLOSE = "<turn>", "<text>", "<part>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\|\\(\\)", "$1$2")


def before(sizes: str) -> Column:
    """For each entry of the array column ``sizes``, the sum of the entries before it.

    Sums are taken over blocks of about the square root of the length, so long arrays do not cost their square.
    """
    return F.expr(f"""
        transform(
          flatten(transform(
            sequence(1, greatest(size({sizes}), 1), cast(ceil(sqrt(greatest(size({sizes}), 1))) AS int)),
            first -> transform(
              slice({sizes}, first, cast(ceil(sqrt(greatest(size({sizes}), 1))) AS int)),
              (x, i) -> struct(first AS first, i AS i)))),
          at -> aggregate(slice({sizes}_sums, 1, cast((at.first - 1) / ceil(sqrt(size({sizes}))) AS int)), 0L, (a, x) -> a + x)
              + aggregate(slice({sizes}, at.first, at.i), 0L, (a, x) -> a + x))""")


def block_sums(sizes: str) -> Column:
    """Sums of the blocks that ``before`` looks up; needed as column ``<sizes>_sums``."""
    return F.expr(f"""
        transform(sequence(1, greatest(size({sizes}), 1), cast(ceil(sqrt(greatest(size({sizes}), 1))) AS int)),
          first -> aggregate(slice({sizes}, first, cast(ceil(sqrt(greatest(size({sizes}), 1))) AS int)), 0L, (a, x) -> a + x))""")


def format_conversations(conversations: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length)."""
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_turns = (
        conversations.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    sorted_turns = settled(sorted_turns, F.transform("turns", lambda t: escape(t["text"])), "bodies")
    # The place of each turn whose role differs from the one before: there a block opens.
    opened = sorted_turns.select(
        "conv_id", "turns", "bodies",
        F.expr("""
            filter(transform(zip_with(turns, concat(array(CAST(NULL AS string)), slice(transform(turns, t -> t.role), 1, size(turns) - 1)),
                                      (t, last) -> NOT (t.role <=> last)),
                             (opens, i) -> IF(opens, i + 1, 0)),
                   place -> place > 0)""").alias("starts"),
    )
    blocks = opened.select(
        "conv_id",
        F.expr("""
            zip_with(starts, concat(slice(starts, 2, size(starts)), array(size(turns) + 1)),
                     (s, e) -> named_struct('role', turns[s - 1].role, 'parts', slice(bodies, s, e - s)))""").alias("blocks"),
    )
    pieces = blocks.select(
        "conv_id", "blocks",
        F.transform("blocks", lambda b: F.concat(
            F.lit(OPEN), escape(b["role"]), F.lit(BODY), F.array_join(b["parts"], PART), F.lit(CLOSE))).alias("texts"),
        # Every text is preceded by its control strings; a header opens the first one of a block, a part mark the next.
        F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p, i: F.struct(
            F.when(i == 0, F.length(escape(b["role"])) + len(OPEN) + len(BODY)).otherwise(len(PART)).cast("long").alias("lead"),
            F.length(p).cast("long").alias("length"),
            F.when(i == F.size(b["parts"]) - 1, len(CLOSE)).otherwise(0).cast("long").alias("tail"),
            b["role"].isin(*loss_roles).alias("loss"))))).alias("runs"),
    )
    measured = pieces.select(
        "conv_id", F.array_join("texts", "").alias("formatted"), "runs",
    )
    # What a lambda looks up is settled first: Spark would otherwise work it out again for every element.
    placed = settled(settled(measured, F.transform("runs", lambda r: r["lead"] + r["length"] + r["tail"]), "sizes"), block_sums("sizes"), "sizes_sums")
    placed = placed.withColumn("offsets", before("sizes"))
    return placed.select(
        "conv_id", "formatted",
        F.expr("""
            transform(filter(arrays_zip(runs, offsets), x -> x.runs.loss),
                      x -> named_struct('start', x.offsets + x.runs.lead, 'length', x.runs.length))""").alias("loss_spans"),
    )


def read_turns(formatted: str) -> Column:
    """The turns (role, text) of a formatted text, each as it went in."""
    blocks = F.split(F.col(formatted), CLOSE)
    return F.flatten(F.transform(
        F.slice(blocks, 1, F.size(blocks) - 1),
        lambda b: F.transform(
            F.split(F.substring_index(b, BODY, -1), PART),
            lambda p: F.struct(
                unescape(F.substring_index(F.replace(b, F.lit(OPEN), F.lit("")), BODY, 1)).alias("role"),
                unescape(p).alias("text")))))


def loss_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
