"""Conversation logs: redaction with a vault per conversation, views and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.masking import mask_value
from cloakframe.functions.redaction import (
    count_placeholders,
    placeholder,
    placeholders_in,
    settled,
    splice,
    tier_name,
    tier_rank,
    with_spans,
)
from cloakframe.functions.spans import catalogue_field
from cloakframe.functions.text import clean_text, collapse_space, trim_space
from cloakframe.operators.numbering import number_rows, running
from cloakframe.operators.responders import chat_reply, needs_list
from cloakframe.operators.substring_join import occurrences
from cloakframe.rulebook import BUILT_IN, Rulebook
from cloakframe.session import materialise

ENTRY = "array<struct<placeholder:string,type:string,cls:string,sensitivity:string,label:string,masked:string,value:string>>"
DEFAULT_TITLE = "New chat"
PER_TURN = 1 << 20
VAULT = "conv_id long, det int, type string, value string, first_at long, first_pos int, idx long"


def user_turns(messages: DataFrame) -> DataFrame:
    """Trimmed, non-empty user messages; a message without a conversation belongs to none."""
    return messages.where("role = 'user' AND conv_id IS NOT NULL").withColumn("text", clean_text(F.col("text"))).where("text <> ''")


def in_order(turns: DataFrame) -> DataFrame:
    """Add ``at``, the place of a message in its conversation: its turn, then its text among those of one turn number."""
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("text")
    return turns.withColumn("at", F.coalesce("turn", F.lit(-1)).cast("long") * PER_TURN + F.row_number().over(same_turn) - 1)


def turn_of(at: str) -> Column:
    """The turn number of a place; null where the message had none."""
    return F.when(F.col(at) >= 0, F.expr(f"{at} DIV {PER_TURN}"))


def _one_per_value(vault: DataFrame) -> DataFrame:
    """One row per value: of equal values under two types the one met first replaces."""
    values = vault.groupBy("conv_id", "value").agg(F.min(F.struct("first_at", "first_pos", "mark")).alias("f"))
    return values.select("conv_id", "value", "f.*")


def _hits(turns: DataFrame, values: DataFrame) -> DataFrame:
    """(conv_id, at, value): which of the (conv_id, value) occur in which turns of their conversation."""
    return occurrences(turns, "at", "text", ["conv_id"], values, "value").select("conv_id", "at", F.explode("found.value").alias("value"))


def _with_known(turns: DataFrame, hits: DataFrame, vault: DataFrame) -> DataFrame:
    """Turns with ``known``: earlier vault values that occur in them, in order of replacement."""
    entry = F.struct((-F.length("value")).alias("by_len"), "first_at", "first_pos", "value", "mark")
    earlier = hits.join(_one_per_value(vault), ["conv_id", "value"]).where("first_at < at")
    known = earlier.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(entry)).alias("known"))
    return turns.join(known, ["conv_id", "at"], "left")


def apply_known(text: Column, known: Column) -> Column:
    """struct(work, n): known values replaced one after the other, and how many took part."""

    def step(acc: Column, k: Column) -> Column:
        hit = F.contains(acc["work"], k["value"])
        return F.struct(
            F.when(hit, F.replace(acc["work"], k["value"], k["mark"])).otherwise(acc["work"]).alias("work"),
            (acc["n"] + hit.cast("int")).alias("n"),
        )

    start = F.struct(text.alias("work"), F.lit(0).alias("n"))
    return F.when(known.isNull(), start).otherwise(F.aggregate(known, start, step))


def _residue(turns: DataFrame, hits: DataFrame, vault: DataFrame, rules: Rulebook) -> DataFrame:
    """Turns with their known values replaced and the spans of the rest; a turn without known values keeps the spans of its text."""
    done = settled(_with_known(turns, hits, vault), apply_known(F.col("text"), F.col("known")), "after")
    rest = done.select("conv_id", "at", "turn", F.col("after.work").alias("work"), F.col("after.n").alias("n_known"), F.col("spans").alias("own"))
    sought = rest.withColumn("sought", F.when(F.col("n_known") > 0, F.col("work")).otherwise(F.lit("")))
    found = with_spans(sought, "sought", rules.detectors)
    return found.withColumn("spans", F.when(F.col("n_known") > 0, F.col("spans")).otherwise(F.col("own"))).drop("own", "sought")


def first_seen(spans: DataFrame, rules: Rulebook = BUILT_IN) -> DataFrame:
    rows = spans.select("conv_id", "at", F.explode_outer("spans").alias("s")).where("s IS NOT NULL")
    kind = catalogue_field(F.col("s.det"), rules.detectors, "type")
    return (
        rows.groupBy("conv_id", F.col("s.det").alias("det"), kind.alias("type"), F.col("s.value").alias("value"))
        .agg(F.min(F.struct(F.col("at"), F.col("s.start").alias("pos"))).alias("first"))
        .select(
            "conv_id", "det", "type", "value",
            F.col("first.at").alias("first_at"), F.col("first.pos").alias("first_pos"),
        )
    )


def redact_conversations(messages: DataFrame, rules: Rulebook = BUILT_IN) -> DataFrame:
    """(conv_id, turn, redacted, protected_count, entries) for every user turn; see ``redact_turns``."""
    return redact_turns(user_turns(messages).select("conv_id", "turn", "text"), rules=rules)[0]


def redact_turns(turns: DataFrame, known: DataFrame | None = None, rules: Rulebook = BUILT_IN) -> tuple[DataFrame, DataFrame]:
    """Redact (conv_id, turn, text) of conversations of any length; the redacted turns and the new vault values.

    The same value keeps its placeholder through a conversation.  ``known`` holds values protected before these turns.

    What a turn adds to the vault depends on the vault before it.  Start from the values the
    detectors find when no turn knows another, then let every turn, in parallel, replace the
    earlier values it contains and search the rest again.  Once the set of (value, first
    place) of a conversation no longer changes it satisfies the turn-by-turn definition for every turn, and by
    induction over turns only one set does; such a conversation takes no further part.  Each round settles at least the
    next dependent turn of the others; in practice two or three rounds settle all.  A text is looked through for a value
    once, whatever the rounds, and searched anew only where it holds an earlier one.

    Messages that share a turn number follow each other in the order of their texts; equal messages are redacted alike.
    """
    turns = materialise(with_spans(in_order(turns), detectors=rules.detectors))
    earlier = None if known is None else _marked(known)
    place = ["conv_id", "det", "value", "first_at", "first_pos"]
    vault, left, steady = materialise(first_seen(turns, rules)), turns, None
    hits = searched = None
    while True:
        marked = _with_earlier(vault.withColumn("mark", placeholder(F.col("type"), F.lit(0))), earlier)
        unsearched = marked.select("conv_id", "value").distinct()
        if hits is None:
            searched, hits = unsearched, materialise(_hits(left, unsearched))
        else:
            unsearched = materialise(unsearched.join(searched, ["conv_id", "value"], "left_anti"))
            if not unsearched.isEmpty():
                searched, hits = searched.unionByName(unsearched), hits.unionByName(materialise(_hits(left, unsearched)))
        again = materialise(first_seen(_residue(left, hits, marked, rules), rules))
        either = again.select(*place).unionAll(vault.select(*place)).groupBy(*place).agg(F.count("*").alias("n"))
        moved = materialise(either.where("n = 1").select("conv_id").distinct())
        done = again.join(moved, "conv_id", "left_anti")
        steady = done if steady is None else steady.unionByName(done)
        if moved.isEmpty():
            break
        vault = materialise(again.join(moved, "conv_id", "left_semi"))
        left = materialise(left.join(moved, "conv_id", "left_semi"))
    numbered = number_rows(steady, ["conv_id", "type"], ["first_at", "first_pos"], "idx")
    if known is not None:
        taken = known.groupBy("conv_id", "type").agg(F.max("idx").alias("taken"))
        numbered = numbered.join(taken, ["conv_id", "type"], "left").withColumn("idx", F.col("idx") + F.coalesce("taken", F.lit(0))).drop("taken")
    new = materialise(numbered)
    marked = _marked(new)
    entry = F.struct(
        "first_pos",
        F.col("mark").alias("placeholder"),
        "type",
        catalogue_field(F.col("det"), rules.detectors, "cls").alias("cls"),
        catalogue_field(F.col("det"), rules.detectors, "sensitivity").alias("sensitivity"),
        catalogue_field(F.col("det"), rules.detectors, "label").alias("label"),
        mask_value(F.col("type"), F.col("value")).alias("masked"),
        "value",
        "det",
    )
    fresh = (
        marked.select("conv_id", F.col("first_at").alias("at"), entry.alias("e"))
        .groupBy("conv_id", "at")
        .agg(F.array_sort(F.collect_list("e")).alias("fresh"))
    )
    final = _residue(turns, hits, _with_earlier(marked, earlier), rules).join(fresh, ["conv_id", "at"], "left")

    def mark_of(span: Column, _i: Column) -> Column:
        own = F.filter(F.col("fresh"), lambda e: (e["det"] == span["det"]) & (e["value"] == span["value"]))
        return own[0]["placeholder"]

    slim = F.transform(
        F.coalesce("fresh", F.expr("array()")),
        lambda e: F.struct(*[e[f] for f in ("placeholder", "type", "cls", "sensitivity", "label", "masked", "value")]),
    )
    redacted = final.select(
        "conv_id",
        "turn",
        splice(F.col("work"), F.col("spans"), mark_of).alias("redacted"),
        (F.col("n_known") + F.coalesce(F.size("fresh"), F.lit(0))).cast("long").alias("protected_count"),
        F.when(F.col("fresh").isNull(), F.expr(f"CAST(array() AS {ENTRY})")).otherwise(slim.cast(ENTRY)).alias("entries"),
    )
    return redacted, new


def _with_earlier(marked: DataFrame, earlier: DataFrame | None) -> DataFrame:
    return marked if earlier is None else marked.unionByName(earlier, allowMissingColumns=True)


def _marked(vault: DataFrame) -> DataFrame:
    return vault.withColumn("mark", placeholder(F.col("type"), F.col("idx")))


def conversation_vault(redacted: DataFrame) -> DataFrame:
    """Vault entries in order of arrival."""
    rows = redacted.select("conv_id", "turn", F.posexplode_outer("entries").alias("pos", "e")).where("e IS NOT NULL")
    return rows.select("conv_id", F.struct("turn", "pos").alias("ord"), "turn", "e.*")


def stored_messages(messages: DataFrame, redacted: DataFrame) -> DataFrame:
    """Messages as they are stored, one row each: user turns redacted, model turns as they came.

    A redacted turn is a row of its own, so turns that share a number keep their count.  Model turns keep the
    ``provider`` and ``model`` that answered, where the input has those columns; user turns have none.
    """
    origin = [name for name in ("provider", "model") if name in messages.columns]
    users = redacted.select(
        "conv_id", "turn", F.lit("user").alias("role"), F.col("redacted").alias("content"), "protected_count",
        *[F.lit(None).cast("string").alias(name) for name in origin],
    )
    others = messages.where("role <> 'user'").select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        count_placeholders(F.col("text")).cast("long").alias("protected_count"),
        *[F.col(name).cast("string").alias(name) for name in origin],
    )
    return users.unionByName(others)


def audit_metrics(redacted: DataFrame) -> DataFrame:
    """Per user turn: values newly protected, values protected so far, highest tier so far."""
    facts = redacted.select(
        "conv_id",
        "turn",
        F.size("entries").cast("long").alias("protected_new"),
        F.coalesce(
            F.array_max(F.transform("entries", lambda e: tier_rank(e["sensitivity"]))), F.lit(0)
        ).alias("rank"),
    )
    run = running(facts, ["conv_id"], ["turn"], {"protected_total": "protected_new"}, {"top_rank": "rank"})
    return run.select("conv_id", "turn", "protected_new", "protected_total", tier_name(F.col("top_rank")).alias("sensitivity"))


def titles(first_texts: DataFrame, redacted: str = "redacted") -> DataFrame:
    """Title per conversation: its first redacted user message, spaces collapsed, 60 characters."""
    title = F.left(trim_space(collapse_space(F.col(redacted))), F.lit(60))
    usable = F.when((title != "") & (title != DEFAULT_TITLE), F.col("turn"))
    return first_texts.groupBy("conv_id").agg(F.coalesce(F.min_by(title, usable), F.lit(DEFAULT_TITLE)).alias("title"))


def latest_user_turn(messages: DataFrame) -> DataFrame:
    own = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("conv_id").agg(F.coalesce(F.max_by("text", own), F.lit("")).alias("last_text"))


def chat_replies(history: DataFrame) -> DataFrame:
    """The offline reply to each conversation, from its redacted (conv_id, turn, role, content).

    Counts, first name and first card are plain aggregates.  Only a reply that lists every
    placeholder, because its text demands it, gathers the list.
    """
    tokens = history.select("conv_id", "turn", F.posexplode(placeholders_in(F.col("content"))).alias("pos", "token"))
    seen = tokens.groupBy("conv_id", "token").agg(F.min(F.struct("turn", "pos")).alias("first"))
    name = F.startswith(F.col("token"), F.lit("[NAME"))
    card = F.startswith(F.col("token"), F.lit("[PAN"))
    facts = seen.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.min_by("token", F.when(name, F.col("first"))).alias("name"),
        F.min_by("token", F.when(card, F.col("first"))).alias("card"),
    )
    last = latest_user_turn(history.withColumnRenamed("content", "text"))
    listing = last.where(needs_list(F.col("last_text"))).select("conv_id")
    listed = (
        seen.join(listing, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("all"))
        .select("conv_id", F.array_join(F.transform("all", lambda t: t["token"]), ", ").alias("listed"))
    )
    joined = last.join(facts, "conv_id", "left").join(listed, "conv_id", "left")
    reply = chat_reply(
        F.col("last_text"), F.col("name"), F.col("card"), F.coalesce("n", F.lit(0)), F.coalesce("listed", F.lit(""))
    )
    return joined.select("conv_id", reply.alias("reply"))


def newest(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The page of conversations changed last; 100 unless another size is asked for."""
    return conversations.orderBy(F.col("updated_at").desc(), F.col("conv_id").desc()).limit(max(limit or 100, 1))


def list_conversations(conversations: DataFrame, messages: DataFrame, vault: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest conversations with their message and vault counts; 100 unless another page size is asked for.

    Only the page's own messages and vault entries are counted, before they are joined.
    """
    top = newest(conversations, limit)
    listed = top.select("conv_id")
    n_messages = messages.join(listed, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("message_count"))
    n_vault = vault.join(listed, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("protected_count"))
    joined = top.join(n_messages, "conv_id", "left").join(n_vault, "conv_id", "left")
    counted = joined.withColumn("message_count", F.coalesce("message_count", F.lit(0))).withColumn(
        "protected_count", F.coalesce("protected_count", F.lit(0))
    )
    return counted.orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())


def next_index(vault: DataFrame) -> DataFrame:
    """The next free placeholder number per conversation and type."""
    number = F.regexp_extract("placeholder", r"\[[A-Z]+_([0-9]+)\]", 1).cast("long")
    return vault.groupBy("conv_id", F.regexp_extract("placeholder", r"\[([A-Z]+)_", 1).alias("type")).agg(
        (F.max(number) + 1).alias("next_index")
    )


def conversation_state(updates: DataFrame) -> DataFrame:
    """Latest state per conversation from its (conv_id, at, title, secure) updates.

    The title of the last rename counts, cut to 120 characters; secure never goes back.
    """
    renamed = F.when(F.col("title").isNotNull(), F.col("at"))
    return updates.groupBy("conv_id").agg(
        F.left(F.coalesce(F.max_by("title", renamed), F.lit(DEFAULT_TITLE)), F.lit(120)).alias("title"),
        F.coalesce(F.bool_or("secure"), F.lit(False)).alias("secure"),
        F.max("at").alias("updated_at"),
    )
