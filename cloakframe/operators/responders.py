"""Deterministic offline replies, and which provider a request would be routed to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.redaction import placeholders_in


def fill(template: str, parts: dict[str, Column]) -> Column:
    """Concatenate a template, putting a column in place of each ``{name}``."""
    pieces: list[Column] = []
    for i, chunk in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            pieces.append(parts[chunk])
        elif chunk:
            pieces.append(F.lit(chunk))
    return F.concat(*pieces)


def _pick(lower: Column, intents: dict[str, str], replies: dict[str, str], parts: dict[str, Column]) -> Column:
    chain = None
    for intent, pattern in intents.items():
        test, text = lower.rlike(pattern), fill(replies[intent], parts)
        chain = F.when(test, text) if chain is None else chain.when(test, text)
    return chain.otherwise(fill(replies["other"], parts))


def first_with_prefix(placeholders: Column, prefix: str) -> Column:
    return F.get(F.filter(placeholders, lambda p: F.startswith(p, F.lit(prefix))), F.lit(0))


def distinct_placeholders(text: Column) -> Column:
    return F.array_distinct(placeholders_in(text))


def gateway_reply(redacted: Column, placeholders: Column) -> Column:
    """Reply to one redacted prompt; ``placeholders`` are its distinct placeholders in order."""
    n = F.size(placeholders)
    card = first_with_prefix(placeholders, "[PAN")
    others = F.concat(F.lit(c.GATEWAY_OTHERS[0]), (n - 1).cast("string"), F.lit(c.GATEWAY_OTHERS[1]))
    listed = F.concat(F.lit(c.GATEWAY_FIELDS[0]), F.array_join(placeholders, ", "), F.lit(c.GATEWAY_FIELDS[1]))
    parts = {
        "who": F.coalesce(first_with_prefix(placeholders, "[NAME"), F.lit(c.GATEWAY_NOBODY)),
        "card": F.coalesce(F.concat(F.lit(" on card "), card), F.lit("")),
        "others": F.when(n > 1, others).otherwise(""),
        "fields": F.when(n > 0, listed).otherwise(c.GATEWAY_NO_FIELDS),
    }
    return _pick(F.lower(redacted), c.GATEWAY_INTENTS, c.GATEWAY_REPLIES, parts)


def chat_reply(last_user: Column, name: Column, card: Column, count: Column, listed: Column) -> Column:
    """Reply to the latest user turn.

    ``name`` and ``card`` are the first such placeholders of the whole history, ``count``
    the number of distinct placeholders and ``listed`` their comma list (read only by the
    last intent).
    """
    who = F.coalesce(name, F.lit(c.CHAT_NOBODY))
    others = F.concat(F.lit(c.CHAT_OTHERS[0]), (count - 1).cast("string"), F.lit(c.CHAT_OTHERS[1]))
    fields = F.concat(
        F.lit(c.CHAT_FIELDS[0]), count.cast("string"), F.lit(c.CHAT_FIELDS[1]), listed, F.lit(c.CHAT_FIELDS[2])
    )
    parts = {
        "who": who,
        "card": F.coalesce(F.concat(F.lit(" on card "), card), F.lit("")),
        "others": F.when(count > 1, others).otherwise(""),
        "regarding": F.coalesce(F.concat(F.lit(", regarding "), name), F.lit("")),
        "fields": F.when(count > 0, fields).otherwise(""),
    }
    return _pick(F.lower(last_user), c.CHAT_INTENTS, c.CHAT_REPLIES, parts)


def needs_list(last_user: Column) -> Column:
    """Whether the chat reply will spell out every placeholder."""
    any_intent = "|".join(c.CHAT_INTENTS.values())
    return ~F.lower(last_user).rlike(any_intent)


def gateway_provider(choice: Column, destination: Column, has_key: Column) -> Column:
    """Which provider the gateway would try first; it falls back to the offline reply."""
    wanted = F.lower(F.coalesce(choice, F.lit("auto")))
    hosted = (wanted == "openai") | ((wanted == "auto") & (destination == c.EXTERNAL_DESTINATION) & has_key)
    return (
        F.when(wanted == "echo", c.OFFLINE_PROVIDER)
        .when(hosted & (destination != c.EXTERNAL_DESTINATION), c.OFFLINE_PROVIDER)
        .when(hosted, "openai")
        .when(wanted.isin("ollama", "auto"), "ollama")
        .otherwise(c.OFFLINE_PROVIDER)
    )


def chat_provider(choice: Column) -> Column:
    wanted = F.lower(F.coalesce(F.nullif(choice, F.lit("")), F.lit("sovereign")))
    return F.when(wanted.isin(*c.CHAT_PROVIDERS), wanted).otherwise("sovereign")
