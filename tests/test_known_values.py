"""How often, and in how many tasks, conversations are searched for the values of their vaults."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from cloakframe.operators import conversation as C
from cloakframe.operators import substring_join as S

MESSAGES = "conv_id long, turn long, role string, text string"


def talk(n: int = 6) -> list[tuple]:
    rows = [(c, t, "user", f"Customer Omar Khan, mail u{c}@x.qa" + (", and Omar Khan again." if t else ".")) for c in range(n) for t in range(3)]
    # A later turn names a mail first as part of a longer one: its conversation takes another round.
    return [*rows, (90, 0, "user", "Mail a@b.qa now"), (90, 1, "user", "Mail xa@b.qa and QID 28412345678"), (90, 2, "user", "xa@b.qa 28412345678")]


@pytest.fixture
def searched(monkeypatch):
    """Every (conv_id, value) that the texts are searched for, in order of the searches."""
    calls = []

    def noted(texts, text_key, text, scope, values, value):
        calls.append({(r["conv_id"], r[value]) for r in values.collect()})
        return S.occurrences(texts, text_key, text, scope, values, value)

    monkeypatch.setattr(C, "occurrences", noted)
    return calls


def test_a_value_is_searched_once(spark, searched):
    C.redact_conversations(spark.createDataFrame(talk(), MESSAGES)).collect()
    every = [pair for call in searched for pair in call]
    assert len(every) == len(set(every)) and (0, "u0@x.qa") in every


def test_values_exposed_by_a_round_are_searched_then(spark, searched):
    got = {(r["conv_id"], r["turn"]): r["redacted"] for r in C.redact_conversations(spark.createDataFrame(talk(), MESSAGES)).collect()}
    assert got[90, 0] == "Mail [EMAIL_1] now" and "a@b.qa" not in "".join(got[90, t] for t in range(3))
    assert got[1, 2] == "Customer [NAME_1], mail [EMAIL_1], and [NAME_1] again."


def test_a_turn_without_earlier_values_keeps_its_spans(spark):
    turns = C.with_spans(C.in_order(C.user_turns(spark.createDataFrame(talk(1), MESSAGES)).select("conv_id", "turn", "text")))
    vault = spark.createDataFrame([(0, 0, 0, "Omar Khan", "[NAME_1]")], "conv_id long, first_at long, first_pos int, value string, mark string")
    hits = spark.createDataFrame([(0, 0, "Omar Khan"), (0, C.PER_TURN, "Omar Khan")], "conv_id long, at long, value string")
    own = turns.withColumn("spans", C.F.transform("spans", lambda s: s.withField("value", C.F.concat(C.F.lit("kept "), s["value"]))))
    got = {(r["conv_id"], r["turn"]): r for r in C._residue(own, hits, vault, C.BUILT_IN).collect()}
    assert got[0, 0]["n_known"] == 0 and [s["value"] for s in got[0, 0]["spans"]] == ["kept Omar Khan", "kept u0@x.qa"]
    assert got[0, 1]["n_known"] == 1 and got[0, 1]["work"].count("[NAME_1]") == 2 and [s["value"] for s in got[0, 1]["spans"]] == ["u0@x.qa"]


def test_values_are_dealt_to_every_core(spark, monkeypatch):
    parts = []

    def noted(df):
        parts.append(df.rdd.getNumPartitions())
        return stored(df)

    stored = S.materialise
    monkeypatch.setattr(S, "materialise", noted)
    texts = spark.createDataFrame([(1, 0, "Omar Khan and u1@x.qa")], "conv_id long, turn long, text string")
    values = spark.createDataFrame([(1, "Omar Khan"), (1, "u1@x.qa"), (1, "Sara")], "conv_id long, value string").coalesce(1)
    (row,) = S.occurrences(texts, "turn", "text", ["conv_id"], values, "value").collect()
    assert sorted(k["value"] for k in row["found"]) == ["Omar Khan", "u1@x.qa"]
    assert parts[0] == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("codes", [1, 40, 1 << 18])
def test_grams_of_a_block_are_those_of_its_texts(monkeypatch, codes):
    monkeypatch.setattr(S, "CODES", codes)
    texts = ["", "ab", None, "é😀xé😀x", "abcdeabcde", "x" * 90, "\ud83dz", "ab"]
    batch = pd.DataFrame({"conv_id": range(len(texts)), "text": texts, "scope_hash": np.array([3, -5, 7, 2**62, -(2**63), 1, 0, -5])})

    def emitted(sizes, bitmap):
        found = pd.concat(S._emit(["conv_id"], [], "text", sizes, bitmap)(iter([batch, batch[:0]])))
        return list(found.itertuples(index=False, name=None))

    def grams(text, size):
        return {text[i : i + size] for i in range(len(text) - size + 1)}

    full = np.full(S.BITS // 8, 255, dtype=np.uint8)
    for sizes in ([5], [2, 5], [1, 2, 3, 4, 5]):
        for bitmap in (full, None):
            got = emitted(sizes, bitmap)
            fits = [[s for s in sizes if s <= len(t or "")] for t in texts]
            want = [sum(len(grams(t or "", s)) for s in (f if bitmap is not None else f[-1:])) for t, f in zip(texts, fits)]
            assert [sum(c == row for c, _ in got) for row in range(len(texts))] == want and len(set(got)) == len(got)
    # Equal texts of one scope have equal grams, and an empty bitmap lets none pass.
    got = emitted([2], full)
    assert {g for c, g in got if c == 1} == {g for c, g in got if c == 7}
    assert emitted([1, 2], np.zeros(S.BITS // 8, dtype=np.uint8)) == []
