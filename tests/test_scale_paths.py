"""The operators that cut hot groups into ranges, blocks and salts, against plain recomputation."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakframe.catalogue import GENESIS
from cloakframe.functions.redaction import with_redaction
from cloakframe.operators import access as A
from cloakframe.operators import conversation as C
from cloakframe.operators import ledger as L
from cloakframe.operators import tables as T
from cloakframe.operators.numbering import carry_last, number_rows, running
from cloakframe.operators.restore import restore_text
from cloakframe.operators.substring_join import occurrences


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Keep AQE from merging the small ranges of test data into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(n: int = 400) -> list[tuple[str, int, int]]:
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.6 else f"k{i % 9}", i, rng.randint(0, 5)) for i in rng.sample(range(n), n)]


def test_number_rows_and_running_cross_ranges(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, at long, v long")
    want = pd.DataFrame(data, columns=["k", "at", "v"]).sort_values(["k", "at"])
    want["n"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["v"].cumsum()
    want["m"] = want.groupby("k")["v"].cummax()
    got = running(number_rows(df, ["k"], ["at"], "n"), ["k"], ["at"], {"s": "v"}, {"m": "v"}).toPandas()
    got = got.sort_values(["k", "at"])
    for col in ("n", "s", "m"):
        assert got[col].tolist() == want[col].tolist()


def test_number_rows_without_key(spark):
    df = spark.createDataFrame(skewed(), "k string, at long, v long")
    got = number_rows(df, [], ["at"], "n").orderBy("at").collect()
    assert [r["n"] for r in got] == list(range(1, 401))


def test_carry_last_crosses_ranges(spark):
    values = [(i, f"h{i}" if i in (3, 4, 190) else None) for i in range(400)]
    got = {r["id"]: r["p"] for r in carry_last(spark.createDataFrame(values, "id long, h string"), ["id"], "h", "p").collect()}
    last = None
    for i, h in values:
        assert got[i] == last
        last = h or last


TALK = [
    "Customer Omar Khan wrote.", "Omar Khan and Customer Omar Khan Ali again", "mail omar@x.qa", "xomar@x.qa and omar@x.qa.b",
    "Customer Ali Bo, card 4111 1111 1111 1111", "Ali Bo 4111 1111 1111 1111", "client Omar Khan Ali Bo", "55123456 or +974 5512 3456",
    "5512 3456", "no data", "Villa 12 West Bay and Villa 12 West", "Dr. Ali Bo Villa 12", "Mr Al then Mr Al Bo", "  ", "customer Khan Ali",
]


def brute(spark, talk: list[tuple[int, int, str]]) -> list[tuple]:
    """Turn by turn: protect what the vault knows, longest first, then what the redaction of the rest finds anew."""
    out, vaults = [], {}
    for conv, turn, text in sorted(talk):
        if not text.strip():
            continue
        vault = vaults.setdefault(conv, {})  # (type, value) to placeholder, in order of arrival
        rest, hits = text.strip(), 0
        for (_kind, value), mark in sorted(vault.items(), key=lambda v: -len(v[0][1])):
            hits += value in rest
            rest = rest.replace(value, mark)
        row = with_redaction(spark.createDataFrame([(rest,)], "text string")).select("spans", "entities").first()
        kinds = {e["value"]: e for e in row["entities"]}
        pieces, cursor, fresh = [], 0, []
        for span in row["spans"]:
            e = kinds[span["value"]]
            key = (e["type"], e["value"])
            if key not in vault:
                vault[key] = f"[{e['type']}_{1 + sum(k == e['type'] for k, _v in vault)}]"
                fresh.append((vault[key], *[e[f] for f in ("type", "cls", "sensitivity", "label", "masked", "value")]))
            pieces += [rest[cursor : span["start"]], vault[key]]
            cursor = span["start"] + len(span["value"])
        out.append((conv, turn, "".join(pieces) + rest[cursor:], hits + len(fresh), fresh))
    return out


def plain(df) -> list[tuple]:
    return sorted(
        (r["conv_id"], r["turn"], r["redacted"], r["protected_count"], [tuple(e) for e in r["entries"]]) for r in df.collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_equal_turn_by_turn(spark, seed):
    rng = random.Random(seed)
    talk = [(conv, turn, " ".join(rng.sample(TALK, rng.randint(1, 3)))) for conv in (1, 2) for turn in range(14 if conv == 1 else 3)]
    df = spark.createDataFrame([(*t, "user") for t in talk], "conv_id long, turn long, text string, role string")
    assert plain(C.redact_conversations(df)) == brute(spark, talk)


def test_equal_turn_numbers_and_missing_conversations(spark):
    rows = [(1, 0, "user", "Customer Omar Khan"), (1, 0, "user", "mail Omar Khan at omar@x.qa"), (1, 1, "user", "Omar Khan"), (None, 0, "user", "Customer Ali Bo"),
            (2, 0, "user", "Customer Ali Bo"), (2, 0, "user", "Customer Ali Bo")]
    got = C.redact_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r["conv_id"], r["turn"], r["redacted"], r["protected_count"]) for r in got.collect()) == [
        (1, 0, "Customer [NAME_1]", 1), (1, 0, "mail [NAME_1] at [EMAIL_1]", 2), (1, 1, "[NAME_1]", 1), (2, 0, "Customer [NAME_1]", 1), (2, 0, "Customer [NAME_1]", 1)]


def test_assistant_turns_stay_and_count_placeholders(spark):
    df = spark.createDataFrame([(1, 0, "user", "Customer Omar Khan"), (1, 1, "assistant", "Hi [NAME_1], [NAME_1] a@b.qa")],
                               "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["content"], r["protected_count"]) for r in C.stored_messages(df, C.redact_conversations(df)).collect()}
    assert got == {0: ("Customer [NAME_1]", 1), 1: ("Hi [NAME_1], [NAME_1] a@b.qa", 1)}


def test_audit_metrics_accumulate(spark):
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["Customer Omar Khan", "none", "QID 28412345678 Omar Khan"])],
                               "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in C.audit_metrics(C.redact_conversations(df)).orderBy("turn").collect()]
    assert got == [(1, 0, 1, 1, "confidential"), (1, 1, 0, 1, "confidential"), (1, 2, 1, 2, "restricted")]


def test_occurrences_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["Omar", "Khan", "Villa 1", "a@b.qa", "é😀x", "55123456", "Dr. Al"]
    texts = [(c, i, "".join(rng.choices(words + [" ", "z"], k=8))) for c in (1, 2) for i in range(40)]
    values = sorted({(c, "".join(rng.choices(words, k=rng.randint(1, 2)))) for c in (1, 2) for _ in range(25)})
    t = spark.createDataFrame(texts, "conv_id long, turn long, text string")
    v = spark.createDataFrame([(*x, i) for i, x in enumerate(values)], "conv_id long, value string, n long")
    rows = occurrences(t, "turn", "text", ["conv_id"], v, "value").collect()
    got = {(r["conv_id"], r["turn"], k["value"]) for r in rows for k in r["found"]}
    assert got == {(c, i, val) for c, i, text in texts for c2, val in values if c == c2 and val in text}


def test_occurrences_of_short_empty_and_unscoped_values(spark):
    texts = [(1, 0, "ab abc é😀"), (1, 1, ""), (1, 2, None), (2, 0, "abcdef"), (None, 0, "abcdef"), (2, 1, "x" * 300)]
    values = [(1, "a"), (1, "ab"), (1, "😀"), (1, "é😀"), (1, ""), (1, None), (1, "bcde"), (2, "abcdef"), (2, "bcde"), (2, "f"), (None, "abcdef"), (2, "xxxxxxx")]
    t = spark.createDataFrame(texts, "conv_id long, turn long, text string")
    v = spark.createDataFrame([(*x, i) for i, x in enumerate(values)], "conv_id long, value string, n long")
    rows = occurrences(t, "turn", "text", ["conv_id"], v, "value").collect()
    got = {(r["conv_id"], r["turn"], k["value"]) for r in rows for k in r["found"]}
    assert got == {(c, i, val) for c, i, text in texts for c2, val in values if c and c == c2 and val and text and val in text}
    assert occurrences(t, "turn", "text", ["conv_id"], v.where("value = ''"), "value").count() == 0


def test_thousands_of_values_in_one_text(spark):
    import time

    mails = [f"user{i % 2000}@mail{i % 7}.example.com" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(mails),)], "text string")
    started = time.time()
    row = with_redaction(df).select("redacted", F.size("entities").alias("n"), "entities").first()
    order = {m: k + 1 for k, m in enumerate(dict.fromkeys(mails))}
    assert row["n"] == len(order) and row["redacted"] == " ".join(f"[EMAIL_{order[m]}]" for m in mails)
    assert [e["value"] for e in row["entities"]] == list(order)
    assert time.time() - started < 60


def test_sessions_follow_their_accesses(spark):
    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    sessions = spark.createDataFrame([("a", "admin", hour(0), hour(0), None, None), ("b", "odd", hour(0), None, hour(30), None), ("c", "viewer", hour(0), None, None, hour(5))],
                                     "token string, role string, created_at string, last_seen_at string, expires_at string, revoked_at string")
    for column in ("created_at", "last_seen_at", "expires_at", "revoked_at"):
        sessions = sessions.withColumn(column, F.col(column).cast("timestamp_ntz"))
    rows = [("a", 20), ("a", 40), ("a", 64), ("a", 89), ("a", 90), ("b", 10), ("b", 30), ("b", 31), ("b", 32), ("c", 4), ("c", 5), ("c", 6), ("x", 1)]
    accesses = spark.createDataFrame([(i, t, hour(h)) for i, (t, h) in enumerate(rows)], "event_id long, token string, seen_at string")
    got = {r["event_id"]: r["state"] for r in A.access_validity(accesses.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")), sessions).collect()}
    assert [got[i] for i in range(len(rows))] == [
        "valid", "valid", "valid", "idle", "revoked", "valid", "valid", "expired", "revoked", "valid", "revoked", "revoked", "unknown"]


def ledger(spark, n: int = 50):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "a", "operator", "external-cloud", "prov", "m", f'p "{i}"', "[]", '["z","a"]', None,
             "allow", "pending" if i % 7 == 3 else "completed", "r", None, f"out {i}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id long, created_at string, actor string, role string, destination string, provider string, model string, "
                                       "prompt_redacted string, entities string, classes string, sensitivity string, decision string, status string, "
                                       "reason string, approver string, output_redacted string, phase int")


def test_chain_is_the_same_for_any_block_size(spark):
    rows = ledger(spark)
    small = {r["id"]: r["hash"] for r in L.build_chain(rows, ["phase", "id"], block_rows=7).collect()}
    whole = L.build_chain(rows, ["phase", "id"]).collect()
    assert small == {r["id"]: r["hash"] for r in whole}
    prev = GENESIS
    for row in sorted(whole, key=lambda r: (r["phase"], r["id"])):
        assert row["prev_hash"] == prev
        prev = hashlib.sha256(f'{row["head"]}{prev}"}}'.encode()).hexdigest()
        assert row["hash"] == prev


def test_verification_finds_the_first_break(spark):
    chained = L.build_chain(ledger(spark), ["id"]).cache()
    assert L.verify_chain(chained, ["id"]).first()["ok"]
    for field, value in [("actor", "x"), ("prompt_redacted", "x"), ("classes", "[]"), ("output_redacted", None), ("created_at", "x"), ("sensitivity", "internal")]:
        edited = chained.withColumn(field, F.when(F.col("id").isin(20, 30), F.lit(value)).otherwise(F.col(field)))
        verdict = L.verify_chain(edited, ["id"]).first()
        assert (verdict["ok"], verdict["broken_at"]) == (False, 20), field
    unhashed = chained.withColumn("provider", F.lit("other")).withColumn("reason", F.lit("x"))
    assert L.verify_chain(unhashed, ["id"]).first()["ok"]
    assert L.verify_chain(chained.where("id <> 20"), ["id"]).first()["broken_at"] == 21


def test_empty_ledger(spark):
    none = L.build_chain(ledger(spark).where("id < 0"), ["id"])
    assert L.verify_chain(none, ["id"]).first()["message"] == "No records yet."


def test_approving_an_older_request_later_keeps_the_chain_whole(spark):
    rows = ledger(spark, 12)
    decisions = spark.createDataFrame([(3, 2, 7, "approve", "lead", None), (3, 1, 9, "reject", "late", None), (3, 3, 7, "reject", "late", None), (10, 4, 1, "reject", "lead", None),
                                       (5, 5, 2, "approve", "lead", None), (99, 6, 3, "approve", "lead", None)],
                                      "request_id long, decision_id long, sec long, verdict string, approver string, notes string")
    decisions = decisions.withColumn("decided_at", F.expr("TIMESTAMP_NTZ '2024-02-01' + make_interval(0, 0, 0, 0, 0, 0, sec)"))
    outcome = L.apply_approvals(rows, decisions).cache()
    got = {r["decision_id"]: (r["ok"], r["error"], r["status"], r["reason"]) for r in outcome.collect()}
    done = (False, "Request is 'completed', not pending", "completed", "r")
    assert got == {2: (True, None, "completed", "r"), 1: done, 3: done, 4: (True, None, "rejected", "r"), 5: done, 6: (False, "Request not found", None, None)}
    settled = L.settle(rows.drop("phase"), outcome)
    assert settled.count() == 12 and settled.where("id = 3").first()["approver"] == "lead"
    verdict = L.verify_chain(L.build_chain(settled, ["settled_at", "id"]), ["settled_at", "id"]).first()
    assert (verdict["ok"], verdict["total"]) == (True, 12)


def test_nested_placeholders_are_restored_in_vault_order(spark):
    vault = spark.createDataFrame([(1, "[NAME_1]", "see [NAME_2]"), (2, "[NAME_2]", "Bob [IBAN_1]"), (3, "[IBAN_1]", "QA1"), (4, "[IBAN_2]", "back [NAME_1]"),
                                   (5, "[NAME_12]", "Eve")], "ord long, placeholder string, value string")
    texts = [(1, "[NAME_1]!"), (2, "[IBAN_2] x"), (3, "none"), (4, None), (5, "[NAME_12] [NAME_9]")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["out"] for r in restore_text(df, ["id"], [], "text", vault, "out", nested=True).collect()}
    for key, text in texts:
        want = text or ""
        for _o, placeholder, value in vault.collect():
            want = want.replace(placeholder, value)
        assert got[key] == want


def test_a_chain_of_nested_placeholders_is_restored_in_few_rounds(spark):
    n = 200
    chain = spark.range(n).selectExpr("id AS ord", "concat('[N_', id, ']') AS placeholder",
                                      f"CASE WHEN id = {n - 1} THEN 'end' ELSE concat('a[N_', id + 1, ']', IF(id % 3 = 0, '[N_0]', '')) END AS value")
    df = spark.createDataFrame([(1, "[N_0]|[N_190]"), (2, "[N_x] [N_10000]"), (3, None)], "id long, text string")
    got = {r["id"]: r["out"] for r in restore_text(df, ["id"], [], "text", chain, "out", nested=True).collect()}

    def whole(i: int) -> str:
        back = ["[N_0]" for k in range(i, n - 1) if k % 3 == 0]
        return "a" * (n - 1 - i) + "end" + "".join(back)

    assert got == {1: f"{whole(0)}|{whole(190)}", 2: "[N_x] [N_10000]", 3: ""}


def test_table_redaction_shares_numbers_over_columns_and_keeps_blanks(spark):
    df = spark.createDataFrame([(1, "Ann", "5", "Bob"), (2, "", "6", "Ann"), (3, None, "7", "Cid"), (4, "Bob", "", "x")],
                               "n long, name string, loan string, client string")
    vault = T.stored_vault(df, "n")
    got = [tuple(r) for r in T.redact_table(df, "n", vault).orderBy("n").collect()]
    assert got == [(1, "[NAME_1]", "5", "[NAME_2]"), (2, "", "6", "[NAME_1]"), (3, None, "7", "[NAME_3]"), (4, "[NAME_2]", "", "[NAME_4]")]
    summary = T.summarise_vault(vault).first()
    assert (summary["type"], summary["count"], summary["sample"]) == ("NAME", 4, "A••")


def test_lockout_of_one_hot_ip_equals_a_plain_window(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else None if i % 5 == 0 else "b", rng.randint(0, 1), 1_700_000_000 + rng.randint(0, 6000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, ip string, success int, sec long").withColumn("at", F.timestamp_seconds("sec"))
    got = {r["id"]: (r["failed"], r["locked"]) for r in A.trailing_failures(df).collect()}
    for i, ip, _s, sec in rows:
        n = sum(1 for _j, ip2, s2, sec2 in rows if ip and ip2 == ip and s2 == 0 and sec - 900 <= sec2 < sec)
        assert got[i] == (n, n >= 5)


def test_texts_with_thousands_of_matches(spark):
    """More matches than a block holds: positions, overlaps and numbers as in a plain loop."""
    from cloakframe.functions.spans import BLOCK
    from cloakframe.operators import screening as S

    n = 3 * BLOCK + 7
    mails = [f"u{i % 400}@x.qa" for i in range(n)]
    text = "é😀 " + " ".join(f"mail {m} 28412345678 +974 5512 3456" for m in mails)
    row = with_redaction(spark.createDataFrame([(text,)], "text string")).select("spans", "redacted").first()
    for span in row["spans"]:
        assert text[span["start"] : span["start"] + len(span["value"])] == span["value"]
    ends = [s["start"] + len(s["value"]) for s in row["spans"]]
    assert len(row["spans"]) == 3 * n and all(end <= after["start"] for end, after in zip(ends, row["spans"][1:]))
    assert row["redacted"] == "é😀 " + " ".join(f"mail [EMAIL_{i % 400 + 1}] [QID_1] [PHONE_1]" for i in range(n))
    texts = [text, "a@b.qa xa@b.qa a@b.qa", "a@b.qa", "none", "", "a@b.qa a@b.qa.x b@c.qa"]
    found = S.with_findings(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i")
    out = found.select("text", "findings", S.screened_text(F.col("text"), F.col("findings")).alias("out")).collect()
    for r in out:  # one after the other, as the meaning is
        want = r["text"]
        for f in r["findings"]:
            want = want.replace(f["value"], f["placeholder"], 1)
        assert r["out"] == want
    assert len(out[0]["findings"]) >= n and len(out) == len(texts)
