"""Expected results for the sample prompts, masks, numbers, headers, tiers and policy."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions import rules as R
from cloakframe.functions.masking import mask_value
from cloakframe.functions.redaction import distinct_classes, top_sensitivity, with_redaction
from cloakframe.operators.ledger import assess
from cloakframe.operators.policy import decide
from cloakframe.operators.restore import restore_from
from cloakframe.sources.views import load
from tests.sample_prompts import SAMPLE_PROMPTS

SF = "/root/testdata/sf0.01"

GOLDEN = {
    "card-refund": (
        "Please answer customer [NAME_1], QID [QID_1]. Order 771 was paid with [PAN_1] and comes back "
        "to account [IBAN_1]. Reach them at [EMAIL_1] or [PHONE_1].",
        ["identity", "national-id", "payment-card", "bank-account", "contact"], "restricted", "allow",
    ),
    "lease-check": (
        "Could applicant and customer [NAME_1] (QID [QID_1]) lease a van for 2,400 a month from "
        "IBAN [IBAN_1]? Answer in one line.",
        ["identity", "national-id", "bank-account"], "restricted", "require-approval",
    ),
    "clinic-note": (
        "Shorten this note on patient [NAME_1], [MRN_1], [DOB_1]: [MRN_2], rest for two days. Text the result to [PHONE_1].",
        ["identity", "health", "contact"], "restricted", "allow",
    ),
    "leaked-key": (
        "Ticket of [NAME_1] ([EMAIL_1]): the job fails with key [SECRET_1], why?",
        ["identity", "contact", "credential"], "restricted", "block",
    ),
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLE_PROMPTS, "id string, sector string, title string, destination string, text string")


def test_sample_prompts(samples):
    rows = assess(samples).select("id", "redacted", "class_list", "sensitivity", "decision").collect()
    assert {r["id"]: (r["redacted"], r["class_list"], r["sensitivity"], r["decision"]) for r in rows} == GOLDEN


def test_sample_entities_and_restoration(samples):
    done = with_redaction(samples)
    rows = done.select("id", "text", "entities", restore_from(F.col("redacted"), F.col("entities")).alias("back")).collect()
    for row in rows:
        assert row["back"] == row["text"]
    note = next(r for r in rows if r["id"] == "clinic-note")
    values = {e["placeholder"]: e["value"] for e in note["entities"]}
    assert values["[DOB_1]"] == "DOB 1985-11-30"
    assert values["[MRN_1]"] == "MRN 550123"
    assert values["[MRN_2]"] == "diagnosed with influenza"


MASKS = [
    ("EMAIL", "noor.haddad@mail.example", "n" + "•" * 10 + "@mail.example"),
    ("NAME", "Lina Al-Farouk", "L••• A••••••••"),
    ("PAN", "5500 0055 5555 5559", "••••559"),
    ("QID", "27810293847", "••••847"),
    ("EMAIL", "a@x.y", "a••@x.y"),
    ("EMAIL", "nobody", "n•••••@"),
    ("PHONE", "12", "••••12"),
    ("ADDR", "Flat  9", "F••• 9"),
]


def test_masks(spark):
    df = spark.createDataFrame(MASKS, "kind string, value string, want string")
    for row in df.withColumn("got", mask_value(F.col("kind"), F.col("value"))).collect():
        assert row["got"] == row["want"]


def test_numbers(spark):
    cases = [("QAR 12,500", 12500.0), ("1-2", 0.0), ("", 0.0), ("(500)", 500.0), ("12.", 12.0), ("[IBAN_3]", 3.0), (None, 0.0), ("-", 0.0), (".5", 0.5), ("9" * 400, 0.0)]
    df = spark.createDataFrame(cases, "cell string, want double")
    for row in df.withColumn("got", R.to_number(F.col("cell"))).collect():
        assert row["got"] == row["want"], row


def test_headers(spark):
    cases = {
        "Customer Name": "NAME", "Mobile": "PHONE", "Account Name": "NAME", "Company": "PAN", "c_name": "NAME",
        "c_acctbal": "IBAN", " E-Mail ": "EMAIL", "Birth date": "DOB", "hotel": "PHONE", "Product": None,
        "Days Past Due": None, "Outstanding Loan (QAR)": None, "Monthly Salary (QAR)": None, "": None, "جوال": "PHONE",
    }
    df = spark.createDataFrame(list(cases.items()), "header string, want string")
    for row in df.withColumn("got", R.header_type(F.col("header"))).collect():
        assert row["got"] == row["want"], row
        assert R.classify_names({"x": row["header"]}).get("x", (None,))[0] == row["want"]


def test_risk_tiers(spark):
    cases = [(90.0, 0.0, 0.0, "High risk"), (30.0, 0.0, 0.0, "Medium risk"), (0.0, 1.0, 0.0, "High risk"), (0.0, 0.0, 0.0, "Low risk"),
             (0.0, 7.2, 1.0, "High risk"), (0.0, 4.2, 1.0, "Medium risk")]
    df = spark.createDataFrame(cases, "dpd double, debt double, income double, want string")
    got = df.withColumn("tier", R.risk_tier(F.col("dpd"), R.debt_to_income(F.col("debt"), F.col("income"))))
    assert [r["tier"] for r in got.collect()] == [r[3] for r in cases]


def test_policy(spark):
    cases = [(None, None, [], "allow", "sovereign-local"), ("moon", "restricted", ["credential"], "allow", "sovereign-local"),
             ("external-cloud", "confidential", ["contact"], "allow", "external-cloud"),
             ("external-cloud", "confidential", ["contact", "credential"], "block", "external-cloud"),
             ("external-cloud", "restricted", ["health"], "require-approval", "external-cloud")]
    df = spark.createDataFrame(cases, "destination string, sensitivity string, classes array<string>, want string, want_dest string")
    for row in decide(df, "destination", "sensitivity", "classes").collect():
        assert (row["decision"], row["dest"]) == (row["want"], row["want_dest"])


def test_counts_on_the_prompts_view(spark):
    rows = with_redaction(load(spark, SF, "prompts")).select(F.explode_outer("spans").alias("s")).where("s is not null")
    counts = {c.DETECTORS[r["det"]].type: r["n"] for r in rows.groupBy("s.det").agg(F.count("*").alias("n")).collect()}
    assert counts == {"NAME": 500, "EMAIL": 375, "PAN": 250, "MRN": 250, "QID": 125, "IBAN": 125, "PASSPORT": 125,
                      "SECRET": 125, "DOB": 125, "PHONE": 125, "ADDR": 125}


EDGES = [
    "", "   ", "plain", "see [NAME_1] and Customer Omar Khan", "Dr. Reem Nair called", "é4111111111111111 x",
    "😀 mail a@b.qa 😀 a@b.qa", "card 4111-1111-1111-1111-x", "Ms. Ann Lee and Ms. Ann Lee", "Mr Al and Mr Al Bo",
    " ".join(f"m{i}@x.qa" for i in range(12)), "+974 5512 3456 and 55123456", "4111 1111 1111 1111 55123456",
    "customer Customer Foo Bar", "born: 1/2/1990, DOB 1990-01-02", "Villa 12, West Bay. St. Mary road",
    "diagnosed with acute something long", "x@y.com.b@z.org", "sk-" + "a" * 24, "é2841234567812 28412345678",
    "MRN#12345 mrn 99999", "Zone 5 Street 7 call +1 (743) 555-3824", "ghp_" + "A1" * 18, "Kelvin Å born 1-1-90",
]


def test_edge_expectations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "id long, text string")
    got = {r["text"]: r["redacted"] for r in with_redaction(df).collect()}
    assert got["é4111111111111111 x"] == "é[PAN_1] x"
    assert got["card 4111-1111-1111-1111-x"] == "card [PAN_1]x"
    assert got["😀 mail a@b.qa 😀 a@b.qa"] == "😀 mail [EMAIL_1] 😀 [EMAIL_1]"
    assert got[EDGES[10]] == " ".join(f"[EMAIL_{i + 1}]" for i in range(12))
    assert got["Dr. Reem Nair called"] == "[NAME_1] called"
    assert got["customer Customer Foo Bar"] == "customer [NAME_1]"


def test_null_text_stays_null(spark):
    row = with_redaction(spark.createDataFrame([(1, None)], "id long, text string")).select(
        "redacted", distinct_classes(F.col("entities")).alias("k"), top_sensitivity(F.col("entities")).alias("t")
    ).first()
    assert row["redacted"] is None
    assert row["t"] is None
