"""Rules from tables: what is refused, and that long texts cost no more than their length."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.redaction import with_redaction
from cloakframe.operators import policy as P
from cloakframe.plans.rules import DETECTOR_ROWS
from cloakframe.rulebook import BUILT_IN, compile_rules, linear

GOOD = [r"\bticket [0-9]{1,9}\b", r"\b[A-Z]{2}\d+\b", r"\bno\d+", r"(?:red|green) (?:[a-z]{2,8} ){1,3}end", r"\bab\w+-", "x", r"\b\w+@", r"[a-z]{1,64}@"]
BAD = [r"[a-z]+@", r"(a+)+b", r"\d*", r"(\w+\s?)+$", r".*x", r"x.+y", r"(x)\1", r"(?=x)y", r"\b\w+\w+!", r"a\w+!", r"(?:a|b)*c", r"\b[a-z.]+@", "", r"(", r"(?:(?:\w{1,99}){1,99}){1,99}", r"\b\w+?x"]


@pytest.mark.parametrize("pattern", GOOD)
def test_linear_patterns_pass(pattern):
    linear(pattern)


@pytest.mark.parametrize("pattern", BAD)
def test_others_are_refused(pattern):
    with pytest.raises(Exception, match="."):
        linear(pattern)


def detector(spark, **given):
    row = {"rank": 1, "type": "CODE", "cls": "own", "sensitivity": "internal", "label": "Own code", "pattern": r"\bcode [0-9]{1,4}\b",
           "ignore_case": False, "value_group": 0, "literals": None, "check": None} | given
    return spark.createDataFrame([tuple(row[f.split()[0]] for f in DETECTOR_ROWS.split(", "))], DETECTOR_ROWS)


def test_rules_are_checked(spark):
    for given in ({"type": "low"}, {"type": "A_B"}, {"sensitivity": "secret"}, {"cls": "x'y"}, {"label": "it's"}, {"pattern": r"[a-z]+@"}, {"pattern": "("}, {"check": "magic"},
                  {"value_group": 1}, {"value_group": 2}, {"literals": ["it's"]}, {"type": None}):
        with pytest.raises(ValueError, match="."):
            compile_rules(spark, detector(spark, **given))
    with pytest.raises(ValueError, match="decision"):
        compile_rules(spark, policy=spark.createDataFrame([("external-cloud", "internal", "maybe")], "dest string, tier string, rule string"))
    with pytest.raises(ValueError, match="words"):
        compile_rules(spark, headers=spark.createDataFrame([(1, "X", "x", [" "])], "rank int, type string, label string, words array<string>"))
    with pytest.raises(ValueError, match="rows at most"):
        compile_rules(spark, policy=spark.range(501).selectExpr("concat('d', id) AS dest", "'none' AS tier", "'allow' AS rule"))
    assert compile_rules(spark) == BUILT_IN


def test_added_rules_stand_beside_the_built_in_ones(spark):
    own = compile_rules(spark, detector(spark, literals=["code"]).unionAll(detector(spark, rank=2, type="CARDLIKE", pattern=r"\bno [0-9]{13,19}\b", check="luhn")))
    texts = ["code 12 and code 12, code 7 of Customer Omar Khan", "no 4111111111111111", "no 4111111111111112", None, "", "CODE 1"]
    out = with_redaction(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), detectors=own.detectors).orderBy("i").collect()
    assert [r.redacted for r in out] == ["[CODE_1] and [CODE_1], [CODE_2] of Customer [NAME_1]", "no [PAN_1]", "no 4111111111111112", None, "", "CODE 1"]
    assert [e.masked for e in out[0].entities if e.type == "CODE"] == ["••••e12", "••••de7"]


def test_a_new_destination_follows_its_rows(spark):
    policy = spark.createDataFrame([("partner-cloud", "restricted", "block"), ("partner-cloud", "internal", "require-approval")], "dest string, tier string, rule string")
    own = compile_rules(spark, policy=policy)
    rows = [(d, t, cls) for d in ("partner-cloud", "sovereign-local", "nowhere") for t in ("restricted", "internal", None) for cls in ([], ["credential"])]
    df = spark.createDataFrame(rows, "destination string, sensitivity string, classes array<string>")
    got = {(r.destination, r.sensitivity, bool(r.classes)): (r.dest, r.decision) for r in P.decide(df, "destination", "sensitivity", "classes", own).collect()}
    assert got["partner-cloud", "restricted", False] == ("partner-cloud", "block") and got["partner-cloud", "internal", False] == ("partner-cloud", "require-approval")
    assert got["partner-cloud", None, False] == ("partner-cloud", "allow") and got["partner-cloud", None, True] == ("partner-cloud", "block")
    assert got["nowhere", "restricted", True] == ("sovereign-local", "allow") == got["sovereign-local", "restricted", True]


def test_accepted_patterns_are_linear_on_long_runs(spark):
    patterns = [p for p in GOOD if len(p) > 2]
    rows = None
    for i, p in enumerate(patterns):
        row = detector(spark, rank=i, type="T" + "ABCDEFGHIJ"[i], pattern=p)
        rows = row if rows is None else rows.unionAll(row)
    own = compile_rules(spark, rows)
    texts = spark.createDataFrame([(x * 300_000,) for x in ("a", "ab ", "no1", "7", "red aa ", "A")], "text string")
    with_redaction(texts.limit(1).select(F.lit("x").alias("text")), detectors=own.detectors).collect()
    started = time.time()
    assert len(with_redaction(texts, detectors=own.detectors).select(F.length("redacted")).collect()) == 6
    assert time.time() - started < 60
