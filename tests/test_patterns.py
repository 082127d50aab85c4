"""Linear-time spellings of patterns find what the catalogue patterns find, and survive long texts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from cloakframe import catalogue as c
from cloakframe.functions.redaction import with_redaction, with_spans
from cloakframe.operators.screening import screened_text, with_findings
from tests.sample_prompts import SAMPLE_PROMPTS


def compiled(pattern: str, ignore_case: bool) -> re.Pattern:
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))


def texts(n: int = 300) -> list[str]:
    rng = random.Random(11)
    parts = ["a", "b1", ".", "-", "+", "%", "@", "_", "x.qa", "com", " ", "é", "Ab", "Cd", "X", "\n", "a@b.co", "Ef Gh"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(n)]


def plain_matches(detector: c.Detector, text: str) -> list[tuple[int, str]]:
    return [(m.start(), m.group(0)) for m in compiled(detector.pattern, detector.ignore_case).finditer(text)]


def test_column_form_of_email_and_person(spark):
    data = texts(1500)
    df = spark.createDataFrame(list(enumerate(data)), "id long, text string")
    for catalogue, kind in ((c.DETECTORS, "EMAIL"), (c.SCREENING, "EMAIL"), (c.SCREENING, "PERSON")):
        only = [d for d in catalogue if d.type == kind]
        rows = with_spans(df, "text", only, ranked=False).select("id", "spans").collect()
        for row in rows:
            assert [(s["start"], s["value"]) for s in row["spans"]] == plain_matches(only[0], data[row["id"]])


def test_gates_are_necessary_conditions():
    rng = random.Random(2)
    pieces = [p[4] for p in SAMPLE_PROMPTS] + ["Villa 12 west", "born 1.1.90", "mrn 55555", "Apt\nabc def", "+974-5512-3456", "5512 3456",
                                               "Eng. Al", "Sheikha\tReem", "ST. abc def", "DATE OF BIRTH: 1/1/90"]
    for _ in range(2000):
        text = rng.choice(pieces)[rng.randint(0, 20):] + rng.choice(["", " ", "é", "_"]) + rng.choice(pieces)
        for d in c.DETECTORS:
            if d.gate and compiled(d.pattern, d.ignore_case).search(text):
                gate = c.GATES[d.gate]
                assert not gate.literals or any(literal in text for literal in gate.literals), (d.type, text)
                assert all(compiled(p, False).search(text) for p in gate.patterns), (d.type, text)


def test_long_texts_finish(spark):
    long = ["Ab Cd " * 20000, "a.b-c%d+" * 10000 + "@", "4111 1111 1111 1111 " * 300, " ".join(f"m{i}@x.qa" for i in range(600)), " " * 50000 + "```"]
    df = spark.createDataFrame(list(enumerate(long)), "id long, text string")
    done = {r["id"]: r["n"] for r in with_redaction(df).select("id", F.size("entities").alias("n")).collect()}
    assert done == {0: 0, 1: 0, 2: 1, 3: 600, 4: 0}
    screened = with_findings(df).select("id", screened_text(F.col("text"), F.col("findings")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in screened}[0].strip() == "[PERSON_1]"


def test_java_spelling_has_no_plain_boundary():
    for detector in c.DETECTORS + c.SCREENING:
        assert not re.search(r"(?<!\\)\\b", detector.java_regex())
