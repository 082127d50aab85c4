"""Entity spans as array columns: find, validate and resolve overlaps inside the row.

A span is ``struct<start, rank_key, len_key, det, value>``.  Field order is the sort order
of overlap resolution (earliest start, higher tier, longer, catalogue order), so sorting an
array of spans needs no comparator.  ``det`` indexes the catalogue, from which type, class,
tier and label follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.catalogue import DETECTORS, GATES, IBAN_COUNTRIES, NOT_PERSONS, TIER_RANK, Detector, Gate, java_pattern
from cloakframe.functions.text import EVERY_SPACE

SPANS = "array<struct<start:int,rank_key:int,len_key:int,det:int,value:string>>"


NO_SPANS = f"CAST(array() AS {SPANS})"
BLOCK = 256


def scanned(items: str, first: str, state: str, keep: str, element: str) -> str:
    """SQL: walk the array ``items`` with a running number; the spans kept on the way.

    ``state``, ``keep`` and ``element`` are SQL over ``acc.s`` (the number so far) and ``m`` (the item).  A fold that appends copies
    what it holds at each step, so it is done in blocks: a block's spans are appended one by one, the blocks one by one.
    """
    inner = f"""aggregate(part, struct(done.s AS s, {NO_SPANS} AS found),
            (acc, m) -> struct({state} AS s, if({keep}, array_append(acc.found, {element}), acc.found) AS found))"""
    return f"""transform(array({items}), items -> aggregate(
        transform(sequence(0, greatest(size(items) - 1, 0) DIV {BLOCK}), b -> slice(items, b * {BLOCK} + 1, {BLOCK})),
        struct({first} AS s, CAST(array() AS array<{SPANS}>) AS found),
        (done, part) -> transform(array({inner}), r -> struct(r.s AS s, array_append(done.found, r.found) AS found))[0],
        done -> flatten(done.found)))[0]"""


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if '"' in pattern:
        raise ValueError("patterns must not hold a double quote")
    return f'r"{pattern}"'


def valid_expr(detector: Detector, value: str) -> str:
    """The detector's own test on a matched value, as SQL."""
    if detector.check == "luhn":
        digits = f"regexp_replace({value}, '[ -]', '')"
        return f"(length({digits}) >= 13 AND luhn_check({digits}))"
    if detector.check == "iban_country":
        return f"left({value}, 2) IN {IBAN_COUNTRIES}"
    if detector.check == "seven_digits":
        return f"length(regexp_replace({value}, '[^0-9]', '')) >= 7"
    if detector.check == "octets":
        return f"NOT exists(split({value}, '[.]'), p -> CAST(p AS INT) > 255)"
    if detector.check == "not_ui_phrase":
        return f"lower({value}) NOT IN {NOT_PERSONS}"
    return "TRUE"


def gate_expr(text: str, gate: Gate) -> str:
    literals = " OR ".join(f"contains({text}, '{literal}')" for literal in gate.literals)
    patterns = [f"rlike({text}, {_raw(java_pattern(p))})" for p in gate.patterns]
    return " AND ".join([f"({literals})"] * bool(literals) + patterns)


def gate_flags(text: str, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """One boolean per gate the detectors use."""
    names = list(dict.fromkeys(d.gate for d in detectors if d.gate))
    return F.expr("named_struct(" + ", ".join(f"'{n}', {gate_expr(text, GATES[n])}" for n in names) + ")")


def detector_expr(text: str, gates: str, detectors: Sequence[Detector], det: int, ranked: bool = True) -> str:
    """All valid matches of one detector in text order, as SQL.

    Offsets come from the gaps between matches: match i starts after gaps 0..i and
    matches 0..i-1.  A text without a match costs its gate, or one search.
    """
    detector = detectors[det]
    pattern = _raw(detector.java_regex())
    parts = f"split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0)"
    picked = "m.`1`"
    if detector.group:
        parts += f", regexp_extract_all({text}, {pattern}, {detector.group})"
        picked = "if(m.`2` = '', m.`1`, m.`2`)"
    value = f"trim(BOTH '{EVERY_SPACE}' FROM {picked})"
    start = f"acc.s + length(m.`0`) + position({value}, m.`1`) - 1"
    rank_key = -TIER_RANK[detector.sensitivity] if ranked else 0
    len_key = f"-length({value})" if ranked else "0"
    span = f"struct({start} AS start, {rank_key} AS rank_key, {len_key} AS len_key, {det} AS det, {value} AS value)"
    keep = f"m.`1` IS NOT NULL AND {value} <> '' AND {valid_expr(detector, value)}"
    search = f"rlike({text}, {pattern})"
    if detector.literals:
        search = f"{gate_expr(text, Gate(detector.literals))} AND {search}"
    found = scanned(f"arrays_zip({parts})", "0", "acc.s + length(m.`0`) + coalesce(length(m.`1`), 0)", keep, span)
    return f"""CASE WHEN {f"{gates}.{detector.gate} AND {search}" if detector.gate else search} THEN {found} ELSE {NO_SPANS} END"""


def all_spans(text: str, gates: str, detectors: Sequence[Detector] = DETECTORS, ranked: bool = True) -> Column:
    """The union of every detector's matches."""
    found = [detector_expr(text, gates, detectors, i, ranked) for i in range(len(detectors))]
    return F.expr(f"concat({', '.join(found)})")


def resolve_overlaps(spans: str) -> Column:
    """In sort order, keep a span when it starts at or after the end of the last kept one."""
    fits = "m.start >= acc.s"
    kept = scanned(f"sort_array({spans})", "0", f"if({fits}, m.start + length(m.value), acc.s)", fits, "m")
    return F.expr(f"if(size({spans}) <= 1, {spans}, {kept})")


def catalogue_field(det: Column, detectors: Sequence[Detector], field: str) -> Column:
    """Look up a catalogue attribute of a span by its detector index."""
    values = ", ".join(f"'{getattr(d, field)}'" for d in detectors)
    return F.element_at(F.expr(f"array({values})"), det + 1)
