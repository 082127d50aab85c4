"""Rules as data: detectors, header rules and policy rows from tables, compiled into the expressions every operator uses.

A rule table is small (``MOST_RULES`` rows, checked) and comes to the driver once; what it compiles to are the same gated column
expressions, header rules and policy join that the built-in rules give.  A detector whose matching could take more than linear time is refused
(``linear``), as is a pattern that Spark cannot compile.  Rules of a table come after the built-in ones: on the same start, tier and length the
earlier detector wins, and the first header rule that fits names a column; a policy row replaces the one for its destination and tier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession

from cloakframe import catalogue as c

MOST_RULES, MOST_STEPS = 500, 100_000
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


@dataclass(frozen=True)
class Rulebook:
    detectors: tuple[c.Detector, ...] = c.DETECTORS
    headers: tuple[tuple[str, str, tuple[str, ...]], ...] = c.HEADER_RULES
    policy: tuple[tuple[str, str, str], ...] = c.POLICY

    def destinations(self) -> list[str]:
        return list(dict.fromkeys([c.DEFAULT_DESTINATION, c.EXTERNAL_DESTINATION, *(d for d, _t, _r in self.policy)]))


BUILT_IN = Rulebook()


def _only_word(items) -> bool:
    """Whether a character class holds word characters only."""
    ranges = {kind.CATEGORY_WORD, kind.CATEGORY_DIGIT}
    return all(
        (op is kind.LITERAL and chr(av) in WORD) or (op is kind.RANGE and all(chr(x) in WORD for x in range(av[0], av[1] + 1))) or (op is kind.CATEGORY and av in ranges)
        for op, av in items)


def _steps(items, word_so_far: bool, last: bool) -> tuple[int, bool]:
    """How many steps an attempt at one place may take at most (unlimited runs aside), and whether all that was matched are word characters.

    An unlimited run is linear only if no attempt can start inside what it reads and nothing it gives back can be tried again:
    behind a word boundary, over word characters alone, and followed by nothing that could match them.
    """
    steps = 1
    for i, (op, av) in enumerate(items):
        end = last and i == len(items) - 1
        if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            low, high, body = av
            inner, wordy = _steps(list(body), True, False)
            if high is kind.MAXREPEAT:
                single = len(body) == 1 and body[0][0] in (kind.IN, kind.LITERAL)
                held = body[0][1] if single and body[0][0] is kind.IN else [body[0]] if single else []
                follows = items[i + 1] if i + 1 < len(items) else None
                closed = end or (follows is not None and (follows[0] is kind.AT or (follows[0] is kind.LITERAL and chr(follows[1]) not in WORD)))
                if not (single and word_so_far and _only_word(held) and closed and op is kind.MAX_REPEAT):
                    raise ValueError("a run without limit must stand behind \\b, hold word characters only and end at another character; give it a limit such as {1,64}")
            else:
                steps *= max(1, (int(high) - int(low) + 1)) * inner ** min(int(high), 8)
            word_so_far = word_so_far and wordy
        elif op is kind.SUBPATTERN:
            inner, word_so_far = _steps(list(av[3]), word_so_far, end)
            steps *= inner
        elif op is kind.BRANCH:
            found = [_steps(list(b), word_so_far, end) for b in av[1]]
            steps *= sum(n for n, _ in found)
            word_so_far = all(w for _, w in found)
        elif op is kind.IN:
            word_so_far = word_so_far and _only_word(av)
        elif op is kind.LITERAL:
            word_so_far = word_so_far and chr(av) in WORD
        elif op is kind.AT:
            word_so_far = word_so_far or (av is kind.AT_BOUNDARY and i == 0)
        elif op in (kind.ANY, kind.NOT_LITERAL):
            word_so_far = False
        else:
            raise ValueError("look-around, back references and conditions are not supported")
        if steps > MOST_STEPS:
            raise ValueError("nested repeats may try too many ways at one place")
    return steps, word_so_far


def linear(pattern: str) -> None:
    """Raise ValueError unless matching takes time linear in the text, whatever the text."""
    parsed = list(parser.parse(pattern))
    if parser.parse(pattern).getwidth()[0] == 0:
        raise ValueError("a pattern must match one character at least")
    bounded = bool(parsed) and parsed[0] == (kind.AT, kind.AT_BOUNDARY)
    _steps(parsed, bounded, True)


def _rows(table: DataFrame, order: str) -> list:
    rows = table.orderBy(order).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table holds {MOST_RULES} rows at most")
    return rows


def _fits(value: str | None, shape: str, what: str) -> str:
    if value is None or not re.fullmatch(shape, value):
        raise ValueError(f"{what} {value!r} must look like {shape}")
    return value


def _detector(spark: SparkSession, r) -> c.Detector:
    if r.sensitivity not in c.TIER_RANK:
        raise ValueError(f"sensitivity must be one of {sorted(c.TIER_RANK)}")
    try:
        linear(r.pattern)
    except (ValueError, re.error) as error:
        raise ValueError(f"pattern of {r.type}: {error}") from error
    if r.check not in (None, "luhn", "seven_digits", "octets"):
        raise ValueError(f"no check is called {r.check!r}")
    group = int(r.value_group or 0)
    if group not in (0, 1) or re.compile(r.pattern).groups < group:
        raise ValueError(f"pattern of {r.type} has no group {group}")
    made = c.Detector(
        _fits(r.type, "[A-Z]+", "type"), _fits(r.cls, "[a-z-]+", "class"), r.sensitivity, _fits(r.label, r"[\w ()/-]+", "label"), r.pattern,
        ignore_case=bool(r.ignore_case), value_group=group, check=r.check, literals=tuple(_fits(x, r"[^'\\]+", "literal") for x in r.literals or ()))
    spark.sql(f'SELECT rlike(\'\', r"{made.java_regex()}")').collect()  # refused here rather than in a job
    return made


def compile_rules(
    spark: SparkSession, detectors: DataFrame | None = None, headers: DataFrame | None = None, policy: DataFrame | None = None, base: Rulebook = BUILT_IN,
) -> Rulebook:
    """The rules of ``base`` and of the tables given.

    ``detectors``: rank, type, cls, sensitivity, label, pattern, ignore_case, value_group, literals (array; a text without any of them is not
    searched), check.  ``headers``: rank, type, label, words (array).  ``policy``: dest, tier, rule.
    """
    own = [_detector(spark, r) for r in _rows(detectors, "rank")] if detectors is not None else []
    named = []
    for r in _rows(headers, "rank") if headers is not None else []:
        words = tuple(w.strip().lower() for w in r.words or () if w and w.strip())
        if not words:
            raise ValueError(f"header rule {r.type} has no words")
        named.append((_fits(r.type, "[A-Z]+", "type"), _fits(r.label, r"[\w ()/-]+", "label"), words))
    rows = {(d, t): rule for d, t, rule in base.policy}
    for r in _rows(policy, "dest") if policy is not None else []:
        if r.tier not in (*c.TIER_RANK, "none") or r.rule not in c.STATUS_OF_DECISION:
            raise ValueError(f"policy row {tuple(r)} has an unknown tier or decision")
        rows[_fits(r.dest, "[a-z][a-z0-9-]*", "destination"), r.tier] = r.rule
    return Rulebook((*base.detectors, *own), (*base.headers, *named), tuple((d, t, rule) for (d, t), rule in rows.items()))

