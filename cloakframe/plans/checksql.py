"""Building blocks of the check queries (DuckDB dialect)."""

from __future__ import annotations

from cloakframe.catalogue import (
    DETECTORS,
    IBAN_COUNTRIES,
    NOT_PERSONS,
    SPACE,
    SPACE_CHARS,
    TIER_RANK,
    WORD_MASKED_TYPES,
    Detector,
)
from cloakframe.functions.text import EVERY_SPACE
from cloakframe.sources.views import check_sql


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """A catalogue pattern as an RE2 literal; RE2's word boundary is ASCII already."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if pair == r"\s":
            out.append(SPACE_CHARS if in_class else SPACE)
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = (in_class or pair[0] == "[") and pair[0] != "]"
            out.append(pair[0])
            i += 1
    return lit(("(?i)" if ignore_case else "") + "".join(out))


def trim_sql(expr: str) -> str:
    return f"trim({expr}, {lit(EVERY_SPACE)})"


def digit_sum_ok(digits: str) -> str:
    d = f"CAST(substring({digits}, i, 1) AS INT)"
    return (
        f"(regexp_full_match({digits}, '[0-9]+') AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
        f"CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END)) % 10 = 0)"
    )


def valid_sql(detector: Detector, value: str = "value") -> str:
    if detector.check == "luhn":
        digits = f"regexp_replace({value}, '[ -]', '', 'g')"
        return f"length({digits}) >= 13 AND CASE WHEN length({digits}) >= 13 THEN {digit_sum_ok(digits)} ELSE FALSE END"
    if detector.check == "iban_country":
        return f"left({value}, 2) IN ({', '.join(map(lit, IBAN_COUNTRIES))})"
    if detector.check == "seven_digits":
        return f"length(regexp_replace({value}, '[^0-9]', '', 'g')) >= 7"
    if detector.check == "octets":
        return f"len(list_filter(string_split({value}, '.'), lambda p: CAST(p AS INT) > 255)) = 0"
    if detector.check == "not_ui_phrase":
        return f"lower({value}) NOT IN ({', '.join(map(lit, NOT_PERSONS))})"
    return "TRUE"


def matches_sql(detector: Detector, det: int, source: str, key: str = "kind, id", ranked: bool = True) -> str:
    """One row per valid match: key, det, type, start, value."""
    pattern = re2(detector.pattern, detector.ignore_case)
    grouped = bool(detector.value_group)
    extra = f", regexp_extract_all(text, {pattern}, 1) AS g1" if grouped else ""
    picked = "coalesce(nullif(g1[i], ''), g0[i])" if grouped else "g0[i]"
    rank = TIER_RANK[detector.sensitivity] if ranked else 0
    return f"""
SELECT {key}, {det} AS det, {lit(detector.type)} AS type, {rank} AS rank, pos0 + strpos(whole, value) - 1 AS start, value
FROM (SELECT {key}, whole, {trim_sql('picked')} AS value, pos0
      FROM (SELECT {key}, g0[i] AS whole, {picked} AS picked,
                   CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                        + coalesce(list_sum(list_transform(g0[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS pos0
            FROM (SELECT {key}, g0, gaps{', g1' if grouped else ''}, unnest(range(1, len(g0) + 1)) AS i
                  FROM (SELECT {key}, regexp_extract_all(text, {pattern}) AS g0, regexp_split_to_array(text, {pattern}) AS gaps{extra}
                        FROM {source} WHERE regexp_matches(text, {pattern})))))
WHERE value <> '' AND {valid_sql(detector)}"""


def mask_sql(kind: str = "type", value: str = "value") -> str:
    words = ", ".join(map(lit, WORD_MASKED_TYPES))
    spaces = lit(SPACE + "+")
    return f"""CASE WHEN {kind} = 'EMAIL' THEN concat(left(split_part({value}, '@', 1), 1),
       repeat('•', greatest(2, length(split_part({value}, '@', 1)) - 1)), '@', split_part({value}, '@', 2))
     WHEN {kind} IN ({words}) THEN array_to_string(list_transform(regexp_split_to_array({value}, {spaces}),
       lambda w: CASE WHEN length(w) > 1 THEN concat(left(w, 1), repeat('•', length(w) - 1)) ELSE w END), ' ')
     ELSE concat('••••', right(regexp_replace({value}, {lit(SPACE)}, '', 'g'), 3)) END"""


def spans_ctes(source: str, key: str = "kind, id", detectors=DETECTORS, ranked: bool = True, tag: str = "") -> str:
    """CTEs ``spans`` (all matches, ordered by rn) and ``kept`` (after overlap resolution), names ending in ``tag``."""
    every = "\nUNION ALL ".join(matches_sql(d, i, source, key, ranked) for i, d in enumerate(detectors))
    cols = [c.strip() for c in key.split(",")]
    same = " AND ".join(f"o.{c} = w.{c}" for c in cols)
    order = "start, rank DESC, length(value) DESC, det" if ranked else "start, det"
    o_cols = ", ".join(f"o.{c}" for c in cols)
    return f"""spans{tag} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({every})),
walk{tag} AS (
  SELECT {key}, rn, det, type, start, value, TRUE AS taken, start + length(value) AS last_end FROM spans{tag} WHERE rn = 1
  UNION ALL
  SELECT {o_cols}, o.rn, o.det, o.type, o.start, o.value, o.start >= w.last_end,
         CASE WHEN o.start >= w.last_end THEN o.start + length(o.value) ELSE w.last_end END
  FROM walk{tag} w JOIN spans{tag} o ON {same} AND o.rn = w.rn + 1),
kept{tag} AS MATERIALIZED (SELECT {key}, det, type, start, value FROM walk{tag} WHERE taken)"""


def redacted_ctes(source: str, key: str = "kind, id") -> str:
    """CTEs ``entity`` (numbered values) and ``redacted`` (key, text, redacted, n) on top of ``kept``."""
    cols = [c.strip() for c in key.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    catalogue = ", ".join(
        f"({i}, {lit(d.cls)}, {lit(d.sensitivity)}, {lit(d.label)}, {TIER_RANK[d.sensitivity]})"
        for i, d in enumerate(DETECTORS)
    )
    return f"""catalogue(det, cls, sensitivity, label, rank) AS (VALUES {catalogue}),
entity AS MATERIALIZED (
  SELECT {key}, det, type, value, first_start, c.cls, c.sensitivity, c.label, c.rank,
         concat('[', type, '_', row_number() OVER (PARTITION BY {key}, type ORDER BY first_start), ']') AS placeholder,
         {mask_sql()} AS masked
  FROM (SELECT {key}, det, type, value, min(start) AS first_start FROM kept GROUP BY {key}, det, type, value)
  JOIN catalogue c USING (det)),
pieces AS (
  SELECT k.*, e.placeholder,
         coalesce(lag(k.start + length(k.value)) OVER (PARTITION BY {', '.join('k.' + c for c in cols)} ORDER BY k.start), 0) AS prev_end
  FROM kept k JOIN entity e ON {on('k', 'e')} AND k.det = e.det AND k.value = e.value),
redacted AS MATERIALIZED (
  SELECT s.*, CASE WHEN p.n IS NULL THEN s.text ELSE concat(p.body, substring(s.text, p.last_end + 1)) END AS redacted,
         coalesce(p.n, 0) AS n_spans
  FROM {source} s LEFT JOIN (
    SELECT {', '.join('p.' + c for c in cols)}, count(*) AS n, max(p.start + length(p.value)) AS last_end,
           string_agg(concat(substring(s.text, p.prev_end + 1, p.start - p.prev_end), p.placeholder), '' ORDER BY p.start) AS body
    FROM pieces p JOIN {source} s ON {on('p', 's')} GROUP BY {', '.join('p.' + c for c in cols)}) p ON {on('p', 's')})"""


def with_views(views: list[str], *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([check_sql(*views), *ctes])


def spaced(views: list[str], ctes: list[str], body: str) -> str:
    return with_views(views, *ctes) + "\n" + body


def fill_sql(template: str, parts: dict[str, str]) -> str:
    """A reply template as a SQL concatenation."""
    pieces = []
    for i, chunk in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            pieces.append(parts[chunk])
        elif chunk:
            pieces.append(lit(chunk))
    return f"concat({', '.join(pieces)})"


def reply_sql(lower: str, intents: dict[str, str], replies: dict[str, str], parts: dict[str, str]) -> str:
    whens = " ".join(f"WHEN regexp_matches({lower}, {lit(p)}) THEN {fill_sql(replies[i], parts)}" for i, p in intents.items())
    return f"CASE {whens} ELSE {fill_sql(replies['other'], parts)} END"


def chat_round_ctes(rounds: int = 3) -> list[str]:
    """Conversation redaction over ``users`` by rounds: detect, replace earlier values, detect again.

    Each round settles at least one more dependent turn, so for shallow data a few rounds
    reach the turn-by-turn result: ``chat`` (conv_id, turn, redacted, protected_count, n_new)
    and ``chat_vault``.
    """
    key = "conv_id, turn"
    ctes = ["residue0 AS MATERIALIZED (SELECT conv_id, turn, text, 0 AS n_known FROM users)", spans_ctes("residue0", key, tag="0")]
    for k in range(1, rounds + 1):
        ctes += [
            f"""vault{k} AS MATERIALIZED (
  SELECT *, concat('[', type, '_', row_number() OVER (PARTITION BY conv_id, type ORDER BY first), ']') AS mark
  FROM (SELECT conv_id, det, type, value, min({{'t': turn, 's': start}}) AS first FROM kept{k - 1} GROUP BY ALL))""",
            f"""hits{k} AS MATERIALIZED (
  SELECT u.conv_id, u.turn, v.value, v.mark, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY length(v.value) DESC, v.first) AS nth
  FROM users u JOIN vault{k} v ON v.conv_id = u.conv_id AND v.first.t < u.turn AND contains(u.text, v.value))""",
            f"""steps{k} AS (
  SELECT conv_id, turn, 0 AS nth, text AS work, 0 AS n FROM users
  UNION ALL
  SELECT s.conv_id, s.turn, s.nth + 1, replace(s.work, h.value, h.mark), s.n + CAST(contains(s.work, h.value) AS INT)
  FROM steps{k} s JOIN hits{k} h ON h.conv_id = s.conv_id AND h.turn = s.turn AND h.nth = s.nth + 1)""",
            f"residue{k} AS MATERIALIZED (SELECT conv_id, turn, arg_max(work, nth) AS text, arg_max(n, nth) AS n_known FROM steps{k} GROUP BY conv_id, turn)",
            spans_ctes(f"residue{k}", key, tag=str(k)),
        ]
    last = rounds
    ctes += [
        f"""marked AS (
  SELECT k.*, v.mark, coalesce(lag(k.start + length(k.value)) OVER (PARTITION BY k.conv_id, k.turn ORDER BY k.start), 0) AS prev_end
  FROM kept{last} k JOIN vault{last} v ON v.conv_id = k.conv_id AND v.det = k.det AND v.value = k.value)""",
        f"""bodies AS (
  SELECT m.conv_id, m.turn, count(DISTINCT m.mark) AS n_new, max(m.start + length(m.value)) AS last_end,
         string_agg(concat(substring(r.text, m.prev_end + 1, m.start - m.prev_end), m.mark), '' ORDER BY m.start) AS body
  FROM marked m JOIN residue{last} r ON r.conv_id = m.conv_id AND r.turn = m.turn GROUP BY m.conv_id, m.turn)""",
        f"""chat AS MATERIALIZED (
  SELECT r.conv_id, r.turn, concat(coalesce(b.body, ''), substring(r.text, coalesce(b.last_end, 0) + 1)) AS redacted,
         r.n_known + coalesce(b.n_new, 0) AS protected_count, coalesce(b.n_new, 0) AS n_new
  FROM residue{last} r LEFT JOIN bodies b ON b.conv_id = r.conv_id AND b.turn = r.turn)""",
        f"chat_vault AS (SELECT conv_id, det, type, value, first, mark FROM vault{last})",
    ]
    return ctes
