"""Format-preserving pseudonyms by a keyed Feistel permutation, in column expressions only.

Candidates are cut out of the text by one pattern and checked: card numbers by their check digit, IBANs by modulus 97 (cut at the length of their country), social
security numbers by their ranges, dates by the calendar, IPv4 addresses by their octets, telephone numbers by their
length.  A valid value is permuted within the set of valid values of its kind and written back in its own
punctuation, so equal values stay equal in all documents, different ones stay different, and ``restore=True`` inverts it with
the key.  Kept as they are: a card's first digit, an IBAN's country and letters, a telephone number's country code.

Mail addresses, access keys and assigned secrets are no numbers: they become keyed digests of the same kind, which link
equal values too but cannot be inverted.

Defined cases: a null text stays null, an empty one empty; candidates that fail their check stay as they are; a text of any
length is read whole, in time linear in its length; rows that repeat an id are treated each on their own; extra columns
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 64
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
# Lengths of IBANs by country: what follows an IBAN in capitals is no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_KNOWN = "|".join(
    rf"(?:{'|'.join(lands.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9_])"
    for n, lands in IBAN_LENGTHS.items())
IBAN = (rf"\b(?:{IBAN_KNOWN}|[A-Z]{{2}}\d{{2}}(?!(?: [A-Z0-9]{{1,4}}){{0,6}} (?:{IBAN_KNOWN}))"
        r"(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)")
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
# A card in its usual groups or in one piece; the short number behind it may be its end or a neighbour.
CARD_SHAPE = r"\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|\d{13,19}(?!\d)"
CARD = (rf"(?<!\d)(?:(?:{CARD_SHAPE})(?:[ -]\d{{1,3}}(?!\d))?"
        rf"|(?!(?:\d{{1,12}}[ -]){{1,4}}(?:{CARD_SHAPE}))\d(?:[ -]?\d){{12,18}}(?!\d))")
ANY = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, IPV4, DATE, SSN, PHONE, CARD))
CARD_AND_NUMBER = rf"(?:{CARD_SHAPE})[ -]\d{{1,3}}"
KEY = "_pseudonym_key"
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def whole(pattern: str) -> str:
    return literal(rf"^(?:{pattern})$")


class Permutation:
    """SQL texts of keyed permutations; ``back`` gives the inverse ones.

    The key is the column ``KEY``, so that no plan, and no log of plans, holds it.
    """

    def __init__(self, back: bool = False):
        self.order, self.sign = (f"sequence({ROUNDS - 1}, 0, -1)", "-") if back else (f"sequence(0, {ROUNDS - 1})", "+")

    def noise(self, kind: str, i: str, x: str) -> str:
        return f"CAST(conv(substr(sha2(concat({KEY}, '|{kind}|', {i}, '|', {x}), 256), 1, 15), 16, 10) AS BIGINT)"

    def rounds(self, kind: str, x: str, y: str, xs: str, ys: str, finish: str) -> str:
        """Feistel rounds over x < xs and y < ys; ``finish`` maps the struct s(x, y)."""
        return f"""aggregate({self.order}, named_struct('x', CAST({x} AS BIGINT), 'y', CAST({y} AS BIGINT)),
            (s, i) -> IF(i % 2 = 0, named_struct('x', pmod(s.x {self.sign} {self.noise(kind, 'i', 's.y')} % {xs}, {xs}), 'y', s.y),
                                    named_struct('x', s.x, 'y', pmod(s.y {self.sign} {self.noise(kind, 'i', 's.x')} % {ys}, {ys}))),
            s -> {finish})"""

    def number(self, kind: str, value: str, xs: int, ys: int) -> str:
        return self.rounds(kind, f"({value}) DIV {ys}", f"({value}) % {ys}", str(xs), str(ys), f"s.x * {ys} + s.y")

    def walk(self, kind: str, value: str, xs: int, ys: int, fits: str) -> str:
        """Permute until the result ``v`` fits; the values that fit are permuted among themselves."""
        return f"""aggregate(sequence(1, {WALK}), named_struct('v', CAST({value} AS BIGINT), 'done', false),
            (w, j) -> IF(w.done, w, transform(array({self.number(kind, 'w.v', xs, ys)}), v -> named_struct('v', v, 'done', {fits}))[0]), w -> w.v)"""

    def digits(self, kind: str, d: str) -> str:
        """Permute a string of two or more digits."""
        left, right = f"(length({d}) DIV 2)", f"(length({d}) - length({d}) DIV 2)"
        return self.rounds(
            kind, f"substr({d}, 1, CAST({left} AS INT))", f"substr({d}, 1 + CAST({left} AS INT))",
            f"CAST(rpad('1', CAST(1 + {left} AS INT), '0') AS BIGINT)", f"CAST(rpad('1', CAST(1 + {right} AS INT), '0') AS BIGINT)",
            f"concat(lpad(s.x, CAST({left} AS INT), '0'), lpad(s.y, CAST({right} AS INT), '0'))")

    def token(self, kind: str, x: str) -> str:
        return f"sha2(concat({KEY}, '|{kind}|', {x}), 256)"


def luhn_sum(d: str) -> str:
    """The check sum of digits ``d``, the last one counting once."""
    return f"""aggregate(transform(split(reverse({d}), ''), (c, i) -> IF(i % 2 = 0, CAST(c AS INT), IF(CAST(c AS INT) > 4, 2 * CAST(c AS INT) - 9, 2 * CAST(c AS INT)))), 0, (a, x) -> a + coalesce(x, 0))"""


def mod97(compact: str) -> str:
    """The modulus of an IBAN without spaces, its first four characters last."""
    return f"""aggregate(split(concat(substr({compact}, 5), substr({compact}, 1, 4)), ''), 0L,
        (a, c) -> CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + CAST(c AS INT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"""


def filled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return f"""aggregate(split({shape}, ''), named_struct('out', '', 'k', 1),
        (s, c) -> IF(c BETWEEN '0' AND '9' AND c <> '', named_struct('out', concat(s.out, substr({digits}, s.k, 1)), 'k', s.k + 1),
                     named_struct('out', concat(s.out, c), 'k', s.k)), s -> s.out)"""


def kind_of(m: str, d: str) -> str:
    octets = " AND ".join(f"CAST(split({m}, '[.]')[{i}] AS INT) < 256" for i in range(4))
    compact = f"replace({m}, ' ', '')"
    in_range = f"BETWEEN DATE'{FIRST_DAY}' AND DATE'2099-12-31'"
    return f"""CASE
        WHEN {m} RLIKE {whole(EMAIL)} THEN 'email'
        WHEN {m} RLIKE {whole(ACCESS_KEY)} THEN 'access_key'
        WHEN {m} RLIKE {whole(SECRET)} THEN 'secret'
        WHEN {m} RLIKE {whole(IBAN)} THEN IF(length({compact}) BETWEEN 15 AND 34 AND {mod97(compact)} = 1 AND length({d}) >= 4, 'iban', NULL)
        WHEN {m} RLIKE {whole(IPV4)} THEN IF({octets}, 'ipv4', NULL)
        WHEN {m} RLIKE '^[0-9]{{4}}-' AND length({d}) = 8 THEN IF(try_to_date({m}, 'yyyy-MM-dd') {in_range}, 'date', NULL)
        WHEN {m} RLIKE '^[0-9]{{2}}/' THEN CASE WHEN try_to_date({m}, 'dd/MM/yyyy') {in_range} THEN 'date_day_first'
                                              WHEN try_to_date({m}, 'MM/dd/yyyy') {in_range} THEN 'date_month_first' END
        WHEN {m} RLIKE {whole(SSN)} THEN IF(substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9'
                                            AND substr({d}, 4, 2) <> '00' AND substr({d}, 6) <> '0000', 'ssn', NULL)
        WHEN {m} RLIKE {whole(CARD)} AND length({d}) <= 19 AND {luhn_sum(d)} % 10 = 0 THEN 'card'
        WHEN {m} RLIKE {whole(PHONE)} THEN IF(length({d}) BETWEEN 7 AND 15, 'phone', NULL) END"""


def renamed(p: Permutation) -> str:
    """SQL text: the pseudonym of a checked candidate ``x`` (c: m, d, kind; y: its new digits)."""
    day = lambda form: f"datediff(to_date(x.c.m, '{form}'), DATE'{FIRST_DAY}')"
    dated = lambda value, form: f"date_format(date_add(DATE'{FIRST_DAY}', CAST({value} AS INT)), '{form}')"
    area = "CAST(substr(x.c.d, 1, 3) AS BIGINT)"
    ssn = f"(({area} - IF({area} > 666, 2, 1)) * 99 + CAST(substr(x.c.d, 4, 2) AS BIGINT) - 1) * 9999 + CAST(substr(x.c.d, 6) AS BIGINT) - 1"
    octet = lambda i: f"CAST(split(x.c.m, '[.]')[{i}] AS BIGINT)"
    ip = f"({octet(0)} * 16777216 + {octet(1)} * 65536 + {octet(2)} * 256 + {octet(3)})"
    late_day = f"v < {DAYS} AND day(date_add(DATE'{FIRST_DAY}', CAST(least(v, {DAYS - 1}) AS INT))) > 12"
    return f"""CASE x.c.kind
      WHEN 'card' THEN {filled('x.c.m', "x.y")}
      WHEN 'phone' THEN {filled('x.c.m', "x.y")}
      WHEN 'iban' THEN {filled('x.c.m', "x.y")}
      WHEN 'ssn' THEN transform(array({p.number('ssn', ssn, 898 * 99, 9999)}), v -> concat(
          lpad(IF(v DIV 989901 + 1 >= 666, v DIV 989901 + 2, v DIV 989901 + 1), 3, '0'), '-', lpad((v DIV 9999) % 99 + 1, 2, '0'), '-', lpad(v % 9999 + 1, 4, '0')))[0]
      WHEN 'date' THEN {dated(p.walk('date', day('yyyy-MM-dd'), 271, 270, f'v < {DAYS}'), 'yyyy-MM-dd')}
      WHEN 'date_day_first' THEN {dated(p.walk('date', day('dd/MM/yyyy'), 271, 270, f'v < {DAYS}'), 'dd/MM/yyyy')}
      WHEN 'date_month_first' THEN {dated(p.walk('late', day('MM/dd/yyyy'), 271, 270, late_day), 'MM/dd/yyyy')}
      WHEN 'ipv4' THEN transform(array({p.number('ipv4', ip, 65536, 65536)}), v -> concat_ws('.', v DIV 16777216, (v DIV 65536) % 256, (v DIV 256) % 256, v % 256))[0]
      WHEN 'email' THEN concat('user.', substr({p.token('email', 'lower(x.c.m)')}, 1, 16), '@mail.invalid')
      WHEN 'access_key' THEN concat('AKIA', upper(substr({p.token('access', 'x.c.m')}, 1, 16)))
      WHEN 'secret' THEN concat(regexp_extract(x.c.m, '^[^=:]*[=:]\\\\s*["\\']?', 0), substr({p.token('secret', "regexp_extract(x.c.m, '[=:]\\\\s*[\"\\']?(.*)$', 1)")}, 1, 24))
      ELSE x.c.m END"""


def pseudonymise(documents: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """The documents with their text rewritten, and ``found``: array of (kind, pseudonym) in the order of the text."""
    p = Permutation(restore)
    secret = documents.sparkSession.createDataFrame([(hashlib.sha256(key.encode()).hexdigest(),)], f"{KEY} string")
    marked = documents.crossJoin(F.broadcast(secret)).select(  # one row
        "*",
        # Nearly all texts without digits, signs and AKIA hold no candidate; the pattern runs only on the others.
        F.expr(f"IF(text RLIKE '[0-9@=:]|AKIA', regexp_extract_all(text, {literal(ANY)}, 0), array())").alias("_matches"),
    )
    # Behind a card in its usual groups a short number is its end only if the card is none without it.  In other groups the whole is
    # tried first.  (tail: the number behind the card; n_head: digits before a short number that is the card's end)
    tried = marked.withColumn("_tried", F.expr(f"""
        transform(transform(coalesce(_matches, array()), m -> named_struct('m', m, 'd', regexp_replace(m, '[^0-9]', ''))),
                  f -> named_struct('m', f.m, 'd', f.d, 'kind', {kind_of('f.m', 'f.d')}, 'sure', f.m RLIKE {whole(CARD_AND_NUMBER)},
                                    'head', IF(f.m RLIKE {whole(CARD)}, regexp_extract(f.m, '^(.*)[ -][0-9]+$', 1), '')))"""))
    checked = tried.withColumn("_found", F.expr(f"""
        transform(transform(_tried, f -> named_struct('f', f, 'd', regexp_replace(f.head, '[^0-9]', ''))),
                  h -> IF((h.f.kind IS NULL OR h.f.sure AND h.f.kind = 'card') AND length(h.d) BETWEEN 13 AND 19 AND {luhn_sum('h.d')} % 10 = 0,
                          named_struct('m', h.f.head, 'd', h.d, 'kind', 'card', 'tail', substr(h.f.m, length(h.f.head) + 1), 'sure', h.f.sure, 'n_head', 0),
                          named_struct('m', h.f.m, 'd', h.f.d, 'kind', h.f.kind, 'tail', '', 'sure', h.f.sure, 'n_head', IF(h.f.sure, length(h.d), 0))))"""))
    country = r"regexp_replace(regexp_extract(c.m, '^[+][0-9]{1,3}(?=[ .(-])', 0), '[^0-9]', '')"
    # Restoring must cut the new text alike.  A card before a short number is one whatever follows, so its pseudonym depends on
    # nothing else; in other groups it is permuted until it fails with the number behind it, and a card that ends with a short
    # number until it fails without it.
    tail = "regexp_replace(c.tail, '[^0-9]', '')"
    full = "concat(substr(c.d, 1, 1), v)"
    zero = f"concat({full}, '0')"
    number = f"concat({full}, pmod(10 - {luhn_sum(zero)} % 10, 10), {tail})"
    fails = f"{luhn_sum(number)} % 10 <> 0"
    head = f"substr({number}, 1, c.n_head)"
    fits = f"""CASE WHEN c.n_head > 0 THEN {luhn_sum(head)} % 10 <> 0
        WHEN c.tail = '' OR c.sure OR length(c.d) + length({tail}) > 19 THEN true ELSE {fails} END"""
    card = f"""aggregate(sequence(1, {WALK}), named_struct('v', substr(c.d, 2, length(c.d) - 2), 'done', false),
        (w, j) -> IF(w.done, w, transform(array({p.digits('card', 'w.v')}), v -> named_struct('v', v, 'done', {fits}))[0]),
        w -> w.v)"""
    # The new digits of cards, telephone numbers and IBANs: what is kept, what is permuted, what follows from both.
    fresh = checked.withColumn("_digits", F.expr(f"""
        transform(_found, c -> CASE c.kind
          WHEN 'card' THEN concat(substr(c.d, 1, 1), {card})
          WHEN 'phone' THEN concat({country}, {p.digits('phone', f"substr(c.d, 1 + length({country}))")})
          WHEN 'iban' THEN {p.digits('iban', "substr(c.d, 3)")} END)"""))
    body = "concat(substr(replace(c.m, ' ', ''), 1, 2), '00', substr(replace(c.m, ' ', ''), 5))"
    closed = fresh.withColumn("_closed", F.expr(f"""
        zip_with(_found, _digits, (c, y) -> named_struct('c', c, 'y', CASE c.kind
          WHEN 'card' THEN concat(y, pmod(10 - {luhn_sum("concat(y, '0')")} % 10, 10))
          WHEN 'iban' THEN transform(array({filled(body, "concat('00', y)")}), b -> concat(lpad(98 - {mod97('b')}, 2, '0'), y))[0]
          ELSE y END))"""))
    named = closed.withColumn("_new", F.expr(f"transform(_closed, x -> {renamed(p)})"))
    return named.select(
        *[F.expr(f"""IF(size(_new) = 0, text, array_join(zip_with(split(text, {literal(ANY)}), zip_with(_found, _new, (c, n) -> concat(n, c.tail)),
             (gap, n) -> concat(gap, coalesce(n, ''))), ''))""").alias("text") if c == "text" else F.col(c) for c in documents.columns if c != "found"],
        F.expr("""filter(zip_with(_found, _new, (c, n) -> named_struct('kind', c.kind, 'pseudonym', n)), x -> x.kind IS NOT NULL)""").alias("found"),
    )
