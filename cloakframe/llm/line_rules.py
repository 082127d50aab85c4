"""Line-first cleaning: rules per line, then a verdict on what is left, by column expressions only.

A line that holds a word fails if it is navigation (a run of short entries between ``|``, ``»`` or ``>``, or nothing but
menu words), boilerplate (stock phrases make up a quarter of it or more, so prose that only mentions one stays), or badly
punctuated (most words carry a symbol or an exclamation mark, or a long line that stops without any closing mark and holds
no mark inside either).  Failing lines are removed; a document is
rejected when more than ``max_lost`` of its words went with them, or when the base rules fail: fewer than 50 words, or
more than half of its words inside three-word windows found twice or more.

Defined cases: a null or empty text has no words, fails the base rules and gives an empty cleaned text; a text of any length
is read whole (windows are hashed and sorted inside the row, so the work per word grows with the logarithm); rows that
repeat an id are judged each on their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MENU = (
    "home|menu|login|logout|log in|log out|sign in|sign up|sign out|register|search|next|previous|back|top|share|print|"
    "about us|contact us|site map|sitemap|help|faq|read more|skip to content|subscribe|follow us"
)
BOILERPLATE = (
    "cookie policy|privacy policy|terms of use|terms of service|terms and conditions|all rights reserved|"
    "uses cookies|enable javascript|lorem ipsum|click here|subscribe to our newsletter|powered by"
)
NAVIGATION = rf"(?i)^\s*(?:{MENU})(?:\s*[|>»·•/-]\s*(?:{MENU}))*\s*$"


def line_fails(line: str, n: str, stock: str) -> str:
    """SQL condition: the line (a string of ``n`` words, more than none) fails a rule; ``stock`` tells whether its text holds a stock phrase at all."""
    bars = f"(length({line}) - length(translate({line}, '|»', '')))"
    return f"""(
        {line} RLIKE r'{NAVIGATION}'
        OR ({bars} >= 2 AND 3 * {bars} >= {n})
        OR ({stock} AND 4 * (length({line}) - length(regexp_replace({line}, r'(?i){BOILERPLATE}', ''))) >= length({line}))
        OR ({line} RLIKE r'[#*$%&!<>]' AND 2 * regexp_count({line}, r'[#*$%&!<>]+') > {n})
        OR ({n} >= 30 AND NOT {line} RLIKE r'[.!?:;,"…)\\]]')
    )"""


def clean_lines(documents: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, lost_words, kept, cleaned (the text without failing lines)."""
    # No word runs over a line end, so each line is split into its words once and the words of the text are those of its lines.
    holds = " OR ".join(f"contains(low, '{phrase}')" for phrase in BOILERPLATE.split("|"))
    spaced = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text",
        F.expr(f"transform(split(text, '\\n'), l -> named_struct('line', l, 'words', filter(split(l, r'{SPACE}'), w -> w != '')))").alias("split"),
        F.expr(f"exists(array(lower(text)), low -> {holds})").alias("stock"),
    )
    hashed = spaced.select(
        "doc_id", "text",
        F.expr("flatten(transform(split, x -> x.words))").alias("words"),
        F.expr("transform(filter(split, x -> size(x.words) > 0), x -> x.line)").alias("lines"),
        F.expr("flatten(transform(split, x -> transform(x.words, w -> xxhash64(w))))").alias("word_hash"),
        F.expr(f"""
            transform(split, x -> named_struct('line', x.line, 'n', size(x.words),
              'fails', size(x.words) > 0 AND {line_fails('x.line', 'size(x.words)', 'stock')}))""").alias("judged"),
    )
    windows = hashed.select(
        "*",
        F.expr("""
            IF(size(word_hash) < 3, array(),
               sort_array(transform(
                 zip_with(zip_with(slice(word_hash, 1, size(word_hash) - 2), slice(word_hash, 2, size(word_hash) - 2), (a, b) -> xxhash64(a, b)),
                          slice(word_hash, 3, size(word_hash) - 2), (ab, c) -> xxhash64(ab, c)),
                 (h, i) -> struct(h AS h, i AS i))))""").alias("sorted"),
    )
    # Windows with an equal neighbour in the sorted order are found twice or more; their places, in the order of the text.
    places = windows.select(
        "*",
        F.expr("""
            sort_array(transform(filter(
              zip_with(zip_with(sorted, concat(array(CAST(NULL AS struct<h: bigint, i: int>)), slice(sorted, 1, greatest(size(sorted) - 1, 0))),
                                (x, last) -> struct(x.i AS i, x.h AS h, coalesce(x.h = last.h, false) AS again)),
                       concat(slice(sorted, 2, size(sorted)), array(CAST(NULL AS struct<h: bigint, i: int>))),
                       (x, next) -> struct(x.i AS i, x.again OR coalesce(x.h = next.h, false) AS again)),
              x -> x.again AND x.i IS NOT NULL), x -> x.i))""").alias("places"),
    )
    counted = places.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # A window covers three words; the next one cuts off what it covers itself.
        F.expr("""
            CAST(IF(size(places) = 0, 0,
               aggregate(zip_with(slice(places, 2, size(places)), slice(places, 1, greatest(size(places) - 1, 0)), (b, a) -> least(3, b - a)),
                         3, (sum, x) -> sum + x)) AS bigint)""").alias("n_repeat_words"),
        F.expr("aggregate(filter(judged, x -> x.fails), 0L, (sum, x) -> sum + x.n)").alias("lost_words"),
        F.expr(r"array_join(transform(filter(judged, x -> NOT x.fails), x -> x.line), '\n')").alias("cleaned"),
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words"))
    )
