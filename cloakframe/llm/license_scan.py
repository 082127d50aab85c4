"""Sentence-rule licence recognition, by column expressions only.

A text is normalised (lower case, letters and digits only) and cut at punctuation, blank lines and line ends.  A line end, a colon or
a semicolon may also lie inside a sentence, so notices that are wrapped, with or without comment leaders, are found like those on one
line.  The sentences found in ``SENTENCES`` become a sequence of identifiers.  ``RULES`` are ordered: each names a licence and the identifiers that must
follow each other; a longer rule comes before the ones it contains, and what it has matched is taken out of the
sequence.  Sentences that are unknown do not interrupt a rule unless more than ``max_gap`` of them (up to punctuation or a blank
line) lie between.

Defined cases: a null or empty text has no sentences and no licence; a text of any length is read whole; a notice that
occurs twice is reported twice in ``licenses``, in order of occurrence; rows that repeat an id are scanned each on
their own; other columns are ignored; an empty table gives no rows.  The two tables are fixed in size, so they are part of
the expression: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence wording, normalised.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-short": (
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0", "licensed under apache 2 0",
        "this work is licensed under the apache license version 2 0",
        "this file is licensed under the apache license version 2 0"),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": (
        "you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache-asis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied",),
    "apache-see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit-short": (
        "released under the mit license", "licensed under the mit license", "this work is licensed under the mit license",
        "this project is licensed under the mit license", "distributed under the mit license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions",),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
        "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-name": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",),
    "gpl3-short": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3", "licensed under the gnu gpl version 3"),
    "gpl2-short": (
        "this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2"),
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose",),
    "gpl-see": ("see the gnu general public license for more details",),
    "lgpl-short": ("licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"),
    "agpl-short": ("licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-zero": ("licensed under cc0 1 0", "this work is released into the public domain under cc0 1 0"),
    "reserved": ("all rights reserved",),
}
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0 notice", ("apache-short", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("MIT text", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("GPL-3.0 notice", ("gpl-free", "gpl-hope", "gpl-see")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-2.0", ("gpl2-short",)),
    ("LGPL-3.0", ("lgpl-short",)),
    ("AGPL-3.0", ("agpl-short",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC0-1.0", ("cc-zero",)),
    ("reserved", ("reserved",)),
)
#: Every wording holds one of these words, whole or as the start of a word.
GATE = ("licen[sc]e", "permission", "redistribution", "copyright", "reserved", "warranty", "cc0")
ENDS = r'[.!?:;]+(?:[\s")]+|\z)|\n+'


def rewritten(sequence: str, replace: str = "replace") -> str:
    """SQL text: the sequence of ``<id>`` with each rule's match put as ``[rule number]``, rules in order."""
    for k, (_, ids) in enumerate(RULES):
        sequence = f"{replace}({sequence}, '{''.join(f'<{i}>' for i in ids)}', '[{k}]')"
    return sequence


def known(sentence: str) -> str:
    """SQL text: the identifier of a normalised sentence, or null."""
    cases = " ".join(
        f"WHEN {sentence} IN ({', '.join(repr(w) for w in wordings)}) THEN '{i}'" for i, wordings in SENTENCES.items())
    return f"CASE {cases} END"


# A text in lower case gets H where a sentence ends and S where one may end.  Each pattern is linear in the text.
CUTS = (
    (r"\r\n", "\n"),
    (r"(?m)^[^a-z0-9\n]*(?:dnl|rem)\b", " "),  # comment leaders made of letters; the others are no letters
    (r"\n[^a-z0-9]*\n", "H"),
    (r'(?<![.!?:;])[:;]++(?=[\s")]|\z)', "S"),
    (r'(?<![.!?:;])[.!?:;]++(?=[\s")H]|\z)', "H"),
    (r"\n", "S"),
    (r"[^a-z0-9HS]+", " "),
    (r" ?S[S ]*+", "S"),
    (r"[ S]?H[HS ]*+", "H"),
)
#: A known wording from one cut to another, the longest first.
WORDING = "(?<=[HS])(?:{})(?=[HS])".format(
    "|".join(w.replace(" ", "[ S]") for w in sorted((w for ws in SENTENCES.values() for w in ws), key=lambda w: (-len(w), w))))


def cut_text(text: Column) -> Column:
    """The normalised text with its cuts, from H to H."""
    text = F.lower(text)
    for pattern, mark in CUTS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mark))
    return F.regexp_replace(F.concat(F.lit("H"), text, F.lit("H")), F.lit("[ S]?H[HS ]*+"), F.lit("H"))


def scan_licenses(documents: DataFrame, max_gap: int = 5) -> DataFrame:
    """One row per document: doc_id, sentence_ids, licenses (in order of occurrence), n_unmatched (identifiers in no rule)."""
    cut = documents.select(
        "doc_id",
        # Most texts hold none of these words: they are passed over without being cut.
        F.when(F.coalesce("text", F.lit("")).rlike(f"(?i){'|'.join(GATE)}"),
               cut_text(F.col("text"))).otherwise("").alias("cut"),
    )
    found = cut.select(
        "doc_id", F.regexp_extract_all("cut", F.lit(WORDING), F.lit(0)).alias("wordings"),
        F.transform(F.split("cut", WORDING), lambda gap: F.regexp_count(gap, F.lit("[^HS][^H]*"))).alias("gaps"),  # unknown sentences before each
    ).select("doc_id", F.expr(f"transform(wordings, w -> {known("replace(w, 'S', ' ')")})").alias("sentence_ids"), "gaps")
    sequence = found.select(
        "doc_id", "sentence_ids",
        F.expr(f"array_join(transform(sentence_ids, (id, i) -> IF(i > 0 AND gaps[i] > {max_gap}, concat('~<', id, '>'), concat('<', id, '>'))), '')").alias("sequence"),
    )
    matched = sequence.select("doc_id", "sentence_ids", F.expr(rewritten("sequence")).alias("rest"))
    names = F.array(*[F.lit(name) for name, _ in RULES])
    return matched.select(
        "doc_id", "sentence_ids",
        F.transform(F.regexp_extract_all("rest", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda k: F.get(names, k.cast("int"))).alias("licenses"),
        F.regexp_count("rest", F.lit("<")).cast("long").alias("n_unmatched"),
    )
