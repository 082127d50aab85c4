"""The stages of the corpus pipeline, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import compression_classifier as classifier
from cloakframe.session import materialise
from tests.llm.test_table_operators import VOCABULARY, brute_groups, brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF)))
    assert all(df.columns == COLUMNS for df in kept[1:-1])
    rows = [{r.doc_id: r for r in df.collect()} for df in kept[:-1]]
    # 5: documents labelled good stay, most of those labelled bad go.
    good, bad = ([d for d, q in quality.items() if q == v and d in rows[0]] for v in (1, 0))
    assert sum(d in rows[1] for d in good) >= 0.98 * len(good) and sum(d in rows[1] for d in bad) <= 0.2 * len(bad)
    assert all(rows[1][d] == rows[0][d] for d in rows[1])
    # 10
    want = {d: text for d, _n, _gone, text in brute_lines([(d, r.text) for d, r in rows[1].items()])}
    assert {d: r.text for d, r in rows[2].items()} == want
    # 6: one document of each group stays, as it was.
    groups = {d: c for d, _n, c in brute_groups([(d, r.text) for d, r in sorted(rows[2].items())], 5, 80)}
    assert sorted(rows[3]) == sorted(d for d, c in groups.items() if d == c) and all(rows[3][d] == rows[2][d] for d in rows[3])
    # 2: every row as it was, once, and within the budget.
    tokens = lambda r: max(1, -(-len(r.text or "") // 4))
    assert all(rows[4][d] == rows[3][d] for d in rows[4]) and kept[4].count() == len(rows[4])
    total = sum(map(tokens, rows[3].values()))
    assert 0.5 * total < sum(map(tokens, rows[4].values())) <= corpus_pipeline.MIX_SHARE * total
    # 7
    plain = Tokenizer.from_file(VOCABULARY)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in kept[-1].collect():
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(rows[4])
    for d, parts in by_doc.items():
        ids = np.array(plain.encode(rows[4][d].text or "", add_special_tokens=False).ids + [2], "<u4")
        assert sum(p.length for p in parts) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1]) and sum(p.length for p in parts) <= 1024


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert materialise(stage(spark, docs, SF)).count() == 0


def test_null_and_empty_texts_get_the_prior_and_stay(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    empty = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in COLUMNS[2:]])
    for share in (model.share, 0.1):
        known = replace(model, share=share)
        assert {r.score for r in classifier.score(empty, known).collect()} == {share}
        monkeypatch.setattr(classifier, "fit", lambda *_, known=known: known)
        assert sorted(r.doc_id for r in corpus_pipeline.quality(spark, empty, SF).collect()) == [-2, -1]
