"""Hard negatives, importance resampling and token files, against brute force on small tables with hot groups and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm import hard_negatives as H
from cloakframe.llm import importance as I
from cloakframe.llm import packing, token_files
from cloakframe.llm.elias_fano import EliasFano
from cloakframe.llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a <|endoftext|> b", "a  <|endoftext|>  b   ", "   ", "b   ", " c", "\n\n x \n", "<|endoftext|><|startoftext|><|endoftext|>", "<|ENDOFTEXT|> Don't I'LL it's",
    "É́ é é İ İ̸ ß", "日本 テ ａｂ　x y z", "\x00\x01a\x7f", "a\x0bb\x0cc\r\nd", "Σας ΣΑΣ ς.Σ", "̸ ̀x a̸ |̸",
    "a'b 's'S don'T", "12a3 4", "x\n\n\ny\n z", "", None, "word " * 5000, "x" * 3000,
]
CLASH = "row string, rank string, score string, n_ids string, page string, buckets string"


def odd_texts() -> list:
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "É", " ", "\n", "'", "s", "<|endoftext|>", "<|startoftext|>", "<", "|", ">", ".", "1", "́", "̸", " ", "\t", "終", "I", "̇", "\r", "Σ"]
    return [*ODD, *("".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(1500))]


@pytest.mark.parametrize(("path", "spaceless"), [(BYTES, False), (WORDS, True), (WORDS, False)])
def test_ids_are_those_of_the_tokenizer(path, spaceless):
    plain, fast, texts = Tokenizer.from_file(path), Encoder(path, 2, spaceless=spaceless), odd_texts()
    for at in range(0, len(texts), 97):
        ids, offsets = fast.encode(texts[at : at + 97])
        for i, text in enumerate(texts[at : at + 97]):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], text
    plain.encode_special_tokens = True
    ids, _ = Encoder(path, 2, marks=False, spaceless=spaceless).encode(["a <|endoftext|> b"])
    assert ids.tolist() == [*plain.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]


def test_parts_are_forgotten_and_learnt_again(monkeypatch):
    from cloakframe.llm import tokens

    monkeypatch.setattr(tokens, "MOST_PARTS", 3)
    fast, plain = Encoder(BYTES, 2), Tokenizer.from_file(BYTES)
    for text in ("one two three four five", "six <|endoftext|> seven", "one six"):
        assert fast.encode([text])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_parts_met_again_outlive_the_others(monkeypatch):
    from cloakframe.llm import tokens

    monkeypatch.setattr(tokens, "MOST_PARTS", 40)
    fast, plain = Encoder(BYTES, 2), Tokenizer.from_file(BYTES)
    rare = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(400)]
    for at in range(0, len(rare), 8):
        text = "the same few words <|endoftext|> " + " ".join(rare[at : at + 8])
        assert fast.encode([text])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert len(fast.known) <= 40 + 13 and (at == 0 or b" same" in fast.known)
    learnt = []
    monkeypatch.setattr(fast, "learn", lambda parts: learnt.extend(parts) or Encoder.learn(fast, parts))
    for at in range(0, 80, 8):
        fast.encode(["the same few words " + " ".join(rare[at : at + 8])])
    assert learnt and not {b"the", b" same", b" few"} & set(learnt)


# ---- Elias-Fano and token files


@pytest.mark.parametrize("values", [[], [5], [0, 0, 0], [-(2**63), 2**63 - 1], list(range(1000)), [7] * 300 + [10**15] * 70, sorted(random.Random(1).randrange(-(10**12), 10**12) for _ in range(700))])
def test_elias_fano_round_trip_and_select(values):
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert code.values().tolist() == values and [code[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        code[len(values)]


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 800, 5000))
    assert 8 * len(EliasFano.of(ends).to_bytes()) / len(ends) < 2 + math.log2(400) + 1.5  # two bits, the low bits, samples


def by_order(rows, plain, kind="<u4"):
    """What reading must return, from the tokenizer alone."""
    out = []
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], kind)
        out.append((doc_id is not None, doc_id or 0, len(ids), zlib.crc32(ids.tobytes()), doc_id, ids.astype("<u4")))
    out.sort(key=lambda x: x[:4])
    at, found = 0, []
    for *_, doc_id, ids in out:
        found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return found


@pytest.mark.parametrize(("path", "spaceless"), [(WORDS, True), (BYTES, False)])
def test_token_files_read_back(spark, monkeypatch, tmp_path, path, spaceless):
    monkeypatch.setattr(token_files, "id_type", lambda *_: "<u2")
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**14), 10**14), rng.choice(odd_texts()[:120])) for _ in range(200)]
    rows += [(None, "without id"), (None, None), (7, "twice"), (7, "twice"), (7, "other"), *[(50, "hot row")] * 90]
    docs = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], f"doc_id long, text string, {CLASH}")
    folder = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(docs, folder, path, 2, spaceless, page_ids=300)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = by_order(rows, Tokenizer.from_file(path), "<u2")
    got = sorted((tuple(r) for r in token_files.read(spark, folder, keep_ids=True).collect()), key=lambda r: r[1])
    assert [(*r[:4], list(r[4])) for r in got] == want
    pages = token_files.pages(spark, folder).orderBy("shard", "page").collect()
    assert len(pages) > 8 and len({p.shard for p in pages}) > 1  # some documents are longer than a page
    opened = [(page.doc_id(i), page.document(i).tolist()) for p in pages for page in [token_files.Page.of(p)] for i in range(p.n_docs)]
    assert opened == [(w[0], w[4]) for w in want]
    token_files.write(docs.limit(0), folder, path, 2, spaceless)  # replaces what was there
    assert token_files.read(spark, folder).count() == 0


def test_query_of_token_files(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, entry.queries()["op13_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in by_order(docs, Tokenizer.from_file(WORDS))]


def test_equal_pieces_are_packed_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 500)
    docs = spark.createDataFrame([(None, "the same text")] * 2000, "doc_id long, text string")
    # The first round deals by row, so its bins (their number holds the group) come from all groups alike.
    packed = packing.pack(packing.pieces(docs, BYTES), 64)
    groups = Counter((r.sequence_id >> 24) & 0xFFFFFFFF for r in packed.where("sequence_id >> 56 = 0").collect())
    assert len(groups) == 4 and max(groups.values()) < 700 and packed.count() == 2000


# ---- importance resampling


def brute_scores(documents, target, percent, runs, buckets, least_words, seed):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    marks = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _id, text in documents:
        s.update(marks(words(text)))
    for text in target:
        t.update(marks(words(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in documents:
        own = marks(words(text))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([doc_id, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[0] is not None and r[1] >= least_words), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("percent", "runs", "least"), [(10, 1, 3), (35, 3, 0), (100, 1, 2), (0, 1, 0)])
def test_resampling_equals_brute_force(spark, percent, runs, least):
    rng = random.Random(percent)
    vocabulary = ["Alpha", "beta", "GAMMA", "dé", "日本", "x1", "終", "a-b", "don't", "ÉCOLE"]
    text = lambda: rng.choice([" ", "\n", "; "]).join(rng.choices(vocabulary, k=rng.randint(0, 12)))
    docs = [(i, text()) for i in range(300)] + [(None, "alpha beta gamma"), (400, None), (401, ""), (402, "!!"), (403, "alpha " * 4000), *[(500, "Alpha beta x1")] * 150]
    target = ["alpha beta", "日本 x1 x1", None, "", "alpha"]
    documents = spark.createDataFrame([(*d, *["clash"] * 6) for d in docs], f"doc_id long, text string, {CLASH}")
    wanted = spark.createDataFrame([(t, "clash") for t in target], "text string, doc_id string")
    got = I.resample(documents, wanted, percent, runs, 50, least, 9)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute_scores(docs, target, percent, runs, 50, least, 9)
    strip = lambda rows: sorted(((*r[:5], r[5] if r[0] != 500 else None) for r in rows), key=repr)
    rows = list(map(tuple, got.collect()))
    assert strip(rows) == strip(want)  # equal rows are numbered in any order
    assert sorted(r[5] for r in rows if r[5]) == sorted(r[5] for r in want if r[5])


def test_resampling_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert I.resample(none, one, 50).count() == 0
    assert [tuple(r)[-1] for r in I.resample(one, none, 100, least_words=0).collect()] == [1]


@pytest.mark.parametrize("accuracy", [2, 10, 10_000])
@pytest.mark.parametrize("k", [1, 37, 500, 999, 1000])
def test_bracket_holds_the_cutoff(spark, accuracy, k):
    """A sketch too coarse for the cutoff is found out by the exact counts, and the bracket widened."""
    scores = [(random.Random(i).choice([i, 5, -7, 10**6]),) for i in range(1000)]
    low, high, above = I.bracket(spark.createDataFrame(scores, "score long"), 1000, k, accuracy)
    cutoff = sorted((s for (s,) in scores), reverse=True)[k - 1]
    assert low <= cutoff <= high and above == sum(s > high for (s,) in scores) <= k


# ---- hard negatives


def brute_negatives(rows, every, positives, negatives, low, high):
    sound = [r for r in rows if None not in r[:2] and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    sizes = Counter(len(r[2]) for r in sound)
    size = min((n for n in sizes if sizes[n] == max(sizes.values())), default=0)
    one = {}
    for r in sorted((r for r in sound if len(r[2]) == size), key=lambda r: (r[1], r[2])):
        one.setdefault(r[0], r)
    out = []
    for a, label, vector in one.values():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, lab == label) for i, lab, v in one.values() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, rank, i, float(-s), float(-t)) for rank, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(kind: str, n: int) -> list:
    rng = random.Random(kind)
    middle = [[rng.randint(-60, 60) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        base = rng.choice(middle) if kind == "clustered" else [0] * 6
        spread = 4 if kind == "clustered" else 60
        rows.append((i, rng.randint(0, 3), [float(b + rng.randint(-spread, spread)) for b in base]))
    return rows


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "VALUES", 6 * 50)
    monkeypatch.setattr(H, "STEP", 16)
    monkeypatch.setattr(H, "MEMBERS", 5)
    monkeypatch.setattr(H, "AT_ONCE", 3)
    rows = vectors(kind, 500)
    hot = rows[0][2]
    rows += [(1000 + i, i % 4, hot) for i in range(250)]  # a third of all rows
    rows += [(2000, 1, None), (2001, None, hot), (2002, 1, [float("nan")] * 6), (2003, 1, [None] * 6), (2004, 1, [1.0]), (2005, 1, []), (None, 1, hot),
             (2010, 2, [0.0] * 6), (2020, 1, [-x for x in hot]), (30, 3, [1.0] * 6), (30, 0, [2.0] * 6), (2006, 1, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, label int, vector array<double>, score string, norm string")
    got = H.hard_negatives(df, F.col("id") % 10 == 0, 5, 10, 30, 90, clusters=4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 5, 10, 30, 90)


def test_walks_end_with_a_certificate(spark, monkeypatch):
    """On clustered anchors most of a list is never sent, and nothing is missed."""
    monkeypatch.setattr(H, "VALUES", 6 * 10)
    sent, real = [], H.listed
    monkeypatch.setattr(H, "listed", lambda rows, lists, parts, first, end: sent.append((parts, first, end, lists)) or real(rows, lists, parts, first, end))
    rng = random.Random(3)
    near = [[100 * (j == c) + rng.randint(0, 3) for j in range(6)] for c in range(6) for _ in range(100)]
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    got = H.hard_negatives(df, F.col("id") % 10 == 0, 2, 3, 30, 100, clusters=6)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 2, 3, 30, 100)
    walked = sum(n for parts, first, end, lists in sent for c in parts for n in lists.blocks[c][first:end])
    assert walked < 0.5 * 2 * sum(map(sum, sent[0][3].blocks))


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "id long, label int, vector array<float>")
    assert H.hard_negatives(df, F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "id long, label int, vector array<double>")
    assert H.hard_negatives(alone, F.col("id") % 10 == 0).count() == 0
