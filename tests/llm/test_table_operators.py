"""Operators that move rows between documents, against brute force on small tables with hot groups and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm import compression_classifier as classifier
from cloakframe.llm import line_dedup
from cloakframe.llm.components import components
from cloakframe.llm.cuckoo import CuckooFilter
from cloakframe.llm.mixing import mix
from cloakframe.llm.near_dedup import near_duplicates
from cloakframe.llm.neighbours import hilbert, nearest
from cloakframe.llm.packing import pack, pieces, sequences, sum_of_squares
from cloakframe.llm.set_sketch import merged, registers, similarity
from cloakframe.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, drops string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), None, "clash", "clash") for r in rows], DOCS)


# ---- line dedup


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [doc_id is not None and len(held[key(x)]) >= min_docs and doc_id != max(held[key(x)]) for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    common = [f"A line that {i} many documents share" for i in range(6)]
    rows = [(i, "\n".join(rng.choice([*common, f"own line of document {i} {j}", "short", "", "\x0b pAdded line that is quite Long \r"]) for j in range(rng.randint(1, 9)))) for i in range(80)]
    return [*rows, (3, common[0]), (7, None), (90, ""), (91, "\n\n"), (None, common[1]), (95, "É" * 25), (96, "é" * 25), (97, "É" * 25), (98, "É" * 25), (99, (common[2] + "\n") * 3000)]


def test_line_dedup(spark):
    rows = line_rows()
    out = line_dedup.drop_repeated_lines(documents(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")), "score").collect()
    assert sorted([tuple(r)[:4] for r in out], key=repr) == brute_lines(rows) and all(r.score == "clash" for r in out)
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


def test_line_index_is_reversible(spark):
    rows = [(i, t) for i, t in line_rows() if i is not None]
    docs = documents(spark, rows)
    first, second = docs.where("doc_id < 60"), docs.where("doc_id >= 60")
    refs = line_dedup.line_references(first)
    both = refs.unionAll(line_dedup.line_references(second))
    back = line_dedup.without_documents(both, second.select("doc_id"))
    table = lambda df: sorted(map(tuple, df.collect()))
    frequent = lambda df: line_dedup.reference_counts(df).where("n_docs >= 3")
    assert table(line_dedup.reference_counts(back)) == table(line_dedup.reference_counts(refs))
    shards = 4
    filters = line_dedup.shard_filters(frequent(refs), shards)
    more = frequent(both).join(frequent(refs), ["hi", "lo"], "left_anti")
    grown = line_dedup.updated_filters(filters, more, more.limit(0), shards)
    shrunk = line_dedup.updated_filters(grown, more.limit(0), more, shards)
    passes = lambda f: {tuple(r) for r in line_dedup.passing(both, f, shards, 2).select("hi", "lo").collect()}
    keys = lambda df: {tuple(r) for r in df.select("hi", "lo").collect()}
    assert keys(frequent(both)) <= passes(grown) and passes(shrunk) == passes(filters) and keys(frequent(refs)) <= passes(filters)
    assert keys(more) and not keys(more) & passes(shrunk)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(-(2**63), 2**63, 20_000) for _ in range(2))
    made = CuckooFilter.of(high[:10_000], low[:10_000])
    assert made.contains(high[:10_000], low[:10_000]).all() and made.contains(high[10_000:], low[10_000:]).mean() < 0.002
    made.delete(high[:5_000], low[:5_000])
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(high[5_000:10_000], low[5_000:10_000]).all() and again.contains(high[:5_000], low[:5_000]).mean() < 0.002
    assert not CuckooFilter.of(high[:0], low[:0]).contains(high[:5], low[:5]).any()


# ---- mixing


def brute_fill(given, children):
    """Water filling: children (name, cap, weight), repeatedly giving what the full ones leave to the others."""
    got, open_ = {n: 0.0 for n, _, _ in children}, [c for c in children if c[2] > 0]
    left = given
    while open_ and left > 1e-9:
        unit = left / sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] - got[c[0]] <= unit * c[2] + 1e-9]
        for name, cap, w in full or open_:
            more = cap - got[name] if full else unit * w
            got[name] += more
            left -= more
        open_ = [c for c in open_ if c not in full] if full else []
    return got


def test_mix_budgets_and_prefixes(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["en", "en", "en", "de", None]), "hot" if i % 3 == 0 else f"s{rng.randint(0, 3)}") for i in range(900)]
    rows += [(5, "x" * 90, "en", "hot")] * 2 + [(None, "y" * 50, "de", "s1"), (2000, None, "en", "s1")]
    weights = {"lang": {"en": 1, "de": 6}, "source": {"hot": 5, "s3": 0}}
    docs = documents(spark, rows)
    out = mix(docs, ["lang", "source"], weights, 0.7, seed=3, max_epochs=2).collect()
    tokens = lambda t: max(1, -(-len(t or "") // 4))
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        leaves[lang or "", source].append((doc_id, tokens(text)))
    total = {k: sum(t for _, t in v) for k, v in leaves.items()}
    usable = {k: 0 if k[1] == "s3" else 2 * v for k, v in total.items()}
    langs = sorted({k[0] for k in leaves})
    top = brute_fill(min(int(sum(total.values()) * 0.7), sum(usable.values())), [(x, sum(v for k, v in usable.items() if k[0] == x), weights["lang"].get(x, 1)) for x in langs])
    got = defaultdict(lambda: defaultdict(int))
    for r in out:
        got[r.lang or "", r.source][r.epoch] += r.tokens
    for lang in langs:
        budgets = brute_fill(top[lang], [(k, usable[k], weights["source"].get(k[1], 1)) for k in leaves if k[0] == lang])
        for k, budget in budgets.items():
            spent = sum(got[k].values())
            # Whole epochs, then the longest prefix that fits: what is left is less than the next place needs.
            assert spent <= budget + 1 and (spent > budget - 420 or not total[k]), (k, spent, budget)
            whole = int((budget + 1e-6) // total[k])
            assert all(abs(got[k][e] - total[k]) < 1e-9 for e in range(whole))
            order = sorted((hashlib.md5(f"3|{whole}|{'' if d is None else d}".encode()).hexdigest(), t) for d, t in leaves[k])
            chosen = sorted(hashlib.md5(f"3|{whole}|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest() for r in out if (r.lang or "", r.source) == k and r.epoch == whole)
            assert chosen == [h for h, _ in order[: len(chosen)]]
    assert all(r.score == "clash" for r in out) and not any(r.source == "s3" for r in out)
    assert mix(documents(spark, []), ["lang", "source"], weights, 0.7).count() == 0


# ---- classifier


def test_classifier_held_out_and_edges(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice(["ta", "ri", "mo", "ne", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))) + "."
    bad = lambda: " ".join(w + rng.choice(["***", "&&&"]) for w in good().split())
    rows = [(i, bad() if i % 4 == 1 else good()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(600)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + [(700, None), (701, ""), (None, good()), (4, good()), (702, good() * 400)])
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).select("doc_id", "score", classifier.held_out().alias("out")).collect()
    assert len(out) == 605 and all(0 <= r.score <= 1 for r in out)
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.out and r.doc_id < 600]
    assert len(held) > 100 and all((r.score >= 0.7) == (r.doc_id % 4 != 1) for r in held)
    again = classifier.fit(docs.repartition(7), labels.repartition(3))
    assert again == model
    constant = classifier.fit(docs, labels.where("quality = 1"))
    assert constant.weights is None and {r.score for r in classifier.score(docs, constant).collect()} == {1.0}
    assert classifier.score(docs, classifier.fit(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5
    assert classifier.score(documents(spark, []), model).count() == 0


# ---- tokens and packing

ODD = ["", None, "a  b", "a\n\nb", "a \n b", "x's don't I'LL", " a  b c　 d", "  lead", "trail  ", "\t tab\n", "é.è,\x1c y", "<|endoftext|> x",
       "a\r\nb", "12 34a5.6", "q\n é", "a\nb\n", "x. \n\ny", "😀 😀!", "don't’s", "\u0085 x", "a" * 3000, "w " * 3000]


def test_encoder_equals_the_tokenizer():
    plain = Tokenizer.from_file(VOCABULARY)
    ids, offsets = Encoder(VOCABULARY, 2).encode(ODD)
    for text, start, end in zip(ODD, offsets, offsets[1:]):
        assert ids[start:end].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], text


def best_fit_falling(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - n)
    return len(gaps)


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    texts = ODD + ["the cat sat " * rng.randint(1, 700) for _ in range(150)] + ["the cat sat " * 300] * 80
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again")])
    packed = pack(pieces(docs, VOCABULARY, keep_ids=True))
    rows = packed.collect()
    plain = Tokenizer.from_file(VOCABULARY)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
    for i, text in enumerate(texts):
        if i != 3:
            parts = sorted(by_doc[i], key=lambda r: r.piece)
            want = plain.encode(text or "", add_special_tokens=False).ids + [2]
            assert [x for p in parts for x in p.ids] == want
            assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1])
            assert len(parts) == -(-len(want) // 1024) and all(p.length == 1024 for p in parts[1:])
    assert len(by_doc[None]) == 1 and len(by_doc[3]) == 2
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1]) and sum(p.length for p in parts) <= 1024
    assert len(by_bin) <= 1.02 * best_fit_falling([r.length for r in rows], 1024) + 1
    assert {r.sequence_id: len(r.ids) for r in sequences(packed).collect()} == {k: sum(p.length for p in v) for k, v in by_bin.items()}
    assert pack(pieces(documents(spark, []), VOCABULARY)).count() == 0


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(6)
    lengths, capacity = rng.integers(1, 40, 400), 40
    bins, offsets = sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def squares(state):
        n = defaultdict(int)
        for g in state.values():
            n[g] += 1 if 0 < g < capacity else 0
        return sum(v * v for v in n.values())

    for n, place, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        choices = [squares({**gaps, b: g - n}) for b, g in gaps.items() if g >= n] + [squares({**gaps, -1: capacity - n})]
        assert offset == capacity - gaps.get(place, capacity)
        gaps[place] = gaps.get(place, capacity) - n
        assert gaps[place] >= 0 and squares(gaps) == min(choices)


# ---- near duplicates


def brute_groups(rows, width, percent):
    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\x09\x0a\x0b\x0c\x0d" else c for c in t or "").split(" ") if w]
    sets = []
    for doc_id, text in rows:
        w = split(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=repr)


def near_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(100 + i, " ".join(base)) for i in range(40)]  # a hot group of copies
    for i in range(60):  # and of near copies: each changed in a few places, some too far from each other
        changed = list(base)
        for _ in range(rng.randint(1, 4)):
            changed[rng.randrange(120)] = word()
        rows.append((200 + i, " ".join(changed)))
    chain = [word() for _ in range(100)]  # a chain whose ends are unlike
    for i in range(8):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((300 + i, "  ".join(chain)))
    rows += [(400 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two  WORDS"), (6, "words two"), (7, "one"), (8, "É a b c d"), (9, "é a b c d"), (10, " ".join(base).upper())]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows = near_rows()
    out = near_duplicates(documents(spark, rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute_groups(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d"), (5, "w x y z"), (6, "w x y z"), (7, "a b c d"), (None, "a b c d"), (None, None), (8, "q r s t")]
    out = sorted((tuple(r) for r in near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert out == sorted([(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (None, 2, None, True), (None, 0, None, True), (8, 2, 8, True)], key=repr)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_set_sketch_estimates_and_merges():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (0, 500, 900):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        found = registers(np.concatenate([a, b]), np.array([1000, 0, 1000]), 400)
        truth = shared / (2000 - shared)
        assert abs(similarity(found[:1], found[1:], np.array([1000.0]), np.array([1000.0]))[0] - truth) < 0.1
        assert (merged(found[0], found[1]) == registers(np.unique(np.concatenate([a, b])), np.array([2000 - shared]), 400)[0]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(500, 500 + i) for i in range(60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest neighbours


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def test_nearest_with_hot_vector_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(600)}
    for i in range(200, 400):
        vectors[i] = vectors[200]
    rows = [*vectors.items(), (5, vectors[5]), (601, None), (602, [0.0] * 8), (603, [float("nan")] + [1.0] * 7), (604, [float("inf")] * 8), (605, [1.0] * 7),
            (None, [1.0] * 8), (606, [None] + [1.0] * 7), (700, [1.0] * 8), (-5, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<float>, score string")
    out = nearest(df, F.col("id") % 20 == 0, curves=24, window=64, per_pass=12).collect()
    live = {**vectors, 700: [1.0] * 8}
    ids = np.array(sorted(live))
    space = np.array([live[i] for i in ids.tolist()], np.float64)
    got, hits = defaultdict(list), 0
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        far = np.sqrt(((space - np.array(live[q], np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        assert all(abs(score - far[np.searchsorted(ids, v)]) < 1e-12 for v, score in got[q])
        hits += len({v for v, _ in got[q]} & set(ids[order].tolist()))
        if 200 <= q < 400:
            assert got[q] == [(int(ids[i]), 0.0) for i in order]
    assert hits >= 0.95 * 10 * len(queries)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "id long, vector array<float>")
    assert [tuple(r) for r in nearest(few, F.col("id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(few.limit(0), F.col("id") == 0).count() == 0


def unit_vectors(n, dim=64):
    points = np.random.default_rng(5).normal(size=(n, dim))
    return (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32)


def test_nearest_adds_passes_until_recall_is_reached(spark):
    points = unit_vectors(3000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "id long, vector array<float>")
    gap = points[::30].astype(np.float64)[:, None] - points.astype(np.float64)
    far = np.sqrt((gap * gap).sum(axis=2))
    true = {30 * i: [j for j in np.lexsort((np.arange(3000), row)).tolist() if j != 30 * i][:10] for i, row in enumerate(far)}

    def found(**given):
        got = defaultdict(list)
        for r in sorted(nearest(df, F.col("id") % 30 == 0, **given).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append(r.vec_id)
        return got

    got = found(curves=8, window=16, per_pass=8)
    assert sum(len({*got[q]} & {*true[q]}) for q in true) >= 0.9 * 10 * len(true)
    # Recall that no number of curves is sure to reach: every query is searched exactly.
    assert found(curves=1, window=1, per_pass=1, recall=1.01) == true
