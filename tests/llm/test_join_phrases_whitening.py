"""N-gram join, phrases and whitening against brute-force versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_documents import brute_near, corpus, frame

from tessera.llm import ngram_join, phrases, whitening


def family(seed, many=90):
    """Near copies in chains: each differs a little from the one before, so that the ends don't link; two families share a passage."""
    rng = random.Random(seed)
    rows, shared = [], [f"p{i}" for i in range(60)]
    for group in range(3):
        own = shared + [f"g{group}w{i}" for i in range(40)]
        for i in range(many // 3):
            own = list(own)
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows.append((5000 + 1000 * group + i, " ".join(own), f"s{i % 3}"))
    return rows


@pytest.mark.parametrize(("rows", "width", "percent", "leaf"), [(corpus(4), 5, 80, 2), (family(6), 2, 70, 4), (corpus(7) + family(8), 3, 85, 5)])
def test_ngram_join(spark, monkeypatch, rows, width, percent, leaf):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)  # small: every list has a tree of several levels
    got = ngram_join.similar(frame(spark, rows), width, percent).collect()
    want = brute_near(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]][:2]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar(frame(spark, [])).collect() == []
    got = ngram_join.similar(frame(spark, [(1, None, None), (2, "", "a"), (3, "one", "a"), (4, "ONE", "b"), (None, "one", None)])).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"]) == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 1, 3, 0), (4, 1, 3, 0)]


@pytest.mark.parametrize(("children", "ranges", "boxes"), [(40, 64, range(20, 21)), (600, 8, range(300, 309))])
def test_trees_shrink_however_finely_spark_deals(spark, monkeypatch, children, ranges, boxes):
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    box = bytearray(ngram_join.packed(np.ones(16, np.int32)))
    rows = [(0, 7, i, 10, 12, i, True, 10, box, children) for i in range(children)]
    settings = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        nodes = ngram_join._packed(spark.createDataFrame(rows, ngram_join._CHILD + ", length long"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert nodes.count() in boxes
    assert sorted(i for r in nodes.select("ids").collect() for i in r[0]) == list(range(children))


@pytest.mark.parametrize(("leaf", "earlier"), [(2, 64), (64, 64), (2, 1)])
def test_points_of_several_trees_meet_in_the_first_that_holds_both(spark, monkeypatch, leaf, earlier):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "EARLIER", earlier, raising=False)
    trees = {31: [1, 2, 3, 4], 12: [1, 2, 3, 5], 23: [1, 2, 3, 4, 5, 6]}  # in this order, which is not that of the names
    rows = [(kind, v, rep, 16, place, 20, rep, len(own)) for kind in (0, 3) for place, (v, own) in enumerate(trees.items()) for rep in own]
    lists = spark.createDataFrame(rows, "kind int, v long, rep long, n long, place int, most long, c long, length long")
    box = bytearray(ngram_join.packed(np.ones(16, np.int32)))
    points = spark.createDataFrame([(i, box) for i in range(1, 7)], "rep long, point binary")
    got = sorted(tuple(sorted(r)) for r in ngram_join._crossed(lists, points, 80, True).collect())
    pairs = [(i, j) for i in range(1, 7) for j in range(i + 1, 7)]
    assert sorted(set(got)) == pairs
    if earlier > 1:
        assert got == sorted(2 * pairs)  # once a kind


def test_trees_of_one_leaf_write_no_boxes(spark, monkeypatch):
    """Points of short trees are crossed where they meet; only longer trees are packed."""
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    packed, plain = [], ngram_join._packed
    monkeypatch.setattr(ngram_join, "_packed", lambda made: packed.append(sorted({r[0] for r in made.select("v").collect()})) or plain(made))
    trees = {5: [1, 2, 3], 6: [4, 5, 6, 7], 8: [1, 4, 8, 9, 10]}
    rows = [(0, v, rep, 16, place, 20, rep // 2, len(own)) for place, (v, own) in enumerate(trees.items()) for rep in own]
    columns = "kind int, v long, rep long, n long, place int, most long, c long, length long"
    box = bytearray(ngram_join.packed(np.ones(16, np.int32)))
    points = spark.createDataFrame([(i, box) for i in range(1, 11)], "rep long, point binary")
    wanted = {v: [(i, j) for i in own for j in own if i < j and i // 2 != j // 2] for v, own in trees.items()}
    crossed = lambda r: sorted(tuple(sorted(x)) for x in ngram_join._crossed(spark.createDataFrame(r, columns), points, 80, True).collect())
    assert crossed([r for r in rows if r[1] != 8]) == sorted(wanted[5] + wanted[6]) and not packed
    assert crossed(rows) == sorted(sum(wanted.values(), [])) and packed and all(vs == [8] for vs in packed[:1])


def test_lengths_are_those_of_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5, 90), sorted(rng.sample(range(-40, 40), rng.randrange(6)))) for _ in range(200)] + [(7, []), (9, [2**63 - 1, -(2**63)]), (4, [2**63 - 1])]
    want = {}
    for n, prefix in rows:
        for place, v in enumerate(prefix):
            low, high, length = want.get(v, (n, -1, 0))
            want[v] = (min(low, n), max(high, (n - place) * 180 // 80 - n), length + 1)
    frame_ = spark.createDataFrame(rows, "n long, prefix array<long>").repartition(5)
    got = {r["v"]: (r["low"], r["high"], r["length"]) for r in ngram_join._lengths(frame_, 80).collect()}
    assert got == {v: w for v, w in want.items() if w[2] > 1}
    assert ngram_join._lengths(frame_.limit(0), 80).collect() == []


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 2000))) for _ in range(2))
        p, q = ngram_join.counts(a), ngram_join.counts(b)
        groups = min(len(p), len(q))
        assert p.sum() == len(a) and np.minimum(ngram_join.folded(p, groups), ngram_join.folded(q, groups)).sum() >= len(np.intersect1d(a, b))


def brute_phrases(rows, least, longest=4, scale=2_000_000, within=80, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = defaultdict(list)
    inside = defaultdict(int)
    for (lang, p), c in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], c)
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * inside[lang, p] < within * a:
            cut = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most]))


def talk(seed, many=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "ça", "naïve"]
    fixed = ["New York City hall", "new york city", "on the other hand", "à la carte"]
    rows = [(" ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", " "]) for _ in range(rng.randrange(25))), rng.choice(["en", "en", "fr", None])) for _ in range(many)]
    return rows + [(None, "en"), ("", "fr"), (" \t\n", None), ("one two " * 400, "xx"), ("x" * 50_000, "en"), ("new york city hall", "en"), ("new york city hall", "en")]


@pytest.mark.parametrize(("shards", "slots", "least", "most"), [(3, 1 << 12, 12, 2000), (1, 1 << 12, 5, 2000), (4, 4, 12, 2000), (2, 1 << 8, 6, 3)])
def test_phrases(spark, shards, slots, least, most):
    rows = talk(shards)
    docs = spark.createDataFrame([(i % 150, t, lang, 1, "y", 2, "z") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n long, words string, f int, rank string")
    got = phrases.collocations(docs, least=least, most=most, shards=shards, slots=slots)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, most=most)
    assert phrases.collocations(docs.limit(0), shards=2, slots=16).collect() == []


def test_phrases_of_words_with_one_hash(spark, monkeypatch):
    """Words that share a hash are told apart by counting anew with another seed."""
    plain = phrases._words

    def clumsy(texts, seed):
        hashes, second, *rest = plain(texts, seed)
        return (hashes if seed else hashes % np.uint64(4), second, *rest)

    monkeypatch.setattr(phrases, "_words", clumsy)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(phrases)
    try:
        rows = talk(9, 60)
        docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
        assert sorted(map(tuple, phrases.collocations(docs, least=5, shards=2, slots=64).collect())) == brute_phrases(rows, 5)
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def brute_whitening(vectors, most=16):
    x = np.floor(np.array(vectors) * 64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    covariance = centred.T @ centred / len(fit)
    values, parts = np.linalg.eigh(covariance)
    keep = [i for i in np.argsort(-values) if values[i] > 1e-9 * values.max()][:most]
    n, sums = len(fit), fit.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ parts[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(covariance)


@pytest.mark.parametrize(("rows", "dims", "rank"), [(60, 20, 20), (7, 12, 12), (40, 5, 3), (300, 33, 33)])
def test_whitening(spark, rows, dims, rank):
    rng = np.random.default_rng(dims)
    data = rng.normal(size=(rows, rank)) @ rng.normal(size=(rank, dims)) * 3
    data[:, rank:] = 0.5  # constant dimensions have no component
    data[1] = data[0]
    good = [(i if i % 5 else 3, [float(v) for v in row]) for i, row in enumerate(data)]
    bad = [(900, None), (901, [None] + [1.0] * (dims - 1)), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [1.0]), (905, [])]
    vectors = spark.createDataFrame([(*r, 1, "x", 0.5) for r in good + bad], "vec_id long, embedding array<double>, n long, x string, deviation double")
    got = whitening.whiten(vectors)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, whitened, explained = brute_whitening(data)
    out = defaultdict(list)
    for r in got.collect():
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        out[r["component"]].append((r["vec_id"], r["deviation"], abs(r["whitened"])))
    assert sorted(out) == list(range(1, len(explained) + 1))
    for c, have in out.items():
        want = sorted((i, d, abs(w)) for (i, _), d, w in zip(good, deviation, whitened[:, c - 1], strict=True))
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(sorted(have), want, strict=True))


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in got] == [(1, 2, 4096, 1.0)] * 3


def test_factor():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 9))
    a = a @ a.T
    factor = whitening.cholesky(a)
    assert factor.shape == (30, 9) and np.allclose(factor @ factor.T, a)
    values, parts = whitening.jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:9]) and np.allclose(parts.T @ parts, np.eye(9)) and np.allclose(a @ parts, parts * values)


SMALL = "/root/testdata/sf0.001"


def test_queries_against_brute_force(spark):
    """The three queries over small tables: columns, order of columns and rows as the plain versions have them."""
    from tessera.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = QUERIES["op11_ngram_join"](spark, SMALL)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    want = brute_near([(r["doc_id"], r["text"], None) for r in docs], 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == {i: w[:2] for i, w in want.items()}
    got = QUERIES["op12_phrases"](spark, SMALL)
    assert got.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r["text"], r["lang"]) for r in docs], 30)
    got = QUERIES["op13_whitening"](spark, SMALL)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    n, deviation, whitened, explained = brute_whitening([r["embedding"] for r in vectors])
    at = {r["vec_id"]: i for i, r in enumerate(vectors)}
    rows = got.collect()
    assert len(rows) == len(vectors) * len(explained)
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(abs(r["whitened"]) - abs(whitened[i, c])) < 1e-6 and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-4
