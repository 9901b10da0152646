"""Every query of this subpackage over small tables: columns, folds, and what the contract fixes."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_documents import brute_near, brute_repeated_words, brute_repeats, brute_targets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "labels", "embeddings", "conversations")}


@pytest.fixture(scope="module")
def results(spark):
    from tessera.llm.queries import QUERIES

    return {name: (df.columns, df.collect()) for name, df in ((n, f(spark, SMALL)) for n, f in QUERIES.items())}


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "least"), [("op1_quality_embed", "quality", 3, 1, 0.9), ("op4_toxicity_fm", "toxic", 5, 0, 0.8)])
def test_scores(results, tables, name, label, modulus, rest, least):
    columns, rows = results[name]
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in tables["documents"])
    truth = {r["doc_id"]: r[label] for r in tables["labels"]}
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], modulus) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if truth.get(r["doc_id"]) is not None]) > least


def test_language(results, tables):
    columns, rows = results["op5_langid_kn"]
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in tables["documents"]}
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows) and len(rows) == len(truth)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]) > 0.95


def test_packing(results, tables):
    columns, rows = results["op2_packing"]
    assert columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert docs.keys() == {r["doc_id"] for r in tables["documents"]}
    for parts in [*bins.values(), *([x[1:] for x in sorted(own)] for own in docs.values())]:
        at = 0
        for begin, length in sorted(parts):
            assert begin == at and 0 < length <= 2048
            at += length
    assert all(sum(n for _, n in own) <= 2048 for own in bins.values())
    assert all(len(own) == 1 or sum(n for *_, n in own) > 2048 for own in docs.values())


def test_repeats(results, tables):
    columns, rows = results["op6_suffix_dedup"]
    assert columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    given = [(r["doc_id"], r["text"], None) for r in tables["documents"]]
    words = [w[0] for w in brute_repeated_words(given, 51)]
    assert Counter(map(tuple, rows)) == Counter((g[0], *x, w) for g, x, w in zip(given, brute_repeats(given, 400), words, strict=True))


def test_near_duplicates(results, tables):
    columns, rows = results["op7_near_dedup"]
    assert columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute_near([(r["doc_id"], r["text"], None) for r in tables["documents"]], 3, 85)
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


def test_nearest(results, tables):
    columns, rows = results["op8_ann_ivfpq"]
    assert columns[:4] == ["query_id", "rank", "vec_id", "score"]
    ids = np.array([r["vec_id"] for r in tables["embeddings"]])
    x = np.array([r["embedding"] for r in tables["embeddings"]], float)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), []
    got = defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert got.keys() == {i for i in ids if i % 50 == 0}
    for q, own in got.items():
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(own) == [1, 2, 3, 4, 5]
        hits.append(len(set(best) & set(own.values())) / 5)
    assert np.mean(hits) >= 0.9


def test_mixing(results, tables):
    columns, rows = results["op9_mixing"]
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    source, sizes, took = {r["doc_id"]: r["source"] for r in tables["documents"]}, Counter(), Counter()
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        took[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0) and (r["slots"] == 0) == (r["taken"] == 0)
    assert all(took[s] == int(t) for s, t in brute_targets(sizes, [5, 2, 1], 3.0).items())


def test_host_rules_and_tool_calls(results, tables):
    columns, rows = results["op3_host_rules"]
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert len(rows) == len(tables["documents"]) and all(not (r["kept"] and r["base_failed"]) for r in rows)
    _, rows = results["op10_tool_calls"]
    assert sum(r["level"] is not None for r in rows) == sum(r["role"] == "user" for r in tables["conversations"])
