"""The pipeline's stages, each on what the one before it kept, against brute-force versions."""

import random
from collections import Counter, defaultdict

import pytest
from test_documents import brute_near, brute_repeated_words, brute_targets, encode


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    rng = random.Random(21)
    parts = {"xx": ["ba", "do", "ki", "la"], "yy": ["schr", "tz", "ung", "ei"]}

    def prose(lang, many):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(many))

    rows, passage = [], prose("xx", 130)
    for i in range(160):
        lang = "xx" if i % 3 else "yy"
        text = prose(lang, rng.randrange(5, 200))
        if i % 20 == 7:
            text = text[:300] + "\n" + passage + "\n" + text[300:]
        rows.append([i, text, lang, f"src{i % 4}", len(text)])
    for i in range(0, 40, 4):
        rows.append([500 + i, rows[i][1], rows[i][2], "src1", 0])  # exact copies
        rows.append([600 + i, rows[i][1] + " ba", rows[i][2], None, 0])  # near copies
    rows += [[900, None, "xx", "src0", None], [901, "", "xx", "src0", 0], [902, "123 !!", None, "src0", 7], [5, *rows[5][1:]], [None, prose("xx", 90), "xx", "src2", 1]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {"schema": "doc_id long, text string, lang string, source string, n_chars long"}
    out["documents"] = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out/{k}")
        docs = spark.read.parquet(f"{path}/out/{k}")
        out[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out["run"] = corpus_pipeline.run(spark, path).collect()
    return out


def test_language_keeps_clean_documents(stages):
    assert Counter(tuple(r) for r in stages["language"]) == Counter(tuple(r) for r in stages["documents"] if r["doc_id"] not in (900, 901, 902))


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages["language"]]
    want = brute_near(rows, 5, 80)
    assert sorted(r["doc_id"] for r in stages["near_duplicates"] if r["doc_id"] is not None) == sorted(i for i, w in want.items() if w[2])
    assert sum(r["doc_id"] is None for r in stages["near_duplicates"]) == 1


def test_repeated_strings_go(stages):
    before = [(r["doc_id"], r["text"], None) for r in stages["near_duplicates"]]
    want = {row[0]: found for row, found in zip(before, brute_repeated_words(before, 51), strict=True)}
    after = {r["doc_id"]: r for r in stages["repeated_strings"]}
    assert after.keys() == want.keys() and any(w[0] for w in want.values())
    for i, r in after.items():
        assert r["text"] == want[i][1] and r["n_chars"] == len(r["text"])


def test_mix_follows_weights(stages):
    sizes, took = Counter(), Counter()
    for r in stages["repeated_strings"]:
        sizes[r["source"]] += len(r["text"].split())
    for r in stages["mix"]:
        took[r["source"]] += len(r["text"].split())
    longest = max(len(r["text"].split()) for r in stages["repeated_strings"])
    for source, target in brute_targets(sizes, [5, 2, 1], 3.0).items():
        assert abs(took[source] - target) <= longest
    known = {(r["doc_id"], r["text"]) for r in stages["repeated_strings"]}
    copies = Counter((r["doc_id"], r["text"]) for r in stages["mix"])
    assert copies.keys() <= known and max(copies.values()) <= 3


def test_pack_holds_every_token_once(stages):
    want = Counter()
    for r in stages["mix"]:
        want[r["doc_id"]] += len(encode(r["text"]))
    got, bins = Counter(), defaultdict(list)
    for r in stages["pack"]:
        got[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in stages["run"]) == Counter((r["doc_id"], r["ids_crc32"]) for r in stages["pack"])


def test_mix_is_in_slot_order(spark, stages):
    """The rows come in the order in which the schedule's slots take them, so that any stretch of them is mixed."""
    import corpus_pipeline

    rows = [(i, f"w{i} " * 50, "xx", f"s{i % 3}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, stages["schema"])
    got = [r["source"] for r in corpus_pipeline.mix(spark, docs, "").collect()]
    shares = {s: got.count(s) / len(got) for s in set(got)}
    for start in range(0, len(got) - 80, 40):
        part = got[start : start + 80]
        assert all(abs(part.count(s) / 80 - share) < 0.2 for s, share in shares.items())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_and_more_columns(spark, stages, k):
    import corpus_pipeline

    stage = corpus_pipeline.STAGES[k][1]
    empty = spark.createDataFrame([], stages["schema"])
    assert stage(spark, empty, "").collect() == []
    rows = [(i, " ".join(f"ba{j * (i + 1) % 37}do" for j in range(60)), "xx", f"s{i % 3}", 0) for i in range(20)] + [(20, None, None, None, None), (21, "", "xx", None, 0), (3, "ba do ki", "xx", "s0", 8)]
    more = ["repeats", "language", "h", "n", "row", "apart", "slot", "size", "kept", "rep", "v", "score", "piece", "sequence_id", "k", "d", "source_size"]
    docs = spark.createDataFrame(rows, stages["schema"]).selectExpr("*", *(f"'x' as {c}" for c in more))
    plain = stage(spark, spark.createDataFrame(rows, stages["schema"]), "").drop("sequence_id", "offset")
    found = stage(spark, docs, "")
    assert k == 4 or found.columns == docs.columns
    assert Counter(map(str, found.select(plain.columns).collect())) == Counter(map(str, plain.collect()))


def test_rows_of_one_doc_id_with_different_texts(spark, stages):
    import corpus_pipeline

    rows = [(1, "a b c d e f", "xx", "s", 0), (1, "g h i j k l", "xx", "s", 0), (1, "a b c d e f", "xx", "s", 0), (2, "a b c d e f", "xx", "s", 0), (2, "m n o p q r", "xx", "s", 0)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, stages["schema"]), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] == 1) == {(1, "a b c d e f"): 1, (1, "g h i j k l"): 1}
