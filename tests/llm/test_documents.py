"""Document operators against brute-force versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import host_rules, mixing, near_dedup, packing, suffix_dedup

SCHEMA = "doc_id long, text string, source string, n long, score double, repeats string, sequence_id string, v long, rep string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with more columns, whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, 7, 0.5, "x", "y", 3, "z") for i, t, s in rows], SCHEMA)


def corpus(seed, many=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["été", "ça", "naïve"]
    base = " ".join(rng.choice(words) for _ in range(120))
    passage = " ".join(rng.choice(words) for _ in range(95))
    rows = []
    for i in range(many):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            own = base.split(" ")
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        elif kind == 2:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(80))) + "\n" + passage
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(150)))
        rows.append((i, text, f"s{i % 4}"))
    rows += [(900, None, None), (901, "", "s0"), (902, " \t\n ", "s0"), (903, "one", "s1"), (904, "one", "s1"), (905, "ONE two", None), (905, "ONE two", None), (None, base, "s2")]
    rows += [(906, "ab" * 700, "s3"), (907, "word " * 30000, "s3"), (908, "x" * 399, "s3"), (909, "x" * 400, "s3"), (910, "x" * 401, "s3")]
    return rows


def brute_near(rows, width, percent):
    sets = {}
    for i, text, _ in rows:
        if i is not None:
            words = (text or "").encode().lower().split()
            sets[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "percent", "short"), [(3, 85, 24), (5, 80, 2), (3, 85, 2)])
def test_near_duplicates(spark, monkeypatch, width, percent, short):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)  # 2: nearly every list is a long one
    rows = corpus(1)
    got = near_dedup.near_duplicates(frame(spark, rows), width, percent).collect()
    assert len(got) == len(rows)
    want = brute_near(rows, width, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


@pytest.mark.parametrize("layout", ["a18 b18 s160 a2 b2", "a12 b12 s60 a13 b12 s140"])
def test_near_duplicates_unlucky_sketches(spark, layout):
    # similarity 0.8, but only 14 of 32 values of the sketches, or 79 of 128 of the union's, are common; chances of 1e-5 and 1e-6
    words = sorted((f"w{i}" for i in range(300)), key=lambda w: int(next(near_dedup.shingle_sets([w], 1))[0]))
    a, b = [], []
    for run in layout.split():
        own = [words.pop(0) for _ in range(int(run[1:]))]
        a += own if run[0] in "as" else []
        b += own if run[0] in "bs" else []
    got = near_dedup.near_duplicates(frame(spark, [(1, " ".join(a), "x"), (2, " ".join(b), "x")]), 1, 80).collect()
    assert {r["component_id"] for r in got} == {1}
    for k, percent, chance in ((32, 80, near_dedup.SKETCH_MISS), (32, 85, near_dedup.SKETCH_MISS), (128, 80, near_dedup.ESTIMATE_MISS), (128, 85, near_dedup.ESTIMATE_MISS)):
        low = near_dedup.fewest(k, percent, chance)
        below = [sum(math.comb(k, i) * (percent / 100) ** i * (1 - percent / 100) ** (k - i) for i in range(m)) for m in (low, low + 1)]
        assert below[0] <= chance < below[1]


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, []), 3, 85).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone, [0])).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 64, 32])
def test_remove_repeats(spark, length):
    rows = corpus(2)
    rows[-4] = (907, "word " * 2000, "s3")
    got = suffix_dedup.remove_repeats(frame(spark, rows), length).collect()
    assert Counter(zip([r[0] for r in rows], brute_repeats(rows, length), strict=True)) == Counter((r["doc_id"], (r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"], r["repeats"]["kept_sha256"])) for r in got)
    assert {r["repeats"]["kept"] for r in got if r["doc_id"] == 900} == {None}


def brute_repeated_words(rows, length):
    """For each text: words inside repeated strings of so many words, and the text without them."""
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for _, t, _ in rows]
    words = [[m.group() for m in f] for f in found]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (_, t, _), f, w in zip(rows, found, words, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        data, at, kept = (t or "").encode(), 0, b""
        for j in sorted(gone):
            begin = f[j].start() if j - 1 not in gone else f[j - 1].end()
            kept, at = kept + data[at:begin], f[j].end()
        out.append((len(gone), None if t is None else (kept + data[at:]).decode()))
    return out


@pytest.mark.parametrize("length", [51, 9, 8])
def test_remove_repeated_words(spark, length):
    rows = corpus(7)
    rows[-4] = (907, "word " * 2000, "s3")
    rows += [(i, t.replace(" ", " \t"), s) for i, t, s in rows[2:20:6]]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length, unit="words").collect()
    want = brute_repeated_words(rows, length)
    assert Counter((r[0], w[1]) for r, w in zip(rows, want, strict=True)) == Counter((r["doc_id"], r["repeats"]["kept"]) for r in got)
    both = suffix_dedup.remove_repeats(frame(spark, rows), 400, shared_words=length).collect()
    assert Counter((r[0], w[0], *x) for r, w, x in zip(rows, want, brute_repeats(rows, 400), strict=True)) == Counter((r["doc_id"], r["repeats"]["n_shared_words"], r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"], r["repeats"]["kept_sha256"]) for r in both)


def test_remove_repeats_across_segments(spark, monkeypatch):
    """A text is searched in segments that share a window's length; here on the driver, where the segment can be set small."""
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(6000))
    docs = [np.frombuffer(t.encode(), np.uint8) for t in (long, "zz" + long[300:5200])]
    whole = [x for x in suffix_dedup._segments(docs, 400)]
    assert [len(w[2]) - 399 for w in whole if w[0] == 0] == [1000] * 5 + [601]


def test_long_texts_cut_into_segments(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh") for _ in range((1 << 20) + 5000))
    texts = [long, long[: 1 << 12] + "x" + long[(1 << 20) - 700 :], long[(1 << 20) - 200 : (1 << 20) + 1000]]
    got = {r["doc_id"]: r["repeats"] for r in suffix_dedup.remove_repeats(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), 400).collect()}
    assert [got[i]["n_removed"] for i in range(3)] == [4096 + 5700, len(texts[1]) - 1, 1200]


def test_repeats_of_two_kinds_of_symbols_need_sensible_lengths(spark):
    for bad in ({"length": 31}, {"length": 7, "unit": "words"}, {"unit": "lines"}, {"shared_words": 3}):
        with pytest.raises(ValueError, match="unit must be"):
            suffix_dedup.remove_repeats(frame(spark, []), **bad)


def test_remove_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_host_rules(spark):
    rows = corpus(3)
    # a host whose rows nearly all fail, so that the method drops the rest of it too
    rows += [(1000 + i, "same same same " * 40, "bad") for i in range(60)] + [(1100, " ".join(f"u{i}" for i in range(80)), "bad")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = host_rules.apply_rules(frame(spark, rows), F.col("source"), failed, excess=1.5).collect()
    want = []
    for i, text, host in rows:
        words, lines = (text or "").encode().split(), [x for x in (text or "").split("\n") if x.encode().split()]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {j + d for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for d in range(3)}
        base = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want.append((i, len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), base, host))
    n, k = Counter(w[-1] for w in want), Counter(w[-1] for w in want if w[-2])
    total = sum(n.values())
    mean = sum(k.values()) / total
    between = sum(k[h] ** 2 / n[h] for h in n) / total - mean**2 - mean * (1 - mean) * len(n) / total
    weight = min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1))
    rate = {h: (k[h] + mean * weight) / (n[h] + weight) for h in n}
    bad = {h for h in n if rate[h] - 2 * math.sqrt(rate[h] * (1 - rate[h]) / (n[h] + weight + 1)) > 1.5 * mean}
    assert "bad" in bad and None not in bad and len(bad) < len(n)
    assert Counter((*tuple(r)[:8], round(r["host_rate"], 5)) for r in got) == Counter((*w[:7], not w[6] and w[7] not in bad, round(rate[w[7]], 5)) for w in want)
    assert any(not r["base_failed"] and not r["kept"] for r in got)
    assert host_rules.apply_rules(frame(spark, []), F.col("source"), failed).collect() == []


def brute_targets(sizes, weights, most):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / share for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("block", [64, 1000])
def test_mixing(spark, block):
    rows = corpus(5) + [(2000 + i, "small words here", f"t{i}") for i in range(5)]
    documents, pieces = mixing.mix_sources(frame(spark, rows), [5, 2, 1], 3.0, block)
    got = documents.collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want = brute_targets(sizes, [5, 2, 1], 3.0)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len((t or "").encode().split()), sizes[s]) for i, t, s in rows)
    by_size = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert any(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for s in want if sizes[s] == r["source_size"])
        by_size[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (_, target), taken in by_size.items():
        same = [s for s in want if round(want[s], 6) == target]
        assert abs(taken - sum(int(want[s]) for s in same)) <= len(same)
    slots = [r["slot"] for r in pieces.select("slot", "sid").distinct().collect()]
    assert len(slots) == len(set(slots))  # a slot belongs to one source
    again = mixing.mix_sources(frame(spark, rows).repartition(3), [5, 2, 1], 3.0, block)[0].collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mixing_follows_the_golden_ratio(spark):
    """Which slot each document falls into, from the points one by one; other orders of the same shares give other slots."""
    rows = corpus(6) + [(3000 + i, "w " * (40 + i), f"s{i % 3}") for i in range(60)]
    block = 16
    documents, pieces = mixing.mix_sources(frame(spark, rows), [5, 2, 1], 3.0, block)
    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(r[0], len((r[1] or "").encode().split())) for r in rows], "doc_id long, size long").select("doc_id", F.pmod(F.xxhash64(F.lit(17), "doc_id", "size"), F.lit(1 << 40)).alias("h")).collect()}
    sizes, lines = Counter(), defaultdict(list)
    for i, text, source in rows:
        size = len((text or "").encode().split())
        sizes[source] += size
        lines[source].append((order[i], i if i is not None else -1, size))
    target = {s: int(t) for s, t in brute_targets(sizes, [5, 2, 1], 3.0).items()}
    names = sorted(s for s in sizes if s is not None) + [None]
    need = {s: target[s] // sizes[s] * -(-sizes[s] // block) + -(-(target[s] % sizes[s]) // block) for s in names}
    total, edges, low = sum(need.values()), {}, 0.0
    for s in names:
        edges[s] = (round(low * 2**31), round((low + need[s] / total) * 2**31))
        low += need[s] / total

    def slots(points):
        """slot of the r-th block of each source"""
        out = defaultdict(list)
        for slot, u in enumerate(points):
            s = next(s for s in names if edges[s][0] <= u < edges[s][1])
            if len(out[s]) < need[s]:
                out[s].append(slot)
        return {s: own + list(range(len(points) + len(own), len(points) + need[s])) for s, own in ((s, out[s]) for s in names)}

    def first_slots(by_source):
        found = {}
        for s in names:
            at, taken = 0, target[s]
            for _, i, size in sorted(lines[s]):
                if size and at < taken:
                    found.setdefault((i, size), set()).add(by_source[s][at // block])
                at += size
        return found

    want = first_slots(slots([i * 1327217885 % 2**31 for i in range(total)]))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["first_slot"]) for r in documents.collect() if r["first_slot"] is not None]
    assert {(i, n) for i, n, _ in got} == set(want)
    assert all(slot in want[i, n] for i, n, slot in got)
    evenly = first_slots(slots([i * 2**31 // total for i in range(total)]))
    assert sum(slot in evenly[i, n] for i, n, slot in got) < len(got) / 4


def test_mixing_empty(spark):
    documents, pieces = mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "  ", None)]), [5, 2, 1])
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in documents.collect()) == [(1, 0, 0), (2, 0, 0)] and pieces.count() == 0
    assert mixing.mix_sources(frame(spark, []), [5, 2, 1])[0].collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    histogram = Counter(min(capacity, max(1, int(rng.expovariate(4 / capacity)))) for _ in range(rng.choice([1, 50, 5000])))
    keys, table = packing.Plan(dict(histogram), capacity).arrays()
    bins = defaultdict(list)
    for size, many in histogram.items():
        for rank in range(many):
            row = table[np.searchsorted(keys, (size << 44) | rank, side="right") - 1]
            assert row[0] == size
            bins[row[2] + (rank - row[1]) // row[3]].append((row[4] + (rank - row[1]) % row[3] * size, size))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * size > capacity for _, size in own) <= 2
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    assert len(bins) <= 1.25 * max(least, sum(n for s, n in histogram.items() if 2 * s > capacity)) + 1


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_pack_documents(spark):
    import public_tokenizers as p

    rows = corpus(6) + [(3000, "a <|endoftext|> b  c\n \td é漢字 �", None)]
    rows = [(i, t if i != 907 else "word " * 5000, s) for i, t, s in rows]
    got = packing.pack_documents(frame(spark, rows), 2048, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = np.array(encode(text), "<u4")
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)] if len(ids) > 2048 else [0]
        for piece, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, piece, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(frame(spark, []), 2048, p.path("byte_bpe_50k.json")).collect() == []


def test_fast_words_agree_with_tokenizers():
    import public_tokenizers as p

    rng = random.Random(8)
    encoder = packing.Encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))
    letters = [chr(c) for c in range(1, 0x250)] + list(" \n\t  '''abcdefgh") * 8 + ["漢", "🙂", " ", "　", "\x85", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert encoder.encode(text).tolist() == encode(text)[:-1], repr(text)
