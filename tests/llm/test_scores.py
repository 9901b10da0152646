"""Learned operators on planted texts, nearest neighbours against brute force, tool calls against hand-made cases."""

import json
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann_ivfpq, langid_kn, quality_embed, tool_calls, toxicity_fm

RNG = random.Random(12)
PARTS = {"xx": ["ba", "do", "ki", "la"], "yy": ["schr", "tz", "ung", "ei"], "zz": ["ção", "lh", "nh", "ei"]}


def prose(lang, many=40):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randrange(1, 5))) for _ in range(many))


ODD = [(9001, None), (9002, ""), (9003, " \n "), (9004, "123 !!"), (None, "ba do ki"), (9005, "ba " * 30000), (9006, "é"), (9006, "é")]


def with_clashes(df):
    return df.selectExpr("*", "'a' as score", "'b' as language", "1 as held_out", "2 as y", "'c' as _p")


def test_language(spark):
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    model = langid_kn.fit(docs, F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False)))
    got = langid_kn.identify(with_clashes(docs), model).select("doc_id", "text", "lang", "language.*").collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["lang"]:
            assert r["lang_pred"] == r["lang"] and not r["rejected"]
        no_letter = not langid_kn.words_of(r["text"])
        assert (r["lang_pred"] == "und") == no_letter
    odd = langid_kn.LanguageModel([("xx", prose("xx", 400)) for _ in range(20)])
    table = odd.table(["qqqwwww", "zzzzxxx", "vvvvvv"]).sum(0) * 20
    assert odd.decide(table)[3]  # nothing like the learned language
    none = langid_kn.fit(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid_kn.identify(docs, none).select("language.lang_pred").collect()} == {"und"}
    assert langid_kn.identify(docs.limit(0), model).collect() == []


def test_kneser_ney_sums_to_one():
    from collections import Counter

    model = langid_kn.KneserNey(Counter({"abab": 3, "abc": 2, "cab": 1, "b": 4}), order=4)
    for before in ("", "a", "ab", "ca", "zz"):
        total = 0.0
        for c in "abc":
            text = langid_kn.Marked([before + c], 4)
            total += np.exp(model._score(text, np.array([len(before) + 1])))[0]
        text = langid_kn.Marked([before], 4)
        total += np.exp(model._score(text, np.array([len(before) + 1])))[0]
        assert 0.5 < total <= 1.0 + 1e-9  # the rest is for points never seen


def labelled(spark, bad):
    rows, labels = [], []
    for i in range(400):
        rows.append((i, bad(prose("xx")) if i % 4 == 0 else prose("xx")))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(7777, 1), (None, 1), (3, None), (2, 5)], "doc_id long, y int")


def held_out_accuracy(scored):
    rows = [r for r in scored.collect() if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 3 == 1]
    return np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows])


def test_quality(spark):
    docs, labels = labelled(spark, lambda t: t.upper().replace(" ", "!! "))
    model = quality_embed.fit(docs, labels, "y", F.col("doc_id") % 3 != 1)
    scored = quality_embed.score(with_clashes(docs), model)
    assert scored.count() == docs.count() and held_out_accuracy(scored) > 0.97
    repeated, labels = labelled(spark, lambda t: " ".join([t.split()[0], t.split()[1]] * 30))
    assert held_out_accuracy(quality_embed.score(repeated, quality_embed.fit(repeated, labels, "y", F.col("doc_id") % 3 != 1))) > 0.95
    nothing = quality_embed.fit(docs, labels, "y", F.lit(False))
    assert {round(r["score"], 6) for r in quality_embed.score(docs, nothing).collect()} == {0.5}
    assert quality_embed.score(docs.limit(0), model).collect() == []


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda t: t + " dreadword " + t + " dreadword")
    model = toxicity_fm.fit(docs, labels, "y", F.col("doc_id") % 3 != 1)
    scored = toxicity_fm.score(with_clashes(docs), model)
    assert scored.count() == docs.count() and held_out_accuracy(scored) > 0.97
    nothing = toxicity_fm.fit(docs, labels, "y", F.lit(False))
    assert {r["score"] for r in toxicity_fm.score(docs, nothing).collect()} == {0.5}
    assert toxicity_fm.score(docs.limit(0), model).collect() == []
    assert toxicity_fm.fit(docs.limit(0), labels.limit(0), "y", F.lit(True)).score(np.zeros((0, 5), np.int64), 0) == 0.5


MASK = (1 << 64) - 1


def plain_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & MASK
    return x ^ (x >> 33)


def plain_quality(model, text):
    """A document's score, feature by feature."""
    words, total, count = (text or "").encode().split(), 0.0, 0

    def add(name):
        nonlocal total, count
        total, count = total + model.weights[name % (model.buckets - 5) + 5], count + 1

    names = []
    for w in words:
        marked = [ord(c) for c in f"<{w.decode()}>"]
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                name = n
                for c in marked[i : i + n]:
                    name = (name * 0x100000001B3 + c + 1) & MASK
                add(plain_mix(name))
        whole = sum(plain_mix((c + plain_mix(i)) & MASK) for i, c in enumerate(marked)) & MASK
        add(plain_mix((whole + 77) & MASK))
        names.append(whole & ((1 << 50) - 1))
    for a, b in zip(names, names[1:], strict=False):
        add(plain_mix((a * 0x9E3779B97F4A7C15 + plain_mix(b)) & MASK))
    for a, b, c in zip(words, words[1:], words[2:], strict=False):
        kind = 4 if a == b == c else 3 if a == c else 2 if a == b else 1 if b == c else 0
        total, count = total + model.weights[kind], count + 1
    return 1 / (1 + np.exp(-model.bias - (total / count if count else 0)))


def test_quality_scores_against_brute_force(spark):
    docs, labels = labelled(spark, lambda t: t.upper() + " é é é çà " * 3)
    model = quality_embed.fit(docs, labels, "y", F.col("doc_id") % 3 != 1)
    odd = [(1, "é"), (2, "a a"), (3, "x y x y y y"), (4, "日本 語 日本 語"), *ODD]
    rows = quality_embed.score(spark.createDataFrame(odd, "doc_id long, text string").union(docs.limit(40)), model).collect()
    for r in rows:
        assert abs(r["score"] - plain_quality(model, r["text"])) < 1e-9


def test_quality_sees_repetition_of_unknown_words(spark):
    docs, labels = labelled(spark, lambda t: " ".join(f"{w} {w} {w}" for w in t.split()[:12]))
    model = quality_embed.fit(docs, labels, "y", F.col("doc_id") % 3 != 1)
    fresh = [(1, "uvw uvw uvw uvw jkq jkq jkq jkq"), (2, "uvw jkq rst opl mnb vcx zas qwe")]
    got = {r["doc_id"]: r["score"] for r in quality_embed.score(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > got[2]


def plain_toxicity(model, text):
    """A document's score, term by term and pair by pair."""
    words = toxicity_fm.words_of(text)
    times = {}
    for w in words:
        for stem in [w] + [w[:n] + "*" for n in toxicity_fm.STEMS if len(w) > n]:
            times[stem] = times.get(stem, 0) + 1
    terms = []
    for stem, c in times.items():
        at = np.flatnonzero(model.names == np.uint64(xxhash.xxh3_64_intdigest(stem)))
        if len(at):
            holds = [True, c >= 2, c >= 2 and 128 * c >= len(words), c >= 2 and 64 * c >= len(words)]
            terms += [i for i, h in zip(model.inputs[at[0]], holds, strict=True) if h and i >= 0]
    z = model.bias + sum(model.weights[i] for i in terms)
    z += sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(terms) for j in terms[a + 1 :])
    return 1 / (1 + np.exp(-z))


def test_toxicity_scores_against_brute_force(spark):
    docs, labels = labelled(spark, lambda t: t + " dreadword " + t + " dreadwords")
    model = toxicity_fm.fit(docs, labels, "y", F.col("doc_id") % 3 != 1)
    extra = spark.createDataFrame([*ODD[:5], (9007, "Dreadword dreadword! ba"), (9008, "dreadwordish")], "doc_id long, text string")
    for r in toxicity_fm.score(extra.union(docs.limit(30)), model).collect():
        assert abs(r["score"] - plain_toxicity(model, r["text"])) < 1e-9


def plain_kneser_ney(counts, order, discount=0.75):
    """log-probability of a marked word under interpolated Kneser-Ney, from dictionaries."""
    words = {f"\2{w}\3": k for w, k in counts.items()}
    floor, levels = 1 / (len(set("".join(words))) + 1000), []

    def prob(s, i):
        p = floor
        for n, (probs, shares) in enumerate(levels):
            if i >= n and s[i - n : i] in shares:
                p = probs.get(s[i - n : i + 1], shares[s[i - n : i]] * p)
        return p

    for n in range(order):
        count, longer = {}, {}
        for s, k in words.items():
            for i in range(max(n, 1), len(s)):
                g = s[i - n : i + 1]
                count[g] = count.get(g, 0) + k
                if i > n:
                    longer.setdefault(g, set()).add(s[i - n - 1 : i + 1])
        if n + 1 < order:
            count = {g: len(longer[g]) if g in longer else k for g, k in count.items()}
        total, off = {}, {}
        for g, k in count.items():
            total[g[:-1]] = total.get(g[:-1], 0) + k
            off[g[:-1]] = off.get(g[:-1], 0) + min(discount, k)
        shares = {c: off[c] / total[c] for c in total}
        probs = {g: (k - min(discount, k)) / total[g[:-1]] + shares[g[:-1]] * prob(g, len(g) - 1) for g, k in count.items()}
        levels.append((probs, shares))
    return lambda w: sum(np.log(prob(f"\2{w}\3", i)) for i in range(1, len(w) + 2))


def test_kneser_ney_against_brute_force():
    from collections import Counter

    counts = Counter(langid_kn.words_of(prose("xx", 200) + " été straße ab a"))
    asked = [*list(counts)[:50], "zzz", "bazz", "é", "dokizla", "ab"]
    for order in (1, 2, 3, 5):
        model, plain = langid_kn.KneserNey(counts, order), plain_kneser_ney(counts, order)
        got, _ = model.words(langid_kn.Marked(asked, order), len(asked))
        assert np.allclose(got, [plain(w) for w in asked], rtol=0, atol=1e-9)


def test_kneser_ney_of_words_shorter_than_the_order():
    from collections import Counter

    for counts in (Counter({"a": 2, "ba": 1}), Counter({"b": 1})):
        model, plain = langid_kn.KneserNey(counts, 5), plain_kneser_ney(counts, 5)
        got, _ = model.words(langid_kn.Marked(["a", "ab", "zzzzzz"], 5), 3)
        assert np.allclose(got, [plain(w) for w in ("a", "ab", "zzzzzz")], rtol=0, atol=1e-9)
    assert langid_kn.LanguageModel([("xx", "a b a"), ("yy", "c d")]).langs == ["xx", "yy"]


def test_language_decision_against_brute_force():
    from collections import Counter

    texts = {lang: [prose(lang, 30) for _ in range(6)] for lang in PARTS}  # too few to keep any back
    model = langid_kn.LanguageModel([(lang, t) for lang, own in texts.items() for t in own])
    plain = {lang: plain_kneser_ney(Counter(langid_kn.words_of(" ".join(own))), 5) for lang, own in texts.items()}
    for text in [prose("yy", 9), prose("zz", 4) + " " + prose("xx", 5), "ei", "ba schr"]:
        words = langid_kn.words_of(text)
        points = sum(len(w) + 1 for w in words)
        entropy = {lang: -sum(p(w) for w in words) / points for lang, p in plain.items()}
        lang, score, best, _ = model.decide(model.table(words).sum(0))
        assert lang == min(entropy, key=lambda x: (entropy[x], x)) and abs(best - entropy[lang]) < 1e-9
        assert abs(score - 1 / sum(np.exp(-(e - best) * model.temperature) for e in entropy.values())) < 1e-9


def test_factorization_machine_learns_pairs():
    # either word alone is fine, both together are not: no sum of single weights tells that
    texts, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        texts.append(prose("xx", 10) + " alpha" * a + " omega" * b)
        labels.append(int(a == b))
    model = toxicity_fm.ToxicityModel(texts, labels, epochs=40)
    right = [(model.score(model.places(toxicity_fm.words_of(t)), len(toxicity_fm.words_of(t))) >= 0.5) == y for t, y in zip(texts, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32).astype(float)
    x[100:160] = x[50]  # a class of copies, some of them queries
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0] * 3), (None, [1.0] * 16), (7, rows[7][1]), (1050, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'q' as score", "'h' as h", "1 as rank")
    got = ann_ivfpq.search(df, F.col("vec_id") % 50 == 0, top=5).collect()
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    hits = 0
    for q in range(0, 400, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & {r["vec_id"] for r in own})
        for r in own:
            assert abs(r["score"] - s[r["vec_id"]]) < 1e-12
    assert len(got) == 40 and hits >= 36
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 50), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    few = ann_ivfpq.search(df.where("vec_id < 3"), F.col("vec_id") == 0, top=5).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann_ivfpq.search(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False), "on": ("boolean", False), "from": ("object", False)}}
    calls = [
        (1, "x", 1, "add", '{"b": 2.5, "a": 1}'),
        (1, "y", 2, "add", '{"a": 1, "from": {"$ref": "x"}, "tags": [{"$ref":"z"}]}'),
        (1, "z", 3, "add", '{"a": 7, "on": true}'),
        (1, "p", 4, "add", '{"a": 1, "from": {"$ref": "q"}}'),
        (1, "q", 5, "add", '{"a": 1, "from": {"$ref": "p"}}'),
        (1, "r", 6, "add", '{"a": "1", "b": "2", "tags": {}, "on": 0, "from": [], "more": 1}'),
        (1, "s", 7, "sub", "{}"),
        (1, "t", 8, "add", "{broken"),
        (1, "u", 9, None, None),
        (1, "w", 10, "add", '{"a": null, "from": {"$ref": "gone"}}'),
        (1, "x", 11, "add", '{"a": 99}'),
        (None, "x", 1, "add", "{}"),
        (2, None, 1, "add", "{}"),
    ]
    results = [(1, c, 20, f"out {c}") for c in "xyzpqrstuw"] + [(1, "x", 21, "late"), (1, "lost", 22, "é\"\n"), (2, None, 3, "n")]
    got = tool_calls.link_calls(
        spark.createDataFrame([(*c, "clash") for c in calls], "conv_id long, call_id string, seq long, name string, arguments string, level string"),
        spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string"),
        schemas,
    ).collect()
    odd = sorted((r["conv_id"] or 0, r["call_id"] or "", r["seq"], r["level"], r["valid"], r["errors"]) for r in got if "no_id" in r["errors"] or "duplicate" in r["errors"])
    assert odd == [(0, "x", 1, None, False, "no_id"), (1, "x", 11, None, False, "duplicate_id"), (1, "x", 21, None, False, "duplicate_result"), (2, "", 1, None, False, "no_id"), (2, "", 3, None, False, "no_id")]
    assert json.loads(next(r["record"] for r in got if r["errors"] == "duplicate_id")) == {"arguments": {"a": 99}, "errors": ["duplicate_id"], "id": "x", "name": "add"}
    got = [r for r in got if "no_id" not in r["errors"] and "duplicate" not in r["errors"]]
    by = {r["call_id"]: r for r in got}
    assert len(by) == len(got) == 11
    assert {k: r["level"] for k, r in by.items()} == {"x": 0, "y": 1, "z": 0, "p": None, "q": None, "r": 0, "s": 0, "t": 0, "u": 0, "w": 0, "lost": None}
    assert {k: r["errors"] for k, r in by.items()} == {
        "x": "", "y": "", "z": "", "p": "cycle", "q": "cycle", "r": "extra:more,type:a,type:b,type:from,type:on,type:tags", "s": "unknown_tool", "t": "no_json",
        "u": "no_json", "w": "missing:a,unknown_reference:gone", "lost": "orphan_result",
    }
    assert by["x"]["record"] == '{"arguments":{"a":1,"b":2.5},"errors":[],"id":"x","level":0,"name":"add","result":"out x"}'
    assert json.loads(by["lost"]["record"]) == {"errors": ["orphan_result"], "id": "lost", "result": 'é"\n'}
    none = spark.createDataFrame([], "conv_id long, call_id string, seq long, name string, arguments string")
    assert tool_calls.link_calls(none, spark.createDataFrame([], "conv_id long, call_id string, seq long, content string"), schemas).collect() == []
    chain = [(9, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(70)] + [(9, "m", ["c69", "c3"]), (9, "n", ["m"]), (9, "k", ["n", "m"]), (9, "o", ["o2"]), (9, "o2", ["o"]), (9, "p", ["o", "c0"])]
    deep = {r["call_id"]: r["level"] for r in tool_calls.levels(spark.createDataFrame(chain, "conv_id long, call_id string, refs array<string>")).collect()}
    assert deep == {f"c{i}": i for i in range(70)} | {"m": 70, "n": 71, "k": 72}
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (None, 1, "user", "x"), (2, None, "assistant", "x"), (3, 5, "user", "")], "conv_id long, turn long, role string, text string")
    linked = tool_calls.link_calls(*tool_calls.conversation_calls(turns), tool_calls.CONVERSATION_TOOLS).collect()
    assert sum(r["errors"] == "no_id" for r in linked) == 2
    linked = {r["call_id"]: r for r in linked if r["errors"] != "no_id"}
    assert {k: (r["level"], r["errors"]) for k, r in linked.items()} == {"1-1": (0, ""), "1-3": (1, "missing:text,missing:words,no_result"), "3-5": (0, "no_result,unknown_reference:3-3")}


def test_rare_toxic_words_count():
    # each group has its own insult in 5 of 3000 rows, far below a share of the rows, and there are more terms than a fixed number of inputs takes
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)]
    insults = [f"{c}nsult" * 2 for c in "klmnopqrst"]

    def text(*more):
        return " ".join(rng.sample(plain, 30) + list(more))

    texts, labels = [text() for _ in range(2700)], [0] * 2700
    texts += [text("dreadword", "dreadword") for _ in range(250)] + [text(w, w) for w in insults for _ in range(5)]
    labels += [1] * 300
    model = toxicity_fm.ToxicityModel(texts, labels)

    def toxic(t):
        words = toxicity_fm.words_of(t)
        return model.score(model.places(words), len(words)) >= 0.5

    assert all(toxic(text(w, w)) for w in [*insults, "dreadword"])
    assert np.mean([toxic(text()) for _ in range(300)]) < 0.02


def test_references_are_read_from_parsed_arguments(spark):
    cases = {
        '{"a": {"$ref" : "\\u00e9"}}': ["é"],
        '{"a": [{"\\u0024ref":"x\\"y"}, {"b": {"$ref":"a\\\\b"}}]}': ["a\\b", 'x"y'],
        '{"a": "{\\"$ref\\": \\"no\\"}"}': [],
        '{"a": {"$ref": "x", "more": 1}, "b": {"$ref": 5}}': [],
        '{"a": {"$ref": "x"}, "b": {"$ref": "x"}}': ["x"],
        "{broken": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", tool_calls.references(F.col("a")).alias("refs"))
    assert {r["a"]: r["refs"] for r in df.collect()} == cases
    calls = spark.createDataFrame([(1, "é", 1, "t", "{}"), (1, "y", 2, "t", '{"a": {"$ref": "\\u00e9"}}')], "conv_id long, call_id string, seq long, name string, arguments string")
    linked = {r["call_id"]: (r["level"], r["errors"]) for r in tool_calls.link_calls(calls, spark.createDataFrame([], "conv_id long, call_id string, seq long, content string"), {"t": {"a": ("object", False)}}).collect()}
    assert linked == {"é": (0, "no_result"), "y": (1, "no_result")}
