import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmesh.llm import common, lm_scoring, quality_classifier, topk_search, toxicity
from tests.llm.helpers import EN, edge_docs, no_docs


def brute_base(docs, held):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for i, t in docs}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


def lm_tokens(t):
    return (t or "").encode().lower().split()


def brute_scores(docs, held):
    """log10 probability of each text by exact dictionaries: Katz back-off over counts quantised downwards."""
    floor = lambda c: (c >> (c.bit_length() - 2)) << (c.bit_length() - 2)
    pairs, c, n_docs = Counter(), Counter(), 0
    for i, t in docs:
        if not held(i):
            seq = ["<s>", *lm_tokens(t), "</s>"]
            pairs.update(itertools.pairwise(seq))
            c.update(seq[1:])
            n_docs += 1
    whole = sum(c.values()) + len(c) + 1
    followers = {}
    for (h, w), k in pairs.items():
        if k >= 2:
            followers.setdefault(h, {})[w] = floor(k) - 0.75

    def p(w, h):
        d = (n_docs if h == "<s>" else c[h]) + 2
        own = followers.get(h, {})
        if w in own:
            return own[w] / d
        return (1 - sum(own.values()) / d) / (1 - sum((c[x] + 1) / whole for x in own)) * (c[w] + 1) / whole

    known = [*c, None]  # None: the unknown kind
    return {i: sum(math.log10(p(w, h)) for h, w in itertools.pairwise(["<s>", *lm_tokens(t), "</s>"])) for i, t in docs}, p, known


def test_lm_base_and_score_equal_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_base(docs, held_out)
    scores, _, _ = brute_scores(docs, held_out)
    out = lm_scoring.op2_lm_scoring(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held_out(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(scores[r["doc_id"]], rel=1e-3)  # false positives apart
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_base_equals_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    # SQL has no crc32: the fold is taken from the query's own column, which the test above checks.
    out = lm_scoring.op2_lm_scoring(spark, sf).toPandas()
    con = duckdb.connect()
    con.register("folds", out[["doc_id", "held_out"]])
    found = con.execute(f"""
        with words as (select doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ')) w
                       from '{sf}/documents.parquet' join folds using (doc_id)),
             c as (select w, count(*) c from words where not held_out group by w),
             total as (select sum(c) n, count(*) v from c)
        select doc_id, count(*) n_tokens, count(c) n_known, any_value(n) train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) base
        from words left join c using (w), total group by doc_id""").fetchall()
    want = {r[0]: r[1:] for r in found}
    for r in out.itertuples():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)


def lm_trained(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return lm_scoring.train(lm_scoring.count(docs), len(texts), **options)


def test_lm_probabilities_sum_to_one(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    lm_scoring.short_batches(spark)
    model, filled, words = lm_trained(spark, texts, bits_per_item=64)  # practically no false positives, each of which adds mass
    _, p, known = brute_scores(list(enumerate(texts)), lambda i: False)
    held = lm_scoring.opened(model, lm_scoring.publish(model, filled, 0))
    of = {r["w"]: r for r in words.collect()}
    kinds = np.array([w for w in of if w != lm_scoring._START_HASH])
    assert len(kinds) == model.kinds == len(known) - 1
    histories = [lm_scoring.START, *{w for t in texts[:10] for w in lm_tokens(t)}, b"never seen"]
    for h in histories[:300]:
        at = lm_scoring._hashes([h])[0]
        c, alpha = (of[at]["c"], of[at]["alpha"]) if at in of else (0, 0.0)
        q = held.levels(lm_scoring.keys_of(np.full(len(kinds), at), kinds), lm_scoring.quantise(np.array([of[w]["c"] for w in kinds])))
        unigram = np.array([of[w]["c"] + 1 for w in kinds]) * 10.0**model.unit
        mass = np.where(q > 0, (lm_scoring.LEVELS[np.maximum(q, 1) - 1] - lm_scoring.DISCOUNT) / (c + lm_scoring.KAPPA), 10.0**alpha * unigram)
        assert mass.sum() + 10.0 ** (alpha + model.unit) == pytest.approx(1, abs=1e-6)
    assert sum(p("</s>" if w is None else w, "<s>") for w in known[:-1]) + p("never seen", "<s>") == pytest.approx(1, abs=1e-9)


def test_lm_knows_the_order_of_words(spark):
    texts = ["green red blue red"] * 6 + ["red blue red green", "green red blue red", "red green"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, F.col("doc_id") < 6).collect()}
    assert got[7] > got[6] + 1


def test_lm_refuses_a_filter_that_is_too_small(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lm_scoring.short_batches(spark)
    with pytest.raises(ValueError, match="too small"):
        lm_trained(spark, texts, bits_per_item=1)


def test_lm_edges(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 3)  # most words take the join
    docs = edge_docs(spark).withColumn("row", F.monotonically_increasing_id())
    rows = {r["row"]: r["text"] for r in docs.collect()}
    docs = spark.createDataFrame(list(rows.items()), "row long, text string")
    want = brute_base(list(rows.items()), lambda i: i % 2 == 1)
    for r in lm_scoring.score(docs, F.col("row") % 2 == 0, carry=("row",)).collect():
        n, known, total, base = want[r["row"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"])
    untrained = lm_scoring.score(docs, F.lit(False), carry=("row",)).collect()
    assert {r["base_score"] for r in untrained} == {0.0} and {r["n_known"] for r in untrained} == {0}
    assert lm_scoring.score(no_docs(spark), F.lit(True)).count() == 0


def test_filter_never_loses_a_count():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    counts = np.random.default_rng(2).zipf(1.5, 4000).clip(1, 10**6)
    bits = 1 << 18
    segments = []
    for s in range(lm_scoring.SEGMENTS):
        own = keys % np.uint64(lm_scoring.SEGMENTS) == s
        segments.append(lm_scoring._fill(keys[own], lm_scoring.quantise(counts[own]), bits // lm_scoring.SEGMENTS, 4))
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(b"".join(segments), dtype=np.uint8), bits // lm_scoring.SEGMENTS, 4)
    found, exact = f.levels(keys), lm_scoring.quantise(counts)
    assert (found >= exact).all() and np.mean(found == exact) > 0.9
    assert (f.levels(keys, exact) == exact).all()
    assert np.mean(f.levels(np.random.default_rng(9).integers(0, 1 << 63, 4000, dtype=np.uint64)) == 0) > 0.9


def test_filter_past_one_broadcast_gives_the_same_scores(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("doc_id") % 5 > 0).collect()}
    monkeypatch.setattr(lm_scoring, "MOST_BITS", 1 << 18)
    monkeypatch.setattr(lm_scoring, "LEAST_BITS", 1 << 14)
    lm_scoring.short_batches(spark)
    assert lm_scoring.train(lm_scoring.count(docs), docs.count())[0].parts > 1
    parted = lm_scoring.score(docs, F.col("doc_id") % 5 > 0).collect()
    assert len(parted) == len(whole)
    for r in parted:
        want = whole[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (want["n_tokens"], want["n_known"]) and r["base_score"] == pytest.approx(want["base_score"])
        assert r["score"] == pytest.approx(want["score"], rel=0.02)  # false positives apart


def test_slices_of_a_long_text_give_the_same_tokens(monkeypatch):
    text = " ".join(f"W{i % 97}" + " \n" * (i % 7 == 0) + " " * 200 * (i % 900 == 0) for i in range(5000)).encode()
    seen = lambda: Counter((w[h], w[t]) for w, hs, ts, _ in lm_scoring.runs([text, None, b""]) for h, t in zip(hs, ts, strict=True))
    whole = seen()
    for most, together in ((300, 1000), (50, 50), (1000, 300)):
        monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", most)
        monkeypatch.setattr(lm_scoring, "TOGETHER", together)
        assert seen() == whole
    assert Counter(x for _, _, _, xs in lm_scoring.runs([text, None, b""]) for x in xs.tolist()) == {0: 5001, 1: 1, 2: 1}
    assert sum(whole.values()) == 5003 and whole[lm_scoring.START, lm_scoring.END] == 2


def brute_top(vectors, queries, k=5):
    w = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in queries:
        if q in w:
            own = min(w[q])
            best = sorted(((max(sum(a * b for a, b in zip(own, x, strict=False)) for x in xs), i) for i, xs in w.items() if i != q), key=lambda s: (-s[0], s[1]))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)]) for i in range(140)]
    rows[7] = (7, rows[3][1])  # a tie
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 12), (203, [float("inf")] * 12), (None, [0.5] * 12), (204, []), (205, [0.0] * 12), rows[5], (10, rows[11][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    want = brute_top(rows, [i for i in range(0, 300, 10)])
    for block in (2048, 4):
        out = topk_search.top_k(df, F.col("vec_id") % 10 == 0, query_block=block)
        assert sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e300, -1.0]), (1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    most = topk_search.MOST
    assert [tuple(r) for r in topk_search.top_k(large, F.col("vec_id") == 0).orderBy("rank").select("vec_id", "score").collect()] == [(1, most * most - 65536), (2, -most * most - 131072)]
    alone = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(alone, F.col("vec_id") == 0).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 256 * 512)]


def toxic_texts():
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("lo", "mar", "ten", "sil", "por") for b in ("dan", "vel", "mit", "gus", "ran", "ber")]
    bad = ["idiot", "moron", "stupid", "worthless"]
    texts, labels = [], []
    for i in range(240):
        t = list(rng.choice(words, 40))
        if i % 3 == 0:
            t[int(rng.integers(40))] = str(rng.choice(bad))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_obfuscated_words_are_restored():
    texts, labels = toxic_texts()
    m = toxicity.fit(texts, labels, {0: 160, 1: 80})
    for hidden, word in (("1d10t", "idiot"), ("m0r0n!", "moron"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("m.o.r.o.n", "moron")):
        assert word in toxicity.restore(m.letters, f"lodan {hidden} marvel").split()
        assert toxicity.score_texts(m, [f"lodan marvel {hidden} tenmit"])[0][0] > toxicity.score_texts(m, ["lodan marvel tenmit"])[0][0]
    score, predicted = toxicity.score_texts(m, texts)
    assert (predicted == np.array(labels)).mean() > 0.99
    assert toxicity.restore(m.letters, None) == "" and toxicity.restore(m.letters, "1 " * 500)


def test_words_hidden_in_other_ways_are_found():
    texts, labels = toxic_texts()
    m = toxicity.fit(texts, labels, {0: 160, 1: 80})
    clean = toxicity.score_texts(m, ["lodan marvel tenmit"])[0][0]
    for hidden, word in (("mo.ron", "moron"), ("id-iot", "idiot"), ("stu_pid", "stupid"), ("st.u.pid", "stupid"), ("s  t  u  p  i  d", "stupid"), ("i . d . i . o . t", "idiot"), ("i. d. i. o. t.", "idiot"), ("stuupid", "stupid"), ("worth...less", "worthless"), ("idio7", "idiot")):
        assert word in toxicity.restore(m.letters, f"lodan {hidden} marvel").split(), hidden
        assert toxicity.score_texts(m, [f"lodan marvel {hidden} tenmit"])[0][0] > clean, hidden
    for hidden in ("stu pid", "st u pid,", "worth less"):
        assert toxicity.score_texts(m, [f"lodan {hidden} marvel tenmit"])[0][0] > 0.5, hidden
    for plain in ("lodan-marvel", "silgus.", "e-mail", "tall", "12.30", "3.5-4"):
        assert toxicity.restore_token(m.letters, plain) == [plain.strip(".")] or set(toxicity.restore_token(m.letters, plain)) <= m.letters.words
        assert toxicity.score_texts(m, [f"lodan {plain} marvel tenmit"])[0][0] < 0.5


def test_long_stretches_are_decoded_whole():
    texts, labels = toxic_texts()
    m = toxicity.fit(texts, labels, {0: 160, 1: 80})
    for lead in ("lodan lodan lodan lodan lodan", "martendan lodan marvel silgus", "silgus silgus silgus silgus silgus", "lodan silgus silgus silgus silgus"):
        spelled = " ".join(f"{lead}worthless lodan".replace(" ", ""))  # a letter near the 32nd starts or parts the word
        assert "worthless" in toxicity.restore(m.letters, spelled).split()
    hidden = "lodan" * 12 + "w0rthl3ss" + "lodan"  # the 64th sign lies in the word
    assert "worthless" in toxicity.restore(m.letters, hidden)
    assert toxicity.restore(m.letters, " ".join("lodan" * 3000 + "worthless")).endswith("worthless")


def test_models_do_not_share_what_they_remember():
    import pickle

    texts, labels = toxic_texts()
    for n in (60, 240):  # a freed model's place in memory may be taken by the next
        m = pickle.loads(pickle.dumps(toxicity.fit(texts[:n], labels[:n], {0: n - n // 3, 1: n // 3})))
        assert not m.seen
        alone = [toxicity.score_texts(m, [t])[0][0] for t in texts[:20]]
        m.seen.clear()
        assert list(toxicity.score_texts(m, texts[:20])[0]) == pytest.approx(alone)
        assert not pickle.loads(pickle.dumps(m)).seen
        del m


def test_toxicity_is_learned_alike_in_tasks_and_at_once(spark):
    texts, labels = toxic_texts()
    texts[5], texts[6] = None, "1d10t you"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    rows = sorted(((t or "", k) for t, k in zip(texts, labels, strict=True)), key=lambda x: x)
    whole = toxicity.fit([t for t, _ in rows], [k for _, k in rows], {0: labels.count(0), 1: labels.count(1)})
    tasks = toxicity.train(docs, marks, folds=7, left_out=9, per_class=10**6)
    assert tasks.letters.counts == whole.letters.counts and tasks.letters.words == whole.letters.words
    assert tasks.features == whole.features and np.allclose(tasks.weights, whole.weights) and np.allclose(tasks.alone, whole.alone)
    assert tasks.intercept == pytest.approx(whole.intercept)


def every_reading(model, token):
    """The best reading of a stretch by trying every path through its lattice."""
    best = {}
    paths = [("", 0.0)]
    for i, sign in enumerate(token):
        if sign in toxicity.FILLERS:
            options = [("", toxicity.FILLER), *([(" ", toxicity.FILLER)] if sign == " " else [])]
        else:
            options = [(sign, toxicity.SAME if sign.isalpha() else toxicity.MARKED), *((x, toxicity.LEETED) for x in toxicity.LEET.get(sign, ""))]
            if i and token[i - 1] == sign:
                options.append(("", toxicity.REPEATED))
        paths = [(read + x, score + cost + (model.log_prob(("   " + read)[-3:], x) if x else 0.0)) for read, score in paths for x, cost in options]
    for read, score in paths:
        score += model.log_prob(("   " + read)[-3:], " ")
        best[read] = max(best.get(read, -math.inf), score)
    return best


def test_decoding_equals_trying_every_path():
    texts, labels = toxic_texts()
    m = toxicity.fit(texts, labels, {0: 160, 1: 80}).letters
    rng = np.random.default_rng(8)
    asked = ["1d10t", "$tuup1d", "m.o.r.o.n", "i d i o t", "1 d i 0 t m", "((!!", "ss$", "w0r7hl3$s"]
    asked += ["".join(rng.choice(list("aid1o0t!s$ .m"), rng.integers(1, 9))) for _ in range(150)]
    for token in asked:
        best = every_reading(m, token)
        got = toxicity.decode(m, token)
        top = max(best.values())
        assert got in {r.strip() for r, s in best.items() if s == pytest.approx(top, abs=1e-9)}, token


def test_toxicity_of_held_out_documents(spark):
    texts, labels = toxic_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)) + [(None, 1), (0, None), (999, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_classifiers_edges(spark):
    docs = edge_docs(spark)
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(13)], "doc_id long, toxic int, quality int")
    for train, apply in ((toxicity.train, toxicity.score), (quality_classifier.train, quality_classifier.classify)):
        model = train(docs, marks)
        out = apply(docs, model).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["rep"] in ("x", None) for r in out)
        by_text = {}
        for r in out:
            assert by_text.setdefault(r["text"], r["score"]) == pytest.approx(r["score"])
        assert apply(no_docs(spark), model).count() == 0
        none = train(docs, marks.limit(0))
        assert max(r["score"] for r in apply(docs, none).collect()) == pytest.approx(0, abs=1e-12)


def test_passages_are_those_of_the_words():
    texts = [EN * 9, None, "", "one two\n", " x" * 130, "é ü " * 70]
    vectors, first = quality_classifier.encode(texts)
    n = [max(1, -(-len((t or "").split()) // 64)) for t in texts]
    assert list(np.diff(np.append(first, len(vectors)))) == n
    for i, t in enumerate(texts):  # neighbours do not matter
        alone, _ = quality_classifier.encode([t])
        assert np.allclose(alone, vectors[first[i] : first[i] + n[i]], atol=1e-6)
    assert np.allclose(vectors[:, :256].sum(axis=1), 1)


def naive_logit(p, bag):
    """Gated attention of one document, passage by passage."""
    hidden = [[math.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))] for x in bag]
    gate = lambda h, m, k: sum(h[j] * m[j][k] for j in range(len(h)))
    e = [sum(math.tanh(gate(h, p["V"], k)) / (1 + math.exp(-gate(h, p["U"], k))) * p["w"][k] for k in range(len(p["w"]))) for h in hidden]
    a = [math.exp(x) / sum(map(math.exp, e)) for x in e]
    return sum(sum(w * h[j] for w, h in zip(a, hidden, strict=True)) * p["c"][j] for j in range(len(p["c"]))) + p["d"][0]


def small_network(rng):
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    return {k: rng.normal(0, 0.7, shape) for k, shape in shapes.items()}


def test_attention_equals_a_naive_pass_and_numeric_gradients(monkeypatch):
    rng = np.random.default_rng(12)
    p, bags, y = small_network(rng), [rng.normal(size=(n, 5)) for n in (1, 3, 2, 6)], np.array([1.0, 0.0, 1.0, 0.0])
    x, first = np.concatenate(bags), np.array([0, 1, 4, 6])
    logits = quality_classifier._forward(p, x, first)[5]
    assert list(logits) == pytest.approx([naive_logit(p, b) for b in bags])
    monkeypatch.setattr(quality_classifier, "HIDDEN", 4)
    assert quality_classifier._forward_slices(p, iter(np.array_split(bags[3], 3))) == pytest.approx(logits[3])
    loss = lambda: np.mean([math.log1p(math.exp(-z if k else z)) for z, k in zip(quality_classifier._forward(p, x, first)[5], y, strict=True)])
    found = quality_classifier._gradients(p, x, first, y)
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            assert found[k][at] == pytest.approx((up - loss()) / 2e-6, abs=1e-6), k
            v[at] = old


def test_passages_of_a_long_text_by_slices(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [EN * 60 + "é\n\nend", "  lead " + EN * 30, " ".join("x" * int(n) for n in rng.integers(1, 90, 700)), "y" * 5000 + " z" * 3000]
    whole = [quality_classifier.encode([t])[0] for t in texts]
    for size in (300, 1000):
        monkeypatch.setattr(quality_classifier, "CHUNK_BYTES", size)
        for t, want in zip(texts, whole, strict=True):
            parts = list(quality_classifier.slices(t))
            assert len(parts) > 1 and np.allclose(np.concatenate(parts), want, atol=1e-6)


def test_sample_of_labelled_documents_is_bounded(spark):
    long = "a " * common.SAMPLE_BYTES
    docs = spark.createDataFrame([(1, EN), (1, EN), (2, long), (3, "x y"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    sample, totals = common.labelled_sample(docs, labels, "quality", 1000, 4, 9)
    assert totals == {0: 2, 1: 2} and Counter((r["text"], r["label"]) for r in sample.collect()) == {(EN, 1): 1, ("x y", 0): 1, (None, 1): 1}


def test_attention_learns_from_document_labels(spark, sf):
    out = quality_classifier.op10_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = out.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.85


def test_toxicity_counts_every_labelled_document(spark):
    """More documents than any sample that was taken, one of them long, one in parts of a task, and of an id with two labels."""
    texts, labels = toxic_texts()
    texts, labels = [f"{t} n{i % 7}" for i in range(27) for t in texts], labels * 27
    texts[1] = "lodan " * 30_000 + "idiot"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*enumerate(labels), (0, 0), (10**6, 1)], "doc_id long, toxic int")
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    learned = [i for i in range(len(texts)) if i not in set(held)]
    model = toxicity.train(docs, marks)
    whole = toxicity.fit([texts[i] for i in learned], [labels[i] for i in learned], Counter(labels[i] for i in learned) + Counter({1: zlib.crc32(b"1000000") % 5 != 0}))
    assert len(learned) > 5000 and model.letters.counts["   "]["l"] == sum(len({w for w in texts[i].split() if w[0] == "l" and w.isalpha()}) for i in learned)
    assert model.letters.counts == whole.letters.counts and model.letters.words == whole.letters.words
    assert model.features == whole.features and np.allclose(model.weights, whole.weights) and np.allclose(model.alone, whole.alone)
    score, predicted = toxicity.score_texts(model, [texts[i] for i in held])
    assert (predicted == np.array([labels[i] for i in held])).mean() > 0.99


def test_what_does_not_fit_is_left_out_by_its_count():
    assert toxicity.least_kept({5: 2, 3: 2, 1: 9}, 4) == 3 and toxicity.least_kept({5: 2, 3: 2, 1: 9}, 3) == 5
    assert toxicity.least_kept({5: 2}, 1) == 6 and toxicity.least_kept({5: 2}, 2) == toxicity.least_kept({}, 2) == 0


def test_tokens_that_no_known_word_explains_are_not_decoded(monkeypatch):
    texts, labels = toxic_texts()
    m = toxicity.fit(texts, labels, {0: 160, 1: 80}).letters
    decoded, real = [], toxicity.decode
    monkeypatch.setattr(toxicity, "decode", lambda model, token: decoded.append(token) or real(model, token))
    assert toxicity.restore_token(m, "qwzzter") == ["qwzzter"] and toxicity.restore_token(m, "xx-yyqq") == ["xx-yyqq"] and not decoded
    word = next(w for w in sorted(m.words) if not re.search(r"(.)\1", w))
    for token in (word[0] + word, word[:2] + "-" + word[2:], f"{word[:3]}{word[2:]}"):  # a known word explains these
        decoded.clear()
        found = real(m, token).split()
        assert toxicity.restore_token(m, token) == (found if found and all(w in m.words for w in found) else [token]) and decoded == [token]


def test_letter_counts_and_buckets_are_those_of_plain_counting():
    words = [("lodan", 3), ("a", 2), ("", 1), ("ññarr", 1)]
    brute = Counter()
    for w, n in words:
        padded = "   " + w + " "
        for i in range(3, len(padded)):
            for k in range(4):
                brute[padded[i - k : i], padded[i]] += n
    assert toxicity.letter_counts(words) == brute
    held = np.zeros(toxicity.BUCKETS, dtype=bool)
    held[[toxicity._bucket(f) for f in ("marv~", "marve~", "tell~", "cat", "telling", "sing~")]] = True
    assert set(toxicity._held("marvel", held.tobytes())) == {"marv~", "marve~"} and toxicity._held("cat", held.tobytes()) == ["cat"]
    assert toxicity._held("telling", held.tobytes()) == ["tell~"]  # often itself only if its beginnings are
