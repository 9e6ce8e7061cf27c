import math
import re
from collections import Counter

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from kinmesh.llm import language_id, quality_rules
from tests.llm.helpers import EN, edge_docs, no_docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("source", ["edges", "table"])
def test_counts_equal_brute_force(spark, sf, source):
    docs = edge_docs(spark) if source == "edges" else spark.read.parquet(f"{sf}/documents.parquet")
    out = quality_rules.quality_rules(docs).select("text", *quality_rules.RESULTS).collect()
    assert len(out) == docs.count()
    for r in out:
        assert tuple(r)[1:7] == brute_rules(r["text"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])


def test_rule_bounds(spark):
    good = " ".join(f"the word{i} of note{i}" for i in range(40))
    lines = "\n".join(["the same"] * 8 + [f"the line{i} of text{i} is one{i}" for i in range(6)] + ["the same"] * 4)
    bad = [good + " #" * 40, " ".join(f"zword{i}" for i in range(90)), " ".join(f"the {'x' * 60}{i}" for i in range(60)), lines]
    out = quality_rules.quality_rules(spark.createDataFrame(rows([good, *bad]), "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, predicted int, rep string, n_tokens string"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert not any(r["base_failed"] for r in out.collect())


def test_filter_above_the_counts_is_not_copied_below(spark):
    plan = quality_rules.quality_rules(edge_docs(spark)).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_no_python_in_the_rules_plan(spark):
    assert "Python" not in quality_rules.quality_rules(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()


def test_rules_of_no_rows(spark):
    assert quality_rules.quality_rules(no_docs(spark)).count() == 0


def test_language_of_held_out_documents(spark, sf):
    out = language_id.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    held = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.95
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = language_id.train(docs)
    out = language_id.identify(docs, model)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.columns.count("score") == 1
    for r in out.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == "en" and r["score"] == 1.0
    assert language_id.identify(no_docs(spark), model).count() == 0
    nothing = language_id.train(no_docs(spark))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_score_does_not_depend_on_neighbours():
    fit = language_id.LanguageModel(["a", "b"], __import__("numpy").random.default_rng(1).normal(size=(language_id.BUCKETS + 1, 2)), __import__("numpy").zeros(2))
    fit.log_probs[-1] = 0
    alone = [language_id.score_texts(fit, [t]) for t in (EN, "zz top", "Été")]
    together = language_id.score_texts(fit, [EN, "zz top", "Été"])
    assert [a[0][0] for a in alone] == together[0]
    assert [a[1][0] for a in alone] == pytest.approx(list(together[1]))


def plain_grams(text):
    """n-grams of one to three characters of letters and single spaces, by the definition."""
    seen = Counter()
    padded = "  " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    for i in range(2, len(padded)):
        for n in (1, 2, 3):
            gram = padded[i - n + 1 : i + 1]
            if gram[-1] != " " or (n > 1 and gram[-2] != " "):
                seen[gram] += 1
    return seen


def plain_bucket(gram):
    total = 0
    for n, c in enumerate(reversed(gram), 1):
        total = (total * 0x9E3779B1 + (ord(c) + n) * 0x85EBCA77) % 2**32
    return ((total ^ (total >> 15)) * 0xC2B2AE3D % 2**32) >> 16


def test_language_scores_equal_plain_dictionaries(spark):
    texts = [("en", EN * 2), ("en", "the dog and the cat"), ("de", "der Hund und die Katze in dem Haus"), ("de", "Über die Straße, 12 Häuser!"), ("fr", "le chien et la maison"), (None, "sin idioma"), ("fr", None)]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    learned = [(k, t) for k, t in texts if k and t is not None]
    langs = sorted({k for k, _ in learned})
    counts = {k: Counter() for k in langs}
    for k, t in learned:
        for gram, n in plain_grams(t).items():
            counts[k][plain_bucket(gram)] += n
    asked = [t for _, t in texts] + ["", " 12 ", "ein Haus", "a", "İstanbul ΟΔΟΣ", "the 😀 cat\n\tof"]
    got = language_id.score_texts(model, asked)
    for t, lang, score, likeness in zip(asked, *got, strict=True):
        logs = {}
        for k in langs:
            whole = sum(counts[k].values()) + 0.5 * language_id.BUCKETS
            logs[k] = math.log(sum(x == k for x, _ in learned) / len(learned)) + sum(n * math.log((counts[k][plain_bucket(g)] + 0.5) / whole) for g, n in plain_grams(t).items())
        best = max(langs, key=lambda k: (logs[k], [-ord(c) for c in k]))
        want = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        if not any(c.isalpha() for c in t or ""):
            best, want = "und", 0.0
            assert likeness == 0
        else:
            mean = lambda grams, k, whole: sum(n * math.log((counts[k][plain_bucket(g)] + 0.5) / whole) for g, n in grams.items()) / sum(grams.values())
            whole = sum(counts[best].values()) + 0.5 * language_id.BUCKETS
            typical = sum(n * math.log((n + 0.5) / whole) for n in counts[best].values()) / sum(counts[best].values())
            assert likeness == pytest.approx(mean(plain_grams(t), best, whole) - typical)
        assert lang == best and score == pytest.approx(want)


def test_other_languages_are_unlike_all_that_were_learned(spark, sf):
    """The posterior of a text in a language that was not learned may be 1; its likeness is low at any length."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    own = [r["text"] for r in docs.filter("lang is not null and size(split(text, ' ')) >= 50").collect()]
    least = min(language_id.score_texts(model, own)[2])
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. "
    for text in (polish, polish * 40, russian, russian * 40):
        _, score, likeness = language_id.score_texts(model, [text])
        assert likeness[0] < corpus_pipeline.LEAST_LIKENESS < least

def test_language_of_a_long_text_by_slices(monkeypatch):
    text = "".join(chr(97 + i * i % 23) + " " * (i % 5 == 0) for i in range(3000)) + "Ünd ΟΔΟΣ"
    whole = language_id.sparse_row(text)
    for size in (2, 64, 999):
        monkeypatch.setattr(language_id, "SLICE", size)
        at, n, lettered = language_id.sparse_row(text)
        assert (at == whole[0]).all() and (n == whole[1]).all() and lettered
