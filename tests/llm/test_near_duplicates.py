import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from kinmesh.llm import common, jaccard_join, quality_rules
from kinmesh.llm.components import components
from tests.llm.helpers import SCHEMA, edge_docs, no_docs, rows
from tests.llm.test_rules_and_languages import brute_rules
from tests.llm.test_tokens import check_packed, reference


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(docs):
    """(class_id, n_links) by position."""
    sets = [shingle_set(t) for _, t in docs]
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    common = Counter(p for held in inverted.values() for p in itertools.combinations(held, 2))
    root, links = list(range(len(docs))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), c in common.items():
        if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)].append(doc_id)
    return [(min((x for x in least[find(i)] if x is not None), default=None), links[i]) for i in range(len(docs))]


def check(spark, docs):
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, *c) for (d, _), c in zip(held, brute_classes(held), strict=True))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect())
    assert got == want


def test_classes_equal_brute_force_on_edges(spark):
    check(spark, edge_docs(spark))
    assert jaccard_join.classes(no_docs(spark)).count() == 0


def test_classes_equal_brute_force_on_a_table(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def families(n, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_a_large_group_is_dealt_into_blocks_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WHOLE", 100)
    texts = families(250) + families(20, 2) + ["one two", "one two"]
    check(spark, spark.createDataFrame(rows(texts), SCHEMA).repartition(4))


def test_one_of_each(spark):
    docs = edge_docs(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = {c for (_, t), (c, _) in zip(held, brute_classes(held), strict=True) if t and t.split()}
    worded = [r for r in kept.collect() if r["text"] and r["text"].split()]
    assert len(worded) == len(classes) + sum(1 for (d, t), (c, n) in zip(held, brute_classes(held), strict=True) if c is None and t and t.split()) - (None in classes)
    assert kept.count() - len(worded) == sum(1 for _, t in held if not (t and t.split()))


def test_prefixes_are_shortened_where_the_trie_is_sparse_until_the_recall_holds():
    rng = np.random.default_rng(3)
    depths = jaccard_join.DEPTH - jaccard_join.SHORTEST + 1
    crowding = np.sort(rng.integers(0, 12, (50, jaccard_join.TREES, depths)), axis=2)  # shorter prefixes are met by more
    crowding[:, :8, 1:] = 15  # eight crowded trees
    crowding[0] = 0
    length = jaccard_join.prefix_lengths(crowding)
    recall = 1 - np.prod(1 - 0.8 ** length.astype(float), axis=1)
    assert (recall >= jaccard_join.RECALL).all()
    assert (length[1:, :8] == jaccard_join.DEPTH).all() and (length[1:, 8:] < jaccard_join.DEPTH).any(axis=1).all()
    # no longer than needed: one step less in the tree shortened last would miss the target
    for own in length[1:]:
        at = own[8:].argmin() + 8
        less = own.astype(float).copy()
        less[at] += 1
        assert 1 - np.prod(1 - 0.8**less) < jaccard_join.RECALL + 1e-4
    assert len({tuple(x) for x in length}) > 1


def test_slices_of_a_long_text_are_the_whole(monkeypatch):
    text = " ".join(f"w{i % 977} {'y' * (i % 13)}" for i in range(4000)).encode()
    whole = jaccard_join._sign([text, None, b"", b"a b"])
    first = set(jaccard_join.shingles([text.split()])[0].tolist())
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 700)
    monkeypatch.setattr(common, "CHUNK_BYTES", 700)
    parts = jaccard_join._sign([text, None, b"", b"a b"])
    assert whole[0] == parts[0] and (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()
    assert first == {x for words, _ in jaccard_join.word_lists(text) for x in jaccard_join.shingles([words])[0].tolist()}
    giant = b"x" * 3000 + b" " * 2000 + b"y z"
    assert [w for w, _ in jaccard_join.word_lists(giant)] == [[b"x" * 3000, b"y", b"z"]]


def test_pairs_of_many_sets_equal_plain_counting():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 5000, rng.integers(0, 200)).astype(np.uint64)) for i in range(150)]
    common = jaccard_join._common(sets)
    for i, j in itertools.combinations(range(150), 2):
        assert common[i, j] == common[j, i] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "jaccard_join", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_rules"](spark, docs, sf)
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == columns
    assert kept <= {i for i, t in text_of.items() if not brute_rules(t)[5]}
    assert kept == {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    second = stage["language_id"](spark, first, sf)
    assert second.columns == columns and second.count() >= 0.98 * len(kept)
    third = stage["jaccard_join"](spark, second, sf)
    held = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert third.columns == columns
    left = {r["doc_id"] for r in third.collect()}
    assert left == {c for c, _ in brute_classes(held)}
    check_packed(corpus_pipeline.run(spark, sf).collect(), {i: [[*reference(text_of[i]), 1]] for i in left})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_edges(spark, sf, name, stage):
    for docs in (edge_docs(spark), no_docs(spark)):
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        out.collect()
