import random

import numpy as np
import pyarrow as pa
import pytest

from kinmesh import queries as linkage
from kinmesh.operators import blocking, records, voting

SCHEMA = "entity_id string, name string, address string, country string"
KEYS = pa.list_(pa.struct([("key", pa.string()), ("weight", pa.int32()), ("mult", pa.int64())]))


def block(rows):
    kinds, ids, keys = zip(*rows, strict=True)
    made = [[{"key": k, "weight": w, "mult": m} for k, w, m in x] for x in keys]
    return pa.table({"kind": pa.array(kinds, pa.int8()), "id": pa.array(ids), "keys": pa.array(made, KEYS)})


@pytest.mark.parametrize("k", [1, 3, 25, None])
@pytest.mark.parametrize("scale", [1, 2**20])
def test_a_block_equals_brute_force(k, scale):
    r = random.Random(7)
    some = lambda n: [(f"k{i}", 1 + i % 4, scale * r.choice([1, 1, 1, 2])) for i in r.sample(range(12), n)]
    rows = [(voting.TARGET, f"t{r.randrange(40)}", some(r.randrange(1, 5))) for _ in range(60)]  # some ids come twice
    rows += [(voting.QUERY, f"q{i}", some(r.randrange(1, 6))) for i in range(20)] + [(voting.QUERY, "q3", some(3)), (voting.QUERY, "same", [("k1", 2, 1)]), (voting.QUERY, "copy", [("k1", 2, 1)])]
    rows += [(voting.PRUNED, "", [("k5", 2, 99)])]
    r.shuffle(rows)
    votes = {}
    for kind, q, asked in rows:
        for other, t, held in rows:
            if (kind, other) == (voting.QUERY, voting.TARGET):
                for key, w, m in asked:
                    for key2, _, m2 in held:
                        if key == key2 != "k5":
                            votes[q, t] = votes.get((q, t), 0) + w * m * m2
    want = []
    for q in {q for q, _ in votes}:
        best = sorted(((-v, t) for (x, t), v in votes.items() if x == q))
        want += [(q, t, -v) for v, t in (best if k is None else best[:k])]
    got = [tuple(x.values()) for t in voting.block_votes(block(rows), k) for x in t.to_pylist()]
    assert sorted(got) == sorted(want)


def test_best_places_take_the_first_of_equal_numbers():
    assert voting.best_places(np.array([0, 2, 9, 2, 2, 0]), 3).tolist() == [2, 1, 3]
    assert voting.best_places(np.array([1, 0, 3]), 5).tolist() == [2, 0] and voting.best_places(np.zeros(3, int), 2).tolist() == [] and voting.best_places(np.zeros(0, int), 2).tolist() == []


def test_candidates_of_many_blocks_equal_the_key_join_and_make_no_rows_of_votes(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("alder birch cedar elm fir hazel larch maple oak pine".split()) for _ in range(n))
    rows = [(f"S{1 + i % 3}-{i}", text(3), text(3), r.choice(["US", "FR", None])) for i in range(240)]
    norm = records.normalise(spark.createDataFrame(rows, SCHEMA))
    q, t = norm.filter("entity_id like 'S1-%'"), norm.filter("entity_id not like 'S1-%'")
    for name, n in (("BLOCK_QUERIES", 9), ("BLOCKS", 1000), ("BLOCK_TARGETS", 13)):
        monkeypatch.setattr(blocking, name, n)
    for most in (25_000, 20):
        got = blocking.candidates(q, t, 4, most)
        want = blocking.top_k(blocking.votes(q, blocking.prune(blocking.inverted_index(t), most)), 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert blocking.votes_in_blocks(q, t, most).exceptAll(blocking.votes(q, blocking.prune(blocking.inverted_index(t), most))).count() == 0
    plan = blocking.candidates(q, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not any("Join" in line and "key#" in line for line in plan.splitlines())


def test_texts_are_scanned_once(spark, sf):
    plan = linkage.queries()["validate_output"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "doc_id#" not in plan


def test_features_are_computed_of_training_pairs_alone(spark, sf, monkeypatch):
    seen = []
    whole = linkage.X.pair_features
    monkeypatch.setattr(linkage.X, "pair_features", lambda pair: seen.append(pair.count()) or whole(pair))
    norm, found = linkage._tables(spark, sf)
    data = linkage._training(norm, found)
    assert seen == [data.count()] and seen[0] < found.count()


def test_records_are_written_with_their_keys(spark, sf):
    n = linkage._written(spark, sf)
    plan = blocking.keyed(n)._jdf.queryExecution().optimizedPlan().toString()
    assert "keys" in n.columns and "array_distinct" not in plan
    fresh = blocking.keyed(n.drop("keys"))
    assert n.count() > 0 and fresh.exceptAll(blocking.keyed(n)).count() == 0


def test_words_of_a_text_whose_head_is_too_short_are_found(spark, tmp_path):
    words = [f"w{i}" for i in range(30)]
    texts = [" \t" + "\n".join(words), " ".join(words[:14]), " ".join(words[:14]) + " ", " ".join(["x" * 300, *words]), " ".join([*words[:13], "y" * 300, "z"]), " ".join(w * 9 for w in words), "", None]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["entity_id"]: (r["name"], r["address"]) for r in linkage.D.entities(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = None if t is None else t.split()
        assert got[f"S{1 + i % 3}-{i:06d}"] == ((None, None) if w is None else (" ".join(w[:4]), " ".join(w[4:14]))), i
