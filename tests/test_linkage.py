import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmesh import queries as linkage
from kinmesh.operators import blocking, boosting, features, matching, metrics, models, records, sampling
from kinmesh.plans import pipeline
from kinmesh.settings import Settings
from kinmesh.sources import files

SCHEMA = "entity_id string, name string, address string, country string"
S1 = [("S1-1", "Acme Pumps Ltd", "12 Mill St, Okhla", "India"), ("S1-2", "Solo Bakery", "9 Quiet Rd", "US"), ("S1-3", "Boreal Boreal Inc", None, "US"), ("S1-4", "Nowhere", "x", "Atlantis")]
S2 = [("S2-1", "ACME Pumps Private Limited", "12 Mill Street Okhla", "India"), ("S2-2", "Acme Pumps", "null", "US"), ("S2-3", "Boreal", "77 Pine Ave", "US"), ("S3-1", "Acme Pumps Ltd", "12, Mill St. Okhla", "India")]


def frames(spark):
    return spark.createDataFrame(S1, SCHEMA), spark.createDataFrame(S2, SCHEMA)


def python_keys(r):
    keys = []
    for t in r["name_root"].split():
        if len(t) >= 3 and t not in blocking.NAME_STOP_WORDS:
            keys.append(("n_" + t, 3))
    w = r["name_clean"].split()
    if len(w) >= 2:
        keys.append((f"n2_{w[0]}_{w[1]}", 4))
    elif len(w) == 1 and len(w[0]) >= 3:
        keys.append(("n1_" + w[0], 1))
    if len(r["name_compact"]) >= 6:
        keys.append(("cp_" + r["name_compact"][:8], 3))
    return keys + [("num_" + n, 1) for n in r["addr_nums"]] + [("aw_" + a, 2) for a in r["addr_words"][:4]]


@pytest.mark.parametrize("most", [25_000, 3, 1])
def test_candidates_equal_brute_force(spark, most):
    s1, s2 = frames(spark)
    q, t = records.normalise(s1), records.normalise(s2)
    got = {(r["s1_id"], r["cand_id"]): (r["score"], r["rank"], r["top_score"]) for r in blocking.candidates(q, t, 2, most).collect()}
    posts = [(x["country"], k, x["entity_id"]) for x in t.collect() for k, _ in python_keys(x)]
    count = {}
    for c, k, _ in posts:
        count[c, k] = count.get((c, k), 0) + 1
    want = {}
    for x in q.collect():
        votes = {}
        for k, w in python_keys(x):
            for c, k2, i in posts:
                if (c, k2) == (x["country"], k) and count[c, k] <= most:
                    votes[i] = votes.get(i, 0) + w
        best = sorted(votes.items(), key=lambda v: (-v[1], v[0]))[:2]
        want |= {(x["entity_id"], i): (v, r, best[0][1]) for r, (i, v) in enumerate(best)}
    assert got == want


def test_registered_queries_keep_frequent_keys_and_train_whole_models(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    index, kept = (linkage.queries()[n](spark, sf) for n in ("inverted_index", "posting_prune"))
    assert index.groupBy("country", "key").agg(F.sum("mult").alias("n")).agg(F.max("n")).first()[0] > 20
    assert kept.count() == index.count()  # no key of this table is above 25,000
    asked = []

    def trained(data, trees=models.TREES):
        asked.append([(g.trees, g.depth, g.rate) for g in models.growths(trees)])
        raise InterruptedError

    monkeypatch.setattr(models, "train_ensemble", trained)
    for name in ("train_gbt", "ensemble_score", "feature_importance"):
        with pytest.raises(InterruptedError):
            linkage.queries()[name](spark, sf)
    assert asked == [[(400, 6, 0.08)] * 2] * 3


def test_repeats_multiply(spark):
    s1 = spark.createDataFrame([("S1-1", "boreal boreal", "", "US")], SCHEMA)
    s2 = spark.createDataFrame([("S2-1", "boreal boreal boreal", "", "US")], SCHEMA)
    r = blocking.candidates(records.normalise(s1), records.normalise(s2)).first()
    assert r["score"] == 2 * 3 * 3 + 4 + 3


def test_features_have_their_order_and_range(spark):
    s1, s2 = frames(spark)
    _, pairs = pipeline.candidate_pairs(s1, s2, Settings())
    out = features.pair_features(pairs)
    assert out.columns == ["s1_id", "cand_id", *features.FEATURES] and len(features.FEATURES) == 42
    rows = {(r["s1_id"], r["cand_id"]): r for r in out.collect()}
    same = rows["S1-1", "S3-1"]
    assert same["n_fuzz"] == same["a_fuzz"] == same["num_exact"] == same["a_jaccard"] == 1 and same["is_source2"] == 0
    bare = rows["S1-3", "S2-3"]
    assert bare["has_a2"] == 1 and bare["num_overlap"] == 0.5 and bare["word_overlap"] == 0.5 and bare["first_match"] == 1
    assert all(0 <= r[c] <= 1 for r in rows.values() for c in features.FEATURES if c not in ("len_diff", "w_diff", "b_rank"))


def test_null_address_of_a_target(spark):
    q = records.normalise(spark.createDataFrame([("S1-1", "Acme Pumps", "NULL.", "US")], SCHEMA))
    t = records.normalise(spark.createDataFrame([("S2-1", "Acme Pumps", "NULL.", "US")], SCHEMA))
    pair = features.pairs(blocking.candidates(q, t), q, t)
    assert features.set_features(pair).first()["has_a2"] == 0
    assert matching.rule_score(pair).first()["p"] == pytest.approx(0.9)


def test_rule_and_gates(spark):
    linked = pipeline.link(*frames(spark))
    kept = {(r["s1_id"], r["cand_id"]) for r in linked.kept.collect()}
    assert kept >= {("S1-1", "S2-1"), ("S1-1", "S3-1")} and not any(a in ("S1-2", "S1-4") for a, _ in kept)
    rows = {r["source1_entity_id"]: r["matched_entity_ids"] for r in linked.match_rows().collect()}
    assert set(rows) == {"S1-1", "S1-2", "S1-3", "S1-4"} and rows["S1-2"] == ""
    assert set(matching.validate(linked.match_rows(), linked.candidate_rows(), linked.queries, frames(spark)[1]).first()) == {0}
    scored = spark.createDataFrame([("a", "x", 0.95, "US"), ("a", "y", 0.94, "US"), ("b", "x", 0.95, "US"), ("c", "x", 0.97, "other")], "s1_id string, cand_id string, p double, country string")
    got = {(r["s1_id"], r["cand_id"]) for r in matching.ensemble_gate(scored, {"US": 0.93}, 0.96).collect()}
    assert got == {("a", "x"), ("a", "y"), ("b", "x")}
    both = scored.withColumns({"p_model": F.lit(0.9), "p_rule": F.lit(0.8)})
    assert matching.hybrid(both).count() == 0 and matching.hybrid(both, 0.83).count() == 4


def test_rule_bounds_are_met_by_similarities_that_equal_them(spark):
    rows = [(0.95 * (10 / 19), 1.0), (1.0, 0.95 * (18 / 19)), (0.499, 1.0), (1.0, 0.899)]  # the first two are 0.5 and 0.9 but for their last bits
    assert rows[0][0] < 0.5 and rows[1][1] < 0.9
    pairs = spark.createDataFrame(rows, "name double, addr double")
    got = [r[0] for r in pairs.select(matching.combine(F.col("name"), F.col("addr"), F.lit(True))).collect()]
    assert got == pytest.approx([0.75, 0.95, 0.6 * 0.499 + 0.4, 0.6 + 0.4 * 0.899])


def test_country_filter_and_validation_finds_faults(spark):
    s1, s2 = frames(spark)
    linked = pipeline.link(s1, s2, country="India")
    assert [r["source1_entity_id"] for r in linked.match_rows().collect()] == ["S1-1"]
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1,S9-9")], "source1_entity_id string, matched_entity_ids string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_ids string")
    assert matching.validate(bad, cands, s1, s2).first().asDict() == {"missing_rows": 3, "repeated_rows": 0, "not_candidates": 1, "unknown_ids": 1, "repeated_ids": 1}


def test_metric(spark):
    truth = spark.createDataFrame([("a", ["S2-00047", "S3-00812"]), ("b", []), ("c", []), ("d", ["x"])], "s1_id string, matches array<string>")
    pred = spark.createDataFrame([("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812"), ("c", "y"), ("z", "q")], "s1_id string, cand_id string")
    rows = {r["s1_id"]: r for r in metrics.entity_f05(truth, pred).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"]) == (pytest.approx(2 / 3), 1) and rows["a"]["f05"] == pytest.approx(0.7142857)
    assert [rows[k]["f05"] for k in "bcd"] == [1, 0, 0]
    m = metrics.macro(metrics.entity_f05(truth, pred)).first()
    assert (m["total_entities"], m["singleton_count"], m["singleton_accuracy"]) == (4, 2, 0.5) and m["macro_f05"] == pytest.approx(1.7142857 / 4)
    empty = metrics.macro(metrics.entity_f05(truth.limit(0), pred)).first()
    assert empty["macro_f05"] == 0 and empty["singleton_accuracy"] == 1


def test_threshold_grid(spark):
    truth = spark.createDataFrame([("a", "US", ["x"]), ("b", "US", []), ("c", "IN", [])], "s1_id string, country string, matches array<string>")
    scored = spark.createDataFrame([("a", "x", 0.9), ("b", "y", 0.8)], "s1_id string, cand_id string, p double")
    assert metrics.grid() == [round(0.7 + 0.02 * i, 2) for i in range(13)] and metrics.grid(0.4, 0.85, 0.05)[-1] == 0.8
    best = {r["country"]: r["threshold"] for r in metrics.best_thresholds(metrics.threshold_grid(truth, scored, metrics.grid())).collect()}
    assert best == {"US": 0.8, "IN": 0.7}
    rows = spark.createDataFrame([("US", 0.94, 1.0), ("India", 0.9, 1.0), ("FR", 0.99, 1.0)], "country string, threshold double, macro_f05 double")
    assert metrics.guard(rows, ("US", "India")).first()[0] == 0.96


def test_samples(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(50)], "s1_id string")
    split = sampling.train_split(ids, 20)
    assert split.filter("is_train").count() == 20 and split.repartition(7).filter("is_train").count() == 20
    cands = spark.createDataFrame([("a", f"c{i}", i) for i in range(6)], "s1_id string, cand_id string, rank int")
    truth = spark.createDataFrame([("a", ["c5"])], "s1_id string, matches array<string>")
    assert sorted(r["cand_id"] for r in sampling.hard_negatives(sampling.pair_labels(cands, truth)).collect()) == ["c0", "c1", "c2", "c5"]


def test_files(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tname\taddress\tcountry\nS1-1\tA "quoted" x\t\tUS\textra\nS1-2\tshort\nS1-3\tb\tc\t\n S1-4\td\te\tFR \n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_records(spark, str(path)).orderBy("entity_id").collect()]
    assert rows == [("S1-1", 'A "quoted" x', "", "US"), ("S1-4", "d", "e", "FR")]
    assert [r[0] for r in files.read_records(spark, str(path), "FR").collect()] == ["S1-4"]
    gt = tmp_path / "gt.tsv"
    gt.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2,,S2-1\nS1-2\t\n", encoding="utf-8")
    assert {r["s1_id"]: r["matches"] for r in metrics.parse_truth(files.read_truth(spark, str(gt))).collect()} == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}
    files.write_tsv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"))
    assert files.read_records(spark, str(tmp_path / "out")).count() == 2 and files.read_records_fast(spark, str(tmp_path / "out")).count() == 2
    files.write_thresholds(spark, {"US": 0.9}, str(tmp_path / "t"))
    assert files.read_thresholds(spark, str(tmp_path / "t")) == {"US": 0.9}
    assert matching.merge_thresholds({"US": 0.9}) == {"US": 0.9, "India": 0.94, "France": 0.96}


def test_files_keep_the_last_truth_and_count_repeated_ids_once(spark, tmp_path):
    gt = tmp_path / "gt.tsv"
    gt.write_text("source1_entity_id\tmatched_entity_ids\na\tx\nb\ty\na\tz, w\n", encoding="utf-8")
    assert {r["s1_id"]: sorted(r["matches"]) for r in metrics.parse_truth(files.read_truth(spark, str(gt))).collect()} == {"a": ["w", "z"], "b": ["y"]}
    s1, s2 = frames(spark)
    doubled = s1.unionByName(s1.withColumn("name", F.lit("Zzz")))
    linked = pipeline.link(doubled, s2.unionByName(s2))
    assert {r["source1_entity_id"] for r in linked.match_rows().collect()} == {r[0] for r in S1} and linked.match_rows().count() == len(S1)
    assert set(matching.validate(linked.match_rows(), linked.candidate_rows(), linked.queries, s2).first()) == {0}
    assert linked.match_rows().orderBy("source1_entity_id").collect() == pipeline.link(s1, s2).match_rows().orderBy("source1_entity_id").collect()


def test_target_names_are_cleaned_twice_for_features_only(spark):
    q = records.normalise(spark.createDataFrame([("S1-1", "Null Null", "1 Mill Mill", "US")], SCHEMA))
    t = records.normalise(spark.createDataFrame([("S2-1", "NULL.", "1 Mill Mill", "US")], SCHEMA))
    pair = features.pairs(blocking.candidates(q, t), q, t)
    row = features.pair_features(pair).first()
    assert pair.first()["t_name_clean"] == "null" and row["n_fuzz"] == row["root_fuzz"] == row["n_jaccard"] == row["compact_sub"] == 0
    assert row["len_diff"] == len("null null") and matching.rule_score(pair).first()["p"] > 0.9


def test_distractors_are_capped_by_source(spark):
    targets = spark.createDataFrame([(f"S{2 + i % 2}-{i:03}", "n", "a", "US") for i in range(60)], SCHEMA)
    needed = spark.createDataFrame([("S2-004",), ("S3-005",)], "cand_id string")
    got = [r["entity_id"] for r in sampling.distractors(targets, needed, percent=100, most=7).collect()]
    assert len(got) == len(set(got)) == 16 and {"S2-004", "S3-005"} <= set(got) and sum(x.startswith("S2-") for x in got) == 8


def naive_stump(x, y, l2):
    """The best first split by trying every cut of every feature, and its leaf values."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    best = max(((score(x[:, f] <= c) + score(x[:, f] > c) - score(x[:, f] < np.inf), -f, -c) for f in range(x.shape[1]) for c in boosting.edges_of(x)[f]), key=lambda s: s)
    f, c = -best[1], -best[2]
    left = x[:, f] <= c
    return f, c, *(-0.08 * g[m].sum() / (h[m].sum() + l2) for m in (left, ~left))


@pytest.mark.parametrize("symmetric", [True, False])
def test_boosting_equals_a_naive_first_split_and_learns(symmetric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 1] > 0.2) ^ (x[:, 2] > 0.5)).astype(float)
    growth = boosting.Growth(symmetric, 1, depth=1, leaves=2, l2=5.0)
    tree = boosting.fit(x, y, growth).trees[0]
    f, c, left, right = naive_stump(x, y, 5.0)
    assert (tree.feature[0], tree.threshold[0]) == (f, pytest.approx(c))
    assert (tree.value[tree.left[0]], tree.value[tree.right[0]]) == (pytest.approx(left), pytest.approx(right))
    model = boosting.fit(x, y, boosting.Growth(symmetric, 60, least_rows=1 if symmetric else 5))
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.97 and np.argsort(model.gains)[-2:].tolist() in ([1, 2], [2, 1])
    again = boosting.Boosted.of_dict(json.loads(json.dumps(model.as_dict())))
    assert (again.probability(x) == model.probability(x)).all()
    assert boosting.fit(x, np.ones(300), growth).probability(x).min() > 0.99 and boosting.fit(x[:0], y[:0], growth).probability(x).tolist() == [0.5] * 300


def test_probabilities_of_the_models_are_golden(spark):
    """What both models of three trees say of four pairs that differ in one feature each."""
    rows = [(f"S1-{i}", f"S2-{i}", int(i % 3 == 0), *[float((i * (j + 3)) % 7) / 7 if j else float(i % 3 == 0) for j in range(len(features.FEATURES))]) for i in range(90)]
    data = spark.createDataFrame(rows, ["s1_id", "cand_id", "label", *features.FEATURES])
    first, second = models.train_ensemble(data, trees=3)
    same = models.train_ensemble(data.orderBy(F.desc("cand_id")).repartition(5), trees=3)
    assert [m.as_dict() for m in same] == [first.as_dict(), second.as_dict()]
    assert first.trees[0].feature[0] == 0
    p = {r["label"]: r["p"] for r in models.ensemble_score(data, [first]).collect()}
    z = math.log(1 / 2)
    want = {}
    for label in (0, 1):
        raw = {k: z for k in (0, 1)}
        for _ in range(3):  # all rows of a label are alike in the only feature that matters
            for k, n in ((0, 60), (1, 30)):
                q = 1 / (1 + math.exp(-raw[k]))
                raw[k] -= 0.08 * n * (q - k) / (n * q * (1 - q) + 5)
        want[label] = 1 / (1 + math.exp(-raw[label]))
    if all(t.feature.count(-1) == 2 for t in first.trees):
        assert p == pytest.approx(want)
    else:
        assert p[0] < 1 / 3 < p[1]


def test_commands(spark, tmp_path, capsys):
    from kinmesh.__main__ import main

    s1 = [(f"S1-{i}", f"Alpha{i} Works {i}", f"{i + 10} Mill St", "US" if i % 2 else "India") for i in range(30)]
    s2 = [(f"S{2 + i % 2}-{i}", f"Alpha{i} Works {i}" if i % 3 else f"Other{i} Works", f"{i + 10} Mill St", "US" if i % 2 else "India") for i in range(30)]
    paths = []
    for n, rows in ((1, s1), (2, [r for r in s2 if r[0][1] == "2"]), (3, [r for r in s2 if r[0][1] == "3"])):
        paths.append(str(tmp_path / f"s{n}.tsv"))
        (tmp_path / f"s{n}.tsv").write_text("entity_id\tname\taddress\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))
    gt = tmp_path / "gt.tsv"
    gt.write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{s2[i][0] if i % 3 else ''}\n" for i in range(30)))
    out = str(tmp_path / "out")
    assert main([*paths, out, "--model", str(tmp_path / "missing")]) == 0  # no model: the rule decides
    assert "entities" in capsys.readouterr().out
    assert main(["validate", *paths, f"{out}/matching_results.tsv", f"{out}/candidate_pairs.tsv"]) == 0
    assert main(["validate", *paths, f"{out}/candidate_pairs.tsv", f"{out}/matching_results.tsv"]) == 1
    assert main(["evaluate", *paths, str(gt)]) == 0
    assert "macro f05" in capsys.readouterr().out
    assert main(["train", *paths, str(gt), out, "--entities", "15", "--trees", "5"]) == 0
    assert "France" in capsys.readouterr().out
    assert main(["link", *paths, out + "2", "--model", f"{out}/model", "--thresholds", f"{out}/thresholds"]) == 0
    assert main(["split", *paths, str(gt), out + "3", "--size", "10"]) == 0
    assert files.read_records(spark, out + "3/source1.tsv").count() == 10
    assert metrics.parse_truth(files.read_truth(spark, out + "3/ground_truth.tsv")).count() == 10


def test_train_save_load_and_stream(spark, tmp_path):
    s1 = spark.createDataFrame([(f"S1-{i}", f"Alpha{i} Works {i}", f"{i + 10} Mill St", "US") for i in range(30)], SCHEMA)
    s2 = spark.createDataFrame([(f"S2-{i}", f"Alpha{i} Works {i}" if i % 3 else f"Other{i} Works", f"{i + 10} Mill St", "US") for i in range(30)], SCHEMA)
    truth = s1.select(F.col("entity_id").alias("s1_id"), "country", F.expr("if(cast(substr(entity_id, 4) as int) % 3 <> 0, array(concat('S2-', substr(entity_id, 4))), cast(array() as array<string>))").alias("matches"))
    ensemble, best = pipeline.train_and_calibrate(s1, s2, truth, 15, trees=100)
    assert [r["country"] for r in best.collect()] == ["US"]
    models.save(spark, ensemble, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    linked = pipeline.link(s1, s2, again, Settings(thresholds={"US": 0.5}))
    assert pipeline.evaluate(truth, linked).first()["macro_f05"] > 0.8
    assert models.feature_importance(again[0], spark).count() == 10
    from kinmesh.streaming.match import link_stream

    s1.write.parquet(str(tmp_path / "in"))
    seen = []
    q = link_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), s2, lambda linked, n: seen.append(linked.match_rows().count()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 30


@pytest.mark.parametrize("symmetric", [True, False])
def test_boosting_sums_equal_rows_once(symmetric, monkeypatch):
    rng = np.random.default_rng(3)
    few = rng.normal(size=(30, 4)).round(2)
    x, y = np.repeat(few, 50, axis=0), np.tile(np.repeat([0.0, 1.0], [20, 30]), 30)
    y[x[:, 0] > 0.5] = 1.0
    sizes, own = [], boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda binned, *rest: sizes.append(max(binned.shape)) or own(binned, *rest))
    model = boosting.fit(x, y, boosting.Growth(symmetric, 5, depth=2, leaves=4, rows=1.0 if symmetric else 0.8))
    assert max(sizes) <= 2 * len(few)
    f, c, *_ = naive_stump(x, y, 5.0)
    if symmetric:
        first = boosting.fit(x, y, boosting.Growth(True, 1, depth=1)).trees[0]
        assert (first.feature[0], first.threshold[0]) == (f, pytest.approx(c))
    assert len(model.trees) == 5


def test_validator_takes_candidates_as_pairs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    matches = spark.createDataFrame([("S1-1", "S2-1,S2-2,S2-2"), ("S1-2", "S3-9"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    rows = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "S3-9")], "source1_entity_id string, candidate_entity_ids string")
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S3-9")], "source1_entity_id string, id string")
    found = [matching.validate(matches, c, ids("S1-1", "S1-2", "S1-3"), ids("S2-1", "S2-2", "S3-1")).first() for c in (rows, pairs)]
    assert found[0] == found[1] and tuple(found[0]) == (1, 1, 2, 1, 1)
