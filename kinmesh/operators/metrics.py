"""Precision, recall and F0.5 by entity, their macro averages, candidate recall and threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_truth(raw: DataFrame) -> DataFrame:
    """(s1_id, matches) of rows (s1_id, matched_entity_ids): ids split at commas, trimmed, blanks and repeats dropped."""
    ids = F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x))
    return raw.select(F.trim("s1_id").alias("s1_id"), F.array_distinct(F.filter(ids, lambda x: x != "")).alias("matches"))


def scores(tp: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    none, bad = (n_pred == 0) & (n_true == 0), tp == 0
    p, r = F.try_divide(tp, n_pred), F.try_divide(tp, n_true)
    f = 1.25 * p * r / (0.25 * p + r)
    return tuple(F.when(none, 1.0).when(bad, 0.0).otherwise(x) for x in (p, r, f))


def entity_f05(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """For each entity of the truth (s1_id, matches): precision, recall, f05; no prediction is an empty one.

    predictions: (s1_id, cand_id). Both sides are exploded and counted, so no array of predictions is collected.
    """
    true = truth.select("s1_id", F.explode("matches").alias("cand_id"))
    pred = predictions.select("s1_id", "cand_id").distinct()
    tp = pred.join(true, ["s1_id", "cand_id"]).groupBy("s1_id").agg(F.count("*").alias("tp"))
    n = pred.groupBy("s1_id").agg(F.count("*").alias("n_pred"))
    rows = truth.join(n, "s1_id", "left").join(tp, "s1_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select(*[c for c in truth.columns if c != "matches"], F.size("matches").alias("n_true"), zero("n_pred").alias("n_pred"), zero("tp").alias("tp"))
    p, r, f = scores(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return rows.select("*", p.alias("precision"), r.alias("recall"), f.alias("f05"))


def macro(entities: DataFrame, *by: str) -> DataFrame:
    """Averages over entities, by columns if any are named."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    single = F.col("n_true") == 0
    grouped = entities.groupBy(*by) if by else entities
    return grouped.agg(
        zero(F.avg("precision")).alias("macro_precision"),
        zero(F.avg("recall")).alias("macro_recall"),
        zero(F.avg("f05")).alias("macro_f05"),
        F.count("*").alias("total_entities"),
        F.count(F.when(single, 1)).alias("singleton_count"),
        F.coalesce(F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))), F.lit(1.0)).alias("singleton_accuracy"),
    )


def f05_rollup(entities: DataFrame) -> DataFrame:
    """Macro F0.5 by country and overall (country ALL)."""
    rows = entities.rollup("country").agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("total_entities"), F.grouping("country").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("country")).alias("country"), "macro_f05", "total_entities")


def candidate_recall(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Share of true pairs among candidates, and mean candidates of an entity of the truth."""
    true = truth.select("s1_id", F.explode("matches").alias("cand_id"))
    found = true.join(cands.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi").agg(F.count("*").alias("found"))
    total = true.agg(F.count("*").alias("total"))
    held = cands.join(truth.select("s1_id"), "s1_id", "left_semi").agg(F.count("*").alias("held"))
    n = truth.agg(F.count("*").alias("n"))
    row = found.crossJoin(total).crossJoin(held).crossJoin(n)  # of single rows
    return row.select("found", "total", F.coalesce(F.try_divide("found", "total"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("held", "n"), F.lit(0.0)).alias("mean_candidates"))


def grid(start: float = 0.70, stop: float = 0.95, step: float = 0.02) -> list[float]:
    values, i = [], 0
    while start + i * step < stop - 1e-9:
        values.append(round(start + i * step, 2))
        i += 1
    return values


def threshold_grid(truth: DataFrame, scored: DataFrame, values: list[float], margin: float = 0.02) -> DataFrame:
    """(country, threshold, macro_f05): the gate at each threshold of a short fixed list.

    truth: (s1_id, country, matches); scored: (s1_id, cand_id, p). Pairs are labelled once; each entity then adds up its
    counts for all thresholds at once.
    """
    true = truth.select("s1_id", F.explode("matches").alias("cand_id")).withColumn("hit", F.lit(1))
    p = F.round("p", 9)
    pairs = scored.select("s1_id", "cand_id", "p").join(true, ["s1_id", "cand_id"], "left")
    sums = [x for i, t in enumerate(values) for x in (F.count(F.when(p >= t, 1)).alias(f"n{i}"), F.count(F.when((p >= t) & (F.col("hit") == 1), 1)).alias(f"t{i}"))]
    counted = pairs.groupBy("s1_id").agg(F.max(p).alias("best"), *sums)
    rows = truth.join(counted, "s1_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.when(F.col("best") >= round(t + margin, 9), F.col(f"n{i}")).otherwise(0).alias("n_pred"), F.when(F.col("best") >= round(t + margin, 9), F.col(f"t{i}")).otherwise(0).alias("tp")) for i, t in enumerate(values)]))
    rows = rows.select("country", F.size("matches").alias("n_true"), each.alias("x")).select("country", "n_true", "x.*")
    f = scores(F.col("tp"), F.col("n_pred"), F.col("n_true"))[2]
    return rows.withColumn("f05", f).groupBy("country", "threshold").agg(F.avg("f05").alias("macro_f05"))


def best_thresholds(gridded: DataFrame, default: float = 0.85) -> DataFrame:
    """(country, threshold, macro_f05): the first strict maximum; the default if every score is 0."""
    by = Window.partitionBy("country").orderBy(F.desc(F.round("macro_f05", 12)), "threshold")
    top = gridded.withColumn("r", F.row_number().over(by)).filter("r = 1")
    return top.select("country", F.when(F.col("macro_f05") > 0, F.col("threshold")).otherwise(default).alias("threshold"), "macro_f05")


def guard(best: DataFrame, seen: tuple[str, ...], margin: float = 0.02) -> DataFrame:
    """The threshold of an unseen country: the largest of the seen ones and a margin."""
    return best.filter(F.col("country").isin(*seen)).agg(F.round(F.max("threshold") + margin, 2).alias("threshold"))


def overall(truth: DataFrame, scored: DataFrame, best: DataFrame, margin: float = 0.02, default: float = 0.88) -> DataFrame:
    """Macro scores over all entities at calibrated thresholds (country, threshold); other countries take the default.

    truth: (s1_id, country, matches); scored: (s1_id, cand_id, p).
    """
    limits = truth.select("s1_id", "country").join(best.select("country", "threshold"), "country", "left")
    limits = limits.select("s1_id", F.coalesce("threshold", F.lit(default)).alias("t"))
    p = F.round("p", 9)
    pairs = scored.select("s1_id", "cand_id", "p").join(limits, "s1_id")
    pairs = pairs.withColumn("best", F.max(p).over(Window.partitionBy("s1_id")))
    kept = pairs.filter((F.col("best") >= F.round(F.col("t") + margin, 9)) & (p >= F.round("t", 9)))
    return macro(entity_f05(truth, kept.select("s1_id", "cand_id")))
