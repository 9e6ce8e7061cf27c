"""Inference, evaluation and calibration as plans over the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.operators import blocking, features, matching, metrics, models, records, sampling
from kinmesh.settings import Settings


@dataclass
class Linked:
    """What a run makes: candidates, scored pairs and kept pairs."""

    queries: DataFrame
    candidates: DataFrame
    scored: DataFrame
    kept: DataFrame

    def match_rows(self) -> DataFrame:
        return matching.output_rows(self.queries, self.kept)

    def candidate_rows(self) -> DataFrame:
        return matching.output_rows(self.queries, self.candidates, "candidate_entity_ids")


def once(rows: DataFrame) -> DataFrame:
    """One record of each id: the first by name, address and country."""
    found = rows.groupBy("entity_id").agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("address", F.lit("")).alias("address"), F.coalesce("country", F.lit("")).alias("country"))).alias("r"))
    return found.select("entity_id", "r.*")


def candidate_pairs(queries: DataFrame, targets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Candidates, and pairs with both sides' forms, of records whose ids do not repeat."""
    q, t = (records.normalise(x, settings.strip_domain_words) for x in (queries, targets))
    found = blocking.candidates(q, t, settings.k, settings.max_postings)
    return found, features.pairs(found, q, t)


def _decide(queries: DataFrame, found: DataFrame, pairs: DataFrame, ensemble: list | None, settings: Settings) -> Linked:
    if ensemble:
        scored = models.ensemble_score(features.pair_features(pairs), ensemble).join(found.select("s1_id", "cand_id", "rank"), ["s1_id", "cand_id"])
        scored = scored.join(queries.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
        kept = matching.ensemble_gate(scored, settings.thresholds, settings.default_threshold, settings.margin)
    else:
        scored = matching.rule_score(pairs)
        kept = matching.rule_match(scored, settings.rule_threshold, settings.rule_singleton)
    return Linked(queries, found, scored, kept)


def link(queries: DataFrame, targets: DataFrame, ensemble: list | None = None, settings: Settings = Settings(), country: str | None = None) -> Linked:
    """Links records: by the ensemble if there is one, else by the rule. A repeated id counts once on either side."""
    if country is not None:
        queries, targets = queries.filter(F.col("country") == country), targets.filter(F.col("country") == country)
    queries, targets = once(queries), once(targets)
    return _decide(queries, *candidate_pairs(queries, targets, settings), ensemble, settings)


def link_prepared(queries: DataFrame, targets: DataFrame, index: DataFrame, ensemble: list | None = None, settings: Settings = Settings()) -> Linked:
    """The same against targets that are normalised and indexed already."""
    queries = once(queries)
    q = records.normalise(queries, settings.strip_domain_words)
    found = blocking.top_k(blocking.votes(q, index), settings.k)
    return _decide(queries, found, features.pairs(found, q, targets), ensemble, settings)


def evaluate(truth: DataFrame, linked: Linked) -> DataFrame:
    """Macro scores and candidate recall of a run: one row. truth: (s1_id, matches)."""
    macro = metrics.macro(metrics.entity_f05(truth, linked.kept))
    return macro.crossJoin(metrics.candidate_recall(truth, linked.candidates))  # of single rows


def report(truth: DataFrame, linked: Linked) -> str:
    """The evaluation as text."""
    row = evaluate(truth, linked).first().asDict()
    return "\n".join(f"{k.replace('_', ' '):<20} {v:.4f}" if isinstance(v, float) else f"{k.replace('_', ' '):<20} {v}" for k, v in row.items())


def train_and_calibrate(queries: DataFrame, targets: DataFrame, truth: DataFrame, n_train: int = 35_000, settings: Settings = Settings(), trees: int = models.TREES):
    """Fits the ensemble on the first ``n_train`` entities by hash order and calibrates thresholds on the others.

    truth: (s1_id, country, matches). Returns the models and (country, threshold, macro_f05).
    """
    ensemble, best, _ = train_and_score(queries, targets, truth, n_train, settings, trees)
    return ensemble, best


def train_and_score(queries: DataFrame, targets: DataFrame, truth: DataFrame, n_train: int = 35_000, settings: Settings = Settings(), trees: int = models.TREES):
    """As :func:`train_and_calibrate`, and as a third result the macro scores of the hold-out at the calibrated thresholds (one row)."""
    found, pairs = candidate_pairs(once(queries), once(targets), settings)
    split = sampling.train_split(truth.select("s1_id"), n_train)
    full = features.pair_features(pairs)
    labelled = sampling.pair_labels(found, truth).join(split.filter("is_train"), "s1_id", "left_semi")
    data = full.join(sampling.hard_negatives(labelled).select("s1_id", "cand_id", "label"), ["s1_id", "cand_id"])
    ensemble = models.train_ensemble(data, trees)
    held = split.filter(~F.col("is_train"))
    truth = truth.join(held, "s1_id", "left_semi")
    scored = models.ensemble_score(full.join(held, "s1_id", "left_semi"), ensemble)
    best = metrics.best_thresholds(metrics.threshold_grid(truth, scored, metrics.grid(), settings.margin))
    return ensemble, best, metrics.overall(truth, scored, best, settings.margin)


def validation_set(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, size: int = 50_000) -> dict[str, DataFrame]:
    """A sample of entities by country and number of matches, their matches with distractors by source, and their truth.

    truth: (s1_id, country, matches).
    """
    buckets = sampling.match_buckets(truth)
    chosen = sampling.top_off(sampling.stratified(buckets, size), buckets.select("s1_id"), size)
    kept = truth.join(chosen, "s1_id", "left_semi")
    needed = kept.select(F.explode("matches").alias("cand_id"))
    parts = {f"source{n}": sampling.distractors(once(t), needed.filter(F.col("cand_id").startswith(f"S{n}-")), sources=(f"S{n}-",)) for n, t in ((2, s2), (3, s3))}
    first = once(s1).join(chosen.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    rows = kept.select(F.col("s1_id").alias("source1_entity_id"), F.array_join(F.array_sort("matches"), ",").alias("matched_entity_ids")).orderBy("source1_entity_id")
    return {"source1": first, **parts, "ground_truth": rows}
