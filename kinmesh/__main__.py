"""``python -m kinmesh [link|evaluate|train|split|validate]``: record linkage of tab-separated sources.

Without a command the first form is meant: link SOURCE1 SOURCE2 SOURCE3 OUTPUT.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators import matching, metrics, models
from kinmesh.plans import pipeline
from kinmesh.settings import Settings
from kinmesh.sources import files

COMMANDS = ("link", "evaluate", "train", "split", "validate")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinmesh", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--batch-size", type=int, default=5000, help="rows of an Arrow batch")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for place in ("source1", "source2", "source3", *places):
            c.add_argument(place)
        c.add_argument("--batch-size", type=int, default=argparse.SUPPRESS)
        return c

    for name, text, places in (("link", "writes matching results and candidate pairs", ("output",)), ("evaluate", "prints scores against a truth", ("truth",))):
        c = command(name, text, *places)
        c.add_argument("--country")
        c.add_argument("--model", help="folder of saved models; without it, or if there is none, the rule decides")
        c.add_argument("--thresholds", help="JSON file of thresholds by country")
    c = command("train", "trains models, calibrates thresholds and prints the scores of the hold-out", "truth", "output")
    c.add_argument("--entities", type=int, default=35_000, help="entities to train on")
    c.add_argument("--trees", type=int, default=models.TREES)
    c.add_argument("--unseen", default="France", help="a country without training data: the largest threshold of the others and a margin")
    c = command("split", "writes a stratified sample with its matches and distractors", "truth", "output")
    c.add_argument("--size", type=int, default=50_000)
    command("validate", "checks outputs; exit status 1 if there are faults", "matches", "candidates")
    return p


def _tables(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(files.read_records(spark, x) for x in (a.source1, a.source2, a.source3))


def _truth(spark: SparkSession, path: str, s1: DataFrame) -> DataFrame:
    """(s1_id, country, matches) of the entities that the truth names."""
    known = metrics.parse_truth(files.read_truth(spark, path))
    return known.join(pipeline.once(s1).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id", "left").select("s1_id", "country", "matches")


def _linked(spark: SparkSession, a) -> pipeline.Linked:
    settings = Settings(thresholds=Settings().thresholds | (files.read_thresholds(spark, a.thresholds) if a.thresholds else {}))
    s1, s2, s3 = _tables(spark, a)
    return pipeline.link(s1, files.union_targets(s2, s3), models.load(spark, a.model), settings, a.country)


def link(spark: SparkSession, a) -> int:
    began, linked = time.time(), _linked(spark, a)
    files.write_tsv(linked.match_rows(), f"{a.output}/matching_results.tsv")
    files.write_tsv(linked.candidate_rows(), f"{a.output}/candidate_pairs.tsv")
    n = linked.queries.count()
    print(f"{n} entities in {time.time() - began:.1f} s, {n / (time.time() - began):.1f} a second")
    return 0


def evaluate(spark: SparkSession, a) -> int:
    began, linked = time.time(), _linked(spark, a)
    truth = _truth(spark, a.truth, linked.queries)
    if a.country is not None:
        truth = truth.filter(F.col("country") == a.country)
    print(pipeline.report(truth, linked))
    print(f"{time.time() - began:.1f} s")
    return 0


def train(spark: SparkSession, a) -> int:
    s1, s2, s3 = _tables(spark, a)
    ensemble, best, scores = pipeline.train_and_score(s1, files.union_targets(s2, s3), _truth(spark, a.truth, s1), a.entities, trees=a.trees)
    found = {r["country"]: r["threshold"] for r in best.filter("country is not null").collect()}  # one row a country
    if a.unseen not in found and found:
        found[a.unseen] = round(max(found.values()) + 0.02, 2)
    models.save(spark, ensemble, f"{a.output}/model")
    files.write_thresholds(spark, found, f"{a.output}/thresholds")
    print("\n".join(f"{k} {v}" for k, v in {**found, **scores.first().asDict()}.items()))
    return 0


def split(spark: SparkSession, a) -> int:
    s1, s2, s3 = _tables(spark, a)
    for name, table in pipeline.validation_set(s1, s2, s3, _truth(spark, a.truth, s1), a.size).items():
        files.write_tsv(table, f"{a.output}/{name}.tsv")
    return 0


def validate(spark: SparkSession, a) -> int:
    s1, s2, s3 = _tables(spark, a)
    matches, candidates = (spark.read.csv(x, sep="\t", header=True, quote="", schema=f"source1_entity_id string, {c} string").fillna("") for x, c in ((a.matches, "matched_entity_ids"), (a.candidates, "candidate_entity_ids")))
    faults = matching.validate(matches, candidates, pipeline.once(s1), files.union_targets(s2, s3)).first().asDict()
    print("\n".join(f"{k} {v}" for k, v in faults.items()))
    return int(any(faults.values()))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["link", *argv]
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinmesh").config("spark.sql.execution.arrow.maxRecordsPerBatch", a.batch_size).getOrCreate()
    return {"link": link, "evaluate": evaluate, "train": train, "split": split, "validate": validate}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
