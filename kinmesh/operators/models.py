"""Pair models: two boosted-tree classifiers over the 42 features, and their blend.

The training table is bounded (a fixed number of entities, few pairs of each), so a model is fitted in one task, both models side by
side; scoring runs wherever the pairs lie, with the models broadcast (a few hundred small trees).
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.cluster import ship
from kinmesh.operators.boosting import Boosted, Growth, fit
from kinmesh.operators.features import FEATURES

# Fixed parameters of the two models.
TREES, RATE, DEPTH, LEAVES, L2, SHARE, SEED = 400, 0.08, 6, 31, 5.0, 0.8, 42
LEAST_ROWS = 20


def growths(trees: int = TREES) -> tuple[Growth, Growth]:
    """Symmetric trees with all rows and features; leafwise trees with samples of both."""
    return (
        Growth(True, trees, RATE, DEPTH, l2=L2, seed=SEED),
        Growth(False, trees, RATE, DEPTH, LEAVES, 0.0, LEAST_ROWS, SHARE, SHARE, SEED),
    )


def train_ensemble(labelled: DataFrame, trees: int = TREES) -> list[Boosted]:
    """Both models, from rows (s1_id, cand_id, label and the features). The order of rows does not matter."""
    ship(labelled.sparkSession)
    both = growths(trees)
    rows = labelled.select("s1_id", "cand_id", F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    rows = rows.withColumn("__model", F.explode(F.array(*[F.lit(i) for i in range(len(both))])))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("s1_id", "ascending"), ("cand_id", "ascending")])
        i = table.column("__model")[0].as_py()
        x = np.stack([table.column(c).to_numpy() for c in FEATURES], axis=1).astype(np.float32).astype(np.float64)
        return pa.table({"i": pa.array([i], pa.int32()), "model": [json.dumps(fit(x, table.column("label").to_numpy().astype(np.float64), both[i]).as_dict())]})

    made = {r["i"]: r["model"] for r in rows.groupBy("__model").applyInArrow(run, "i int, model string").collect()}  # two rows
    return [Boosted.of_dict(json.loads(made[i])) if i in made else fit(np.zeros((0, len(FEATURES))), np.zeros(0), g) for i, g in enumerate(both)]


def ensemble_score(features: DataFrame, models: list[Boosted]) -> DataFrame:
    """Adds ``p``, the mean of the models' probabilities."""
    ship(features.sparkSession)
    sent = features.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1).astype(np.float32).astype(np.float64)
            p = sum(m.probability(x) for m in sent.value) / len(sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

    source = features.drop("p")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("p", T.DoubleType())]))


def save(spark: SparkSession, models: list[Boosted], path: str) -> None:
    """One line of JSON for each model, in order."""
    rows = [(json.dumps({"i": i} | m.as_dict()),) for i, m in enumerate(models)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str | None) -> list[Boosted] | None:
    """Saved models; None if there are none at the path, so that the rule decides."""
    if path is None:
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    found = sorted((json.loads(r["value"]) for r in spark.read.text(path).collect()), key=lambda m: m["i"])  # a line a model
    return [Boosted.of_dict(m) for m in found] or None


def feature_importance(model: Boosted, spark: SparkSession, top: int = 10) -> DataFrame:
    """The features that matter most, by their share of all gains."""
    total = sum(model.gains) or 1.0
    return spark.createDataFrame([(f, v / total) for f, v in zip(FEATURES, model.gains, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
