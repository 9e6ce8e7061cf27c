"""Training pairs and samples. Order is by md5 of id and seed, which is the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(c: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(c, F.lit(f"#{seed}")))


def train_split(ids: DataFrame, n_train: int, seed: int = 42) -> DataFrame:
    """Adds is_train for the first ``n_train`` ids by hash order; the cut is found by a bounded top-n, not a global sort."""
    key = order_key(F.col("s1_id"), seed)
    cut = ids.select(key.alias("cut")).orderBy("cut").limit(n_train).agg(F.max("cut").alias("cut"))
    return ids.crossJoin(F.broadcast(cut)).select(*ids.columns, F.coalesce(key <= F.col("cut"), F.lit(False)).alias("is_train"))  # cut: one row


def pair_labels(cands: DataFrame, truth: DataFrame) -> DataFrame:
    true = truth.select("s1_id", F.explode("matches").alias("cand_id")).distinct().withColumn("__t", F.lit(1))
    return cands.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")


def hard_negatives(labelled: DataFrame, per_entity: int = 3) -> DataFrame:
    """All positives, and of each entity the first negatives by rank."""
    r = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy("rank"))
    return labelled.withColumn("__r", r).filter((F.col("label") == 1) | (F.col("__r") <= per_entity)).drop("__r")


def match_buckets(entities: DataFrame) -> DataFrame:
    """entities (s1_id, country, matches) with bucket, the number of matches up to five."""
    return entities.select("s1_id", F.coalesce("country", F.lit("Unknown")).alias("country"), F.least(F.size("matches"), F.lit(5)).alias("bucket"))


def stratified(buckets: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Of each stratum (country, bucket) int(size / all * target) ids, by hash order."""
    total = buckets.agg(F.count("*").alias("total"))
    sizes = buckets.groupBy("country", "bucket").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # total: one row
    sizes = sizes.select("country", "bucket", F.floor(F.col("n") / F.col("total") * F.lit(target)).alias("quota"))
    r = F.row_number().over(Window.partitionBy("country", "bucket").orderBy(order_key(F.col("s1_id"), seed), "s1_id"))
    return buckets.withColumn("__r", r).join(sizes, ["country", "bucket"]).filter(F.col("__r") <= F.col("quota")).select("s1_id", "country", "bucket")


def top_off(sample: DataFrame, ids: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """The sample with more ids by hash order, up to the target: sampled ids come first in one bounded top-n."""
    both = sample.select("s1_id", F.lit(0).alias("__later")).unionByName(ids.join(sample.select("s1_id"), "s1_id", "left_anti").select("s1_id", F.lit(1).alias("__later")))
    return both.orderBy("__later", order_key(F.col("s1_id"), seed), "s1_id").limit(target).select("s1_id")


def distractors(targets: DataFrame, needed: DataFrame, percent: int = 5, most: int = 100_000, countries: list[str] | None = None, seed: int = 42, sources: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """Needed targets, and of each source's others about ``percent`` in a hundred, ``most`` of each source at most (a feature of the sample)."""
    ids = needed.select(F.col("cand_id").alias("entity_id")).distinct()
    kept, rest = targets.join(ids, "entity_id", "left_semi"), targets.join(ids, "entity_id", "left_anti")
    if countries:
        rest = rest.filter(F.col("country").isin(countries))
    bucket = F.pmod(F.conv(F.substring(order_key(F.col("entity_id"), seed), 1, 8), 16, 10).cast("long"), F.lit(100))
    for source in sources:
        kept = kept.unionByName(rest.filter(F.col("entity_id").startswith(source) & (bucket < percent)).orderBy("entity_id").limit(most))
    return kept
