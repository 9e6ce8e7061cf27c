"""Readers and writers of tab-separated records, truth, outputs and thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, name string, address string, country string"


def read_records(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Records of a tab-separated file with a header; lines are trimmed whole, lines of fewer than four fields go.

    Quotes are ordinary characters.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    # The header is the first line of each file: the one that begins with the name of the first column.
    fields = lines.filter(~F.lower(F.col("value")).rlike(r"^(source\d*_)?entity_id\t")).select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") >= 4)
    out = fields.select(*[F.col("f")[i].alias(c.split()[0]) for i, c in enumerate(RECORD.split(", "))])
    return out if country is None else out.filter(F.col("country") == country)


def read_records_fast(spark: SparkSession, path: str) -> DataFrame:
    """The same by the CSV reader, for files without stray blanks; rows without a country go."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema=RECORD)
    return rows.filter("country is not null").fillna("")


def union_targets(second: DataFrame, third: DataFrame) -> DataFrame:
    return second.unionByName(third)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matched_entity_ids): each line cut at its first tab. Of several lines of one id the last counts."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = spark.read.text(path).select(F.split(line, "\t", 2).alias("f"), F.monotonically_increasing_id().alias("at"))
    rows = rows.select(F.trim(F.col("f")[0]).alias("s1_id"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("matched_entity_ids"), "at")
    rows = rows.filter(~F.col("s1_id").isin("", "source1_entity_id", "s1_id"))
    return rows.groupBy("s1_id").agg(F.max_by("matched_entity_ids", "at").alias("matched_entity_ids"))


def write_tsv(df: DataFrame, path: str) -> None:
    """With a header; empty strings stay empty and nothing is quoted."""
    df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").mode("overwrite").csv(path)


def read_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """Thresholds of a JSON object; a few entries."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    return {k: float(v) for k, v in json.loads(text or "{}").items()}


def write_thresholds(spark: SparkSession, thresholds: dict[str, float], path: str) -> None:
    spark.createDataFrame([(json.dumps(thresholds),)], "value string").coalesce(1).write.mode("overwrite").text(path)
