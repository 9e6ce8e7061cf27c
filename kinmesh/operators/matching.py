"""Decisions: the rule score, the gate that protects records without a counterpart, blends and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.kernels import kernel_table


def combine(name: Column, addr: Column, has_addresses: Column) -> Column:
    """The rule score of a name and an address similarity.

    Comparisons are on similarities rounded to nine places, as in :func:`gate`: 0.95 * (18 / 19) is a little less than 0.9.
    """
    near = (F.round(addr, 9) >= 0.90) & (F.round(name, 9) >= 0.50)
    return F.when(~has_addresses, 0.9 * name).when(near, (name + addr) / 2).otherwise(0.6 * name + 0.4 * addr)


def rule_score(pair: DataFrame, raw_query: bool = False, column: str = "p") -> DataFrame:
    """Adds the rule score. The query's address is only cleaned, the target's also written out; 'null' is no address.

    With ``raw_query`` the query's name and address are only lower-cased, as the hybrid matcher takes them.
    """
    k = ("token_sort", "token_set")
    if raw_query:
        name, addr = F.lower(F.coalesce("q_name", F.lit(""))), F.lower(F.coalesce("q_address", F.lit("")))
    else:
        name, addr = F.col("q_name_clean"), F.col("q_addr_clean")
    pair = pair.withColumn("__k", kernel_table([(name, F.col("t_name_clean"), k, "n"), (addr, F.col("t_addr_norm"), k, "a")]))
    best = lambda c: F.greatest(F.col(f"__k.{c}_token_sort"), 0.95 * F.col(f"__k.{c}_token_set"))
    has = ~addr.isin("", "null") & ~F.col("t_addr_norm").isin("", "null")
    return pair.withColumn(column, combine(best("n"), best("a"), has)).drop("__k")


def gate(scored: DataFrame, threshold: Column, least_best: Column) -> DataFrame:
    """Pairs with p of at least the threshold, of records whose best p is at least ``least_best``.

    Comparisons are on p rounded to nine places, so that the last bits of a kernel cannot turn one.
    """
    best = F.max("p").over(Window.partitionBy("s1_id"))
    return scored.withColumn("__best", best).filter((F.round("__best", 9) >= F.round(least_best, 9)) & (F.round("p", 9) >= F.round(threshold, 9))).drop("__best")


def country_threshold(thresholds: dict[str, float], default: float, country: str = "country") -> Column:
    c = F.lit(default)
    for k, v in thresholds.items():
        c = F.when(F.col(country) == k, v).otherwise(c)
    return c


def rule_match(scored: DataFrame, threshold: float = 0.74, singleton: float = 0.78) -> DataFrame:
    return gate(scored, F.lit(threshold), F.lit(singleton))


def hybrid(scored: DataFrame, threshold: float = 0.85, margin: float = 0.02, model: str = "p_model", rule: str = "p_rule") -> DataFrame:
    """Half model, half rule."""
    return gate(scored.withColumn("p", 0.5 * F.col(model) + 0.5 * F.col(rule)), F.lit(threshold), F.lit(threshold + margin))


def ensemble_gate(scored: DataFrame, thresholds: dict[str, float], default: float = 0.94, margin: float = 0.02) -> DataFrame:
    """Thresholds by country."""
    t = country_threshold(thresholds, default)
    return gate(scored, t, t + margin)


def merge_thresholds(given: dict[str, float] | None) -> dict[str, float]:
    """Calibrated thresholds over the defaults."""
    return {"US": 0.94, "India": 0.94, "France": 0.96} | (given or {})


def output_rows(queries: DataFrame, kept: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row for each query id, with its kept ids by rank, comma-joined; '' if there are none."""
    ids = kept.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]), ",").alias(column))
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(ids.withColumnRenamed("s1_id", "source1_entity_id"), "source1_entity_id", "left").fillna("", [column])


def validate(matches: DataFrame, cands: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Our own check of outputs: counts of queries without a row or with several, of matches that are no candidates, of
    unknown ids and of repeated ids; all zero for a valid output. Candidates are rows of comma-joined ids, or pairs (source1_entity_id, id)."""
    split = lambda df, c: df.select("source1_entity_id", F.explode(F.filter(F.split(c, ","), lambda x: x != "")).alias("id"))
    m, c = split(matches, "matched_entity_ids"), cands if "id" in cands.columns else split(cands, "candidate_entity_ids")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    ids = queries.select(F.col("entity_id").alias("source1_entity_id"))
    parts = [
        one(ids.join(matches, "source1_entity_id", "left_anti"), "missing_rows"),
        one(matches.groupBy("source1_entity_id").count().filter("count > 1"), "repeated_rows"),
        one(m.join(c, ["source1_entity_id", "id"], "left_anti"), "not_candidates"),
        one(m.join(targets.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_ids"),
        one(m.groupBy("source1_entity_id", "id").count().filter("count > 1"), "repeated_ids"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # of single rows
    return out
