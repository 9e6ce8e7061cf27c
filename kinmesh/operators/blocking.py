"""Blocking: weighted keys, inverted index by country, pruning of frequent keys, votes and the best k candidates.

Keys are counted natively; votes are added up in blocks of queries and targets of a country (:mod:`kinmesh.operators.voting`), so that they
never become rows. Repeats of a key in one record count, and a vote is the product of both sides' repeats and the key's weight. Ties go to the
smaller id. A repeated id counts as one record with all its keys, if its country is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.cluster import ship
from kinmesh.functions.text import sql_list, tokens
from kinmesh.functions.vocabulary import NAME_STOP_WORDS
from kinmesh.operators import voting

#: Records of a block: queries (more if a country would have over BLOCKS of them, up to MOST_QUERIES) and targets. Targets are sent once for
#: each block of queries, so these are few as long as the pairs of blocks give a cluster enough tasks.
BLOCK_QUERIES, BLOCKS, MOST_QUERIES, BLOCK_TARGETS = 8192, 8, 65_536, 65_536


def key_array() -> Column:
    """Keys of a normalised record, as structs of key and weight."""
    pair = lambda prefix, t, w: F.struct(F.concat(F.lit(prefix), t).alias("key"), F.lit(w).alias("weight"))
    none = F.array().cast("array<struct<key:string,weight:int>>")
    clean, root = tokens(F.col("name_clean")), tokens(F.col("name_root"))
    two = F.concat(clean[0], F.lit("_"), F.try_element_at(clean, F.lit(2)))
    return F.concat(
        F.transform(F.filter(root, lambda t: (F.length(t) >= 3) & ~t.isin(*NAME_STOP_WORDS)), lambda t: pair("n_", t, 3)),
        F.when(F.size(clean) >= 2, F.array(pair("n2_", two, 4))).when((F.size(clean) == 1) & (F.length("name_clean") >= 3), F.array(pair("n1_", F.col("name_clean"), 1))).otherwise(none),
        F.when(F.length("name_compact") >= 6, F.array(pair("cp_", F.substring("name_compact", 1, 8), 3))).otherwise(none),
        F.transform("addr_nums", lambda t: pair("num_", t, 1)),
        F.transform(F.slice("addr_words", 1, 4), lambda t: pair("aw_", t, 2)),
    )


def keyed(normalised: DataFrame) -> DataFrame:
    """(entity_id, country, keys): each different key of a record with its weight and how often it is met there. Records that have ``keys`` keep theirs."""
    if "keys" in normalised.columns:
        return normalised.select("entity_id", "country", "keys")
    return with_keys(normalised).select("entity_id", "country", "keys")


def with_keys(normalised: DataFrame) -> DataFrame:
    """Adds ``keys`` to normalised records; written with them, they are computed once."""
    keys = normalised.withColumn("keys", key_array())
    counted = F.transform(F.array_distinct("keys"), lambda k: F.struct(k["key"].alias("key"), k["weight"].alias("weight"), F.size(F.filter("keys", lambda x: x["key"] == k["key"])).cast("long").alias("mult")))
    return keys.withColumn("keys", counted)


def block_keys(normalised: DataFrame) -> DataFrame:
    """(entity_id, country, key, weight, mult), one row for each different key of a record; nothing is shuffled."""
    return keyed(normalised).select("entity_id", "country", F.inline("keys"))


def inverted_index(targets: DataFrame) -> DataFrame:
    """Postings of targets: (country, key, cand_id, mult)."""
    return block_keys(targets).select("country", "key", F.col("entity_id").alias("cand_id"), "mult")


def prune(index: DataFrame, max_postings: int) -> DataFrame:
    """Keys of a country with more postings than the limit go; repeats count.

    Counts are combined before the shuffle and the join is one that Spark can split, so a very frequent key never gathers
    in one task.
    """
    fine = index.groupBy("country", "key").agg(F.sum("mult").alias("postings")).filter(F.col("postings") <= max_postings)
    return index.join(fine.select("country", "key"), ["country", "key"], "left_semi")


def votes(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score): summed weights of shared keys. Nulls and unknown countries find nothing.

    For few queries against a stored index (streams): the rows that meet are the votes, of which :func:`fan_out` tells the number beforehand.
    :func:`votes_in_blocks` makes none.
    """
    q = block_keys(queries).select(F.col("entity_id").alias("s1_id"), "country", "key", "weight", F.col("mult").alias("mq"))
    cast = q.join(index, ["country", "key"]).select("s1_id", "cand_id", (F.col("mq") * F.col("mult") * F.col("weight")).alias("vote"))
    return cast.groupBy("s1_id", "cand_id").agg(F.sum("vote").alias("score"))


def votes_in_blocks(queries: DataFrame, targets: DataFrame, max_postings: int, k: int | None = None) -> DataFrame:
    """The same of normalised queries and targets: all pairs, or with ``k`` at least the best k of each query.

    The records of a country are dealt into blocks by id, and each pair of blocks is a group with the keys of its records and the pruned
    keys of the country (at most all postings divided by the limit). Records are sent once for each block of the other side.
    """
    ship(queries.sparkSession)
    queries, targets = (x.filter(F.col("country").isNotNull()) for x in (queries, targets))
    q, t = keyed(queries), keyed(targets)
    frequent = t.select("country", F.inline("keys")).groupBy("country", "key").agg(F.max("weight").alias("weight"), F.sum("mult").alias("mult")).filter(F.col("mult") > max_postings)
    frequent = frequent.select(F.lit("").alias("entity_id"), "country", F.array(F.struct("key", "weight", "mult")).alias("keys"))
    sizes = queries.groupBy("country").agg(F.count("*").alias("nq")).join(targets.groupBy("country").agg(F.count("*").alias("nt")), "country")
    block = F.least(F.greatest(F.lit(BLOCK_QUERIES), F.ceil(F.col("nq") / BLOCKS)), F.lit(MOST_QUERIES))
    sizes = F.broadcast(sizes.select("country", F.ceil(F.col("nq") / block).alias("bq"), F.ceil(F.col("nt") / BLOCK_TARGETS).alias("bt")))  # a row for each country
    own = lambda n: F.pmod(F.xxhash64("entity_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def dealt(rows: DataFrame, kind: int, bq: Column, bt: Column) -> DataFrame:
        return rows.join(sizes, "country").withColumn("bt", bt).withColumn("bq", bq).select("country", "bq", "bt", F.lit(kind).cast("byte").alias("kind"), F.col("entity_id").alias("id"), "keys")

    rows = dealt(t, voting.TARGET, every("bq"), own("bt")).unionByName(dealt(q, voting.QUERY, own("bq"), every("bt"))).unionByName(dealt(frequent, voting.PRUNED, every("bq"), every("bt")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in voting.block_votes(pa.Table.from_batches(batches), k):
            yield from found.combine_chunks().to_batches()

    return rows.groupBy("country", "bq", "bt").applyInArrow(run, "s1_id string, cand_id string, score long")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query: rank from 0 and the best score."""
    by = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    ranked = scored.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < k)
    return ranked.withColumn("top_score", F.max("score").over(Window.partitionBy("s1_id")))


def candidates(queries: DataFrame, targets: DataFrame, k: int = 25, max_postings: int = 25_000) -> DataFrame:
    """(s1_id, cand_id, score, rank, top_score) for normalised queries and targets."""
    return top_k(votes_in_blocks(queries, targets, max_postings, k), k)


def fan_out(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that the key join will make: one row, to be looked at before a large run."""
    q = block_keys(queries).groupBy("country", "key").agg(F.count("*").alias("nq"))
    t = index.groupBy("country", "key").agg(F.count("*").alias("nt"))
    return q.join(t, ["country", "key"]).agg(F.coalesce(F.sum(F.col("nq") * F.col("nt")), F.lit(0)).alias("join_rows"))


def sql_keys(source: str = "norm") -> str:
    """CTE ``keys`` over normalised records."""
    item = lambda prefix, t, w: f"{{'key': '{prefix}' || {t}, 'weight': {w}}}"
    return f"""
    kt as (select entity_id, country, list_filter(string_split(name_clean, ' '), lambda t: t <> '') as c, list_filter(string_split(name_root, ' '), lambda t: t <> '') as r,
                  name_clean, name_compact, addr_nums, addr_words from {source}),
    ku as (select entity_id, country, unnest(list_concat(
             list_transform(list_filter(r, lambda t: length(t) >= 3 and t not in ({sql_list(NAME_STOP_WORDS)})), lambda t: {item('n_', 't', 3)}),
             case when len(c) >= 2 then [{item('n2_', "c[1] || '_' || c[2]", 4)}] when len(c) = 1 and length(name_clean) >= 3 then [{item('n1_', 'name_clean', 1)}] else [] end,
             case when length(name_compact) >= 6 then [{item('cp_', 'left(name_compact, 8)', 3)}] else [] end,
             list_transform(addr_nums, lambda t: {item('num_', 't', 1)}),
             list_transform(addr_words[1:4], lambda t: {item('aw_', 't', 2)}))) as k from kt),
    keys as (select entity_id, country, k.key as key, cast(max(k.weight) as integer) as weight, count(*) as mult from ku group by all)"""


def sql_candidates(is_query: str, is_target: str, k: int, max_postings: int) -> str:
    """CTEs ``idx, pruned, votes, cand`` after ``keys``."""
    return f"""
    idx as (select country, key, entity_id as cand_id, mult from keys where {is_target}),
    pruned as (select country, key, cand_id, mult from (select *, sum(mult) over (partition by country, key) as p from idx) where p <= {max_postings}),
    votes as (select q.entity_id as s1_id, cand_id, cast(sum(q.mult * p.mult * weight) as bigint) as score
              from (select * from keys where {is_query}) q join pruned p on q.country = p.country and q.key = p.key group by all),
    ranked as (select *, cast(row_number() over (partition by s1_id order by score desc, cand_id) - 1 as integer) as rank from votes),
    cand as (select *, max(score) over (partition by s1_id) as top_score from ranked where rank < {k})"""
