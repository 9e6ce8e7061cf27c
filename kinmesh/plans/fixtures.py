"""Linkage inputs derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters of a text that are looked at first.
HEAD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(c):
    text = c.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of ``documents``: source by id, name and address from the first words, country from the language."""
    # Words 1 to 14 need no more than 16 parts: what stands before a leading space, 14 words and the rest, which is not split.
    # Most texts have 14 whole words in their first characters, so that the rest of a long text need not be decoded; others are split whole.
    head = F.substring("text", 1, HEAD)
    text = F.when(head.rlike(r"^\s*+(?:\S++\s++){14}"), head).otherwise(F.col("text"))
    words = F.filter(F.split(text, r"\s+", 16), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w"))
    src = (1 + F.pmod("doc_id", F.lit(3))).cast("string")
    return docs.select(
        F.concat(F.lit("S"), src, F.lit("-"), _padded(F.col("doc_id"))).alias("entity_id"),
        F.array_join(F.slice("w", 1, 4), " ").alias("name"),
        F.array_join(F.slice("w", 5, 10), " ").alias("address"),
        F.col("lang").alias("country"),
    )


ENTITIES = r"""
ew as (select doc_id, lang, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
ent as (select 'S' || (1 + doc_id % 3) || '-' || case when length(cast(doc_id as varchar)) >= 6 then cast(doc_id as varchar) else lpad(cast(doc_id as varchar), 6, '0') end as entity_id,
               array_to_string(w[1:4], ' ') as name, array_to_string(w[5:14], ' ') as address, lang as country from ew)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as first source, suppliers as second, with zero-padded keys in their addresses."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S2-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(nation, "n_nationkey").select("entity_id", "name", F.concat(_padded(F.col("k")), F.lit(" St "), "n_name").alias("address"), F.col("n_name").alias("country"))


NUMBERED = """
ns as (select 'S1-' || c_custkey as entity_id, c_name as name, c_custkey as k, c_nationkey as n_nationkey from customer
       union all select 'S2-' || s_suppkey, s_name, s_suppkey, s_nationkey from supplier),
ent as (select entity_id, name, case when length(cast(k as varchar)) >= 6 then cast(k as varchar) else lpad(cast(k as varchar), 6, '0') end || ' St ' || n_name as address, n_name as country
        from ns join nation using (n_nationkey))"""


def is_query():
    return F.col("entity_id").startswith("S1-")


def truth(records: DataFrame) -> DataFrame:
    """(s1_id, country, matches): records of other sources with the same raw name, address and country."""
    q = records.filter(is_query()).select(F.col("entity_id").alias("s1_id"), "name", "address", "country")
    t = records.filter(~is_query()).select(F.col("entity_id").alias("cand_id"), "name", "address", "country")
    found = q.join(t, ["name", "address", "country"]).groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("matches"))
    return q.select("s1_id", "country").join(found, "s1_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))


TRUTH = """
tp as (select q.entity_id as s1_id, t.entity_id as cand_id from ent q join ent t on q.name = t.name and q.address = t.address and q.country = t.country
       where q.entity_id like 'S1-%' and t.entity_id not like 'S1-%'),
truth as (select entity_id as s1_id, country, coalesce(m, []) as matches from ent
          left join (select s1_id, list_sort(list_distinct(list(cand_id))) as m from tp group by s1_id) x on entity_id = s1_id where entity_id like 'S1-%')"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names of one brand."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    return p.select("p_brand", F.col("p_name").alias("a")).join(p.select("p_brand", F.col("p_name").alias("b")), "p_brand").select("a", "b").distinct()


NAME_PAIRS = "np as (select distinct p_brand, p_name from part), pairs as (select distinct x.p_name as a, y.p_name as b from np x join np y using (p_brand))"
