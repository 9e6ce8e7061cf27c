"""Connected components of a table of links, by alternating stars (Kiveris et al., 2014).

Each round is a few joins and aggregations over the links; its result is written to the shared folder, so lineage
stays short and nothing but counts reaches the driver; the tables of a round are deleted once the next is written.
The least neighbour of each vertex is combined before its shuffle and written, so that the join with it has a plain
exchange on either side: Spark can split the many links of one vertex there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour beyond a vertex is linked to the least of the vertex and its neighbours. Also the table of these."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex and its lesser neighbours are linked to the least of these. Also the table of these."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))), least


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex of ``edges`` (u, v: long) but the least of its component, with that least vertex; a written table."""
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    while True:
        stars, first = _large_star(edges)
        stars = materialise(stars.distinct(), "stars")
        discard(edges, first)
        joined, second = _small_star(stars)
        edges = materialise(joined.distinct(), "stars")
        discard(stars, second)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return edges
        state = now
