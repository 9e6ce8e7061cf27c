"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are integers ``floor(256 * x)``. A batch of candidate rows is turned into posting lists, one for each
dimension (term): the rows with a weight there and their weights. A block of query rows, sparse in the
same way, is walked term by term, and each posting list is scattered, weighted, into a dense array of scores
(query x candidate), a tile of queries at a time. A partition selection keeps the k best of a batch for each query and merges
them with those that the task holds already; only when a task ends do its k best of each query leave it, and are merged by query.

Queries are taken in blocks of bounded size, each broadcast to one scan of the candidates, so no task holds more
than a block of queries, its best candidates and a batch. The work is queries times candidates, as exhaustive
search has to be.

Defined cases: vectors that are null, hold a null or a non-finite component, or have no id take no part. The
products of dimensions that only one side has are left out (vectors of unequal length). A vec_id that occurs
repeatedly counts once, with its best score; as a query with its least vector. Ties go to the smaller vec_id. Integer components are held to
the range of 26 bits, so that scores of up to 4,096 dimensions fit 64 bits. Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.cluster import shared_folder
from kinmesh.llm.common import materialise, short_batches, table

SCALE = 256
K = 5
EVERY = 50
#: Queries of a block, and so the rows of a broadcast, at most in expectation.
QUERY_BLOCK = 1 << 14
#: Largest size of an integer component.
MOST = 1 << 25
#: Queries whose scores are held at once, and of these those whose arrays stay in the cache.
_SELECTED, _TILE = 2048, 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows that take part: vec_id and their integer components."""
    v, key = F.col(f"`{embedding}`").cast("array<double>"), F.col(f"`{vec_id}`").cast("long")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(key.isNotNull() & v.isNotNull() & whole).select(key.alias("vec_id"), F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(float(MOST))), F.lit(float(-MOST))) * SCALE), F.lit(MOST)), F.lit(-MOST))).alias("weights"))


@dataclass
class QueryBlock:
    """Queries as a term-major sparse matrix: for each term the queries that have it and their weights."""

    ids: np.ndarray
    terms: list[tuple[np.ndarray, np.ndarray]]


def _matrix(rows: list[list[int]]) -> np.ndarray:
    width = max(map(len, rows), default=0)
    return np.array([r + [0] * (width - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), width)


def _block(rows) -> QueryBlock:
    m = _matrix([list(r["weights"]) for r in rows])
    terms = []
    for d in range(m.shape[1]):
        at = np.flatnonzero(m[:, d])
        terms.append((at, m[at, d]))
    return QueryBlock(np.array([r["vec_id"] for r in rows], dtype=np.int64), terms)


def postings_of(candidates: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the candidates that have it and their weights."""
    return [(at, candidates[at, d]) for d in range(candidates.shape[1]) for at in [np.flatnonzero(candidates[:, d])]]


def accumulate(block: QueryBlock, postings: list[tuple[np.ndarray, np.ndarray]], n: int, first: int, last: int) -> np.ndarray:
    """Scores of the queries from ``first`` to ``last`` (query x candidate), term at a time."""
    scores = np.zeros((last - first, n), dtype=np.int64)
    for low in range(first, last, _TILE):  # a tile of score arrays stays in the cache
        high = min(low + _TILE, last)
        for (queries, weights), (at, held) in zip(block.terms, postings, strict=False):
            a, b = np.searchsorted(queries, (low, high))
            if a == b or not len(at):
                continue
            if len(at) == n and b - a == high - low:
                scores[low - first : high - first] += weights[a:b, None] * held
            else:
                scores[np.ix_(queries[a:b] - first, at)] += weights[a:b, None] * held
    return scores


class Best:
    """The k best candidates of each query of a block so far: ids and scores, by falling score and rising id."""

    def __init__(self, block: QueryBlock, k: int):
        self.block, self.k = block, k
        self.ids = np.zeros((len(block.ids), k), dtype=np.int64)
        self.scores = np.full((len(block.ids), k), _LEAST)

    def add(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        """Takes in a batch. Of equal scores the smaller ids stay; an id that comes again counts once, with its best score."""
        order = np.argsort(ids, kind="stable")
        ids, candidates = ids[order], candidates[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        postings, n = postings_of(candidates), len(starts)
        for first in range(0, len(self.block.ids), _SELECTED):
            last = min(first + _SELECTED, len(self.block.ids))
            scores = accumulate(self.block, postings, len(ids), first, last)
            if n < len(ids):
                scores = np.maximum.reduceat(scores, starts, axis=1)
            scores[ids[starts][None, :] == self.block.ids[first:last, None]] = _LEAST
            # Only candidates that reach the query's k-th best so far, and the k-th best of the batch, can matter.
            least = self.scores[first:last, -1]
            if n > self.k:
                least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
            q, c = np.nonzero((scores >= least[:, None]) & (scores > _LEAST))
            if len(q):
                self._merge(q + first, ids[starts][c], scores[q, c])

    def _merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(q)
        held = self.scores[touched] > _LEAST
        q = np.concatenate([q, np.repeat(touched, held.sum(axis=1))])
        ids, scores = np.concatenate([ids, self.ids[touched][held]]), np.concatenate([scores, self.scores[touched][held]])
        order = np.lexsort((-scores, ids, q))  # the best of each id comes first
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])
        q, ids, scores = q[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, ids, scores, rank = (x[rank < self.k] for x in (q, ids, scores, rank))
        self.scores[touched] = _LEAST
        self.ids[q, rank], self.scores[q, rank] = ids, scores

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score)."""
        q, at = np.nonzero(self.scores > _LEAST)
        return self.block.ids[q], self.ids[q, at], self.scores[q, at]


_LEAST = np.iinfo(np.int64).min


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query row of ``vectors`` its k best others: query_id, rank, vec_id and score."""
    spark = vectors.sparkSession
    short_batches(spark)
    rows = usable(vectors, vec_id, embedding)
    queries = usable(vectors.filter(is_query), vec_id, embedding).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    count = queries.count()
    parts = max(1, -(-count // query_block))
    if parts > 1:
        queries = materialise(queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).repartition(parts, "part"), "queries")
    else:
        queries = queries.withColumn("part", F.lit(0))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def scan(part: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(_block(queries.filter(F.col("part") == part).orderBy("vec_id").collect()))

        def run(batches):
            best = Best(sent.value, k)
            for batch in batches:
                if batch.num_rows and len(sent.value.ids):
                    held = batch.column("weights")
                    sizes = np.diff(held.offsets.to_numpy())
                    if (sizes == sizes[0]).all():
                        candidates = held.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0])
                    else:
                        candidates = _matrix(held.to_pylist())
                    best.add(batch.column("vec_id").to_numpy(), candidates)
            found = best.rows()
            for low in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in found], schema=schema)

        return rows.mapInArrow(run, "query_id long, vec_id long, score long")

    def merge(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if parts == 1:
        return merge(scan(0))
    folder = shared_folder(spark)
    for p in range(parts):
        merge(scan(p)).write.parquet(f"{folder}/block={p}")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").option("recursiveFileLookup", "true").parquet(folder)


def op4_topk_search(spark, sf_dir):
    """The five best others of every fiftieth vector of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)


ORACLE = f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as w from embeddings
           where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
             and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
q as (select vec_id as query_id, row_number() over (order by vec_id) as r, unnest(w) as w, generate_subscripts(w, 1) as d from v where vec_id % {EVERY} = 0),
c as (select vec_id, unnest(w) as w, generate_subscripts(w, 1) as d from v),
s as (select query_id, vec_id, cast(sum(q.w * c.w) as bigint) as score from q join c using (d) where query_id <> vec_id group by query_id, vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
