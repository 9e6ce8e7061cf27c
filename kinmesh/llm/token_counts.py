"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit.

Each document is encoded where it lies and only its length goes on; documents are counted by length
before and after one small shuffle. The histogram has at most one row for each length that occurs, and its
suffix sums are taken in blocks of lengths, so no task gathers it whole.

Defined cases: a null or empty text has length 0. Repeated rows count each time. An empty table has an
empty histogram.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.llm.common import annotate, materialise, table
from kinmesh.llm.encoding import default_vocabulary, encoder

#: Lengths that one task sums.
BLOCK = 4096


def lengths(docs: DataFrame, vocabulary: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, the length of the encoded text."""
    path = vocabulary or default_vocabulary()
    return annotate(docs, {"n_tokens": "long"}, lambda texts: [[len(encoder(path).ids(t)) if t else 0 for t in texts]], text, carry)


def histogram(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """One row for each length that occurs: n_tokens and n_docs."""
    return lengths(docs, vocabulary, text, carry=[]).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """What each context limit (every length that occurs) answers, by suffix sums of the histogram.

    Columns: context_limit; n_docs of just that length; docs_longer and tokens_longer (of documents beyond the
    limit); docs_within and tokens_within; tokens_truncated (sum of min(length, limit)); tokens_lost; share_within
    (of documents: the quantile at which this limit stands).
    """
    hist = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), (F.col("n_tokens") / BLOCK).cast("long").alias("block"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], F.sum("d").over(all_of).alias("d_all"), F.sum("t").over(all_of).alias("t_all"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = hist.select("*", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("t"))
    limit = F.col("n_tokens")
    out = own.join(blocks, "block").select(limit.alias("context_limit"), "n_docs", (F.col("d") + F.col("d_after")).alias("docs_longer"), (F.col("t") + F.col("t_after")).alias("tokens_longer"), "d_all", "t_all")
    cut = F.col("tokens_longer") - F.col("context_limit") * F.col("docs_longer")
    return out.select(
        "context_limit",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_within"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_within"),
        (F.col("t_all") - cut).alias("tokens_truncated"),
        cut.alias("tokens_lost"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("share_within"),
    )


def answers_at(hist: DataFrame, given: list[int]) -> DataFrame:
    """What the context limits ``given`` answer, whether or not a document has just that length; columns as of :func:`limits`.

    The given limits are few and meet every row of the histogram, whose sums are combined before their exchange. Repeated limits are
    answered once; an empty histogram answers none.
    """
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in sorted(set(given))], "context_limit long")
    limit, n, docs = F.col("context_limit"), F.col("n_tokens"), F.col("n_docs")
    sums = hist.crossJoin(F.broadcast(wanted)).groupBy("context_limit").agg(
        F.sum(F.when(n == limit, docs).otherwise(0)).alias("n_docs"),
        F.sum(F.when(n > limit, docs).otherwise(0)).alias("docs_longer"),
        F.sum(F.when(n > limit, n * docs).otherwise(0)).alias("tokens_longer"),
        F.sum(F.when(n <= limit, docs).otherwise(0)).alias("docs_within"),
        F.sum(F.when(n <= limit, n * docs).otherwise(0)).alias("tokens_within"),
    )
    return sums.select(
        "*",
        (F.col("tokens_within") + limit * F.col("docs_longer")).alias("tokens_truncated"),
        (F.col("tokens_longer") - limit * F.col("docs_longer")).alias("tokens_lost"),
        (F.col("docs_within") / (F.col("docs_within") + F.col("docs_longer"))).alias("share_within"),
    )


def quantile(answers: DataFrame, q: float) -> int | None:
    """The least length that at least the share ``q`` of the documents stay within; None for an empty table."""
    if not 0 < q <= 1:
        raise ValueError("q has to lie in (0, 1]")
    row = answers.filter(F.col("share_within") >= math.nextafter(q, 0)).agg(F.min("context_limit").alias("x")).first()
    return row["x"]


def op6_token_counts(spark, sf_dir):
    """The answers for every context limit over all of ``documents``."""
    return limits(materialise(histogram(table(spark, sf_dir, "documents")), "lengths"))
