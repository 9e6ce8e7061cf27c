"""Linking a stream of records against fixed targets: each micro-batch is a plan of its own (stateless).

Targets are normalised and indexed once, as tables in the shared folder that every micro-batch reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kinmesh.cluster import shared_folder
from kinmesh.operators import blocking, records
from kinmesh.plans.pipeline import Linked, link_prepared, once
from kinmesh.settings import Settings


def link_stream(stream: DataFrame, targets: DataFrame, sink: Callable[[Linked, int], None], checkpoint: str, ensemble: list | None = None, settings: Settings = Settings()):
    """Starts the query; ``sink`` gets what each micro-batch linked, and its number for idempotent writes."""
    spark = targets.sparkSession
    folder = shared_folder(spark)
    normalised = records.normalise(once(targets), settings.strip_domain_words)
    normalised.write.parquet(f"{folder}/targets")
    normalised = spark.read.schema(normalised.schema).parquet(f"{folder}/targets")
    index = blocking.prune(blocking.inverted_index(normalised), settings.max_postings)
    index.write.partitionBy("country").parquet(f"{folder}/index")
    index = spark.read.schema(index.schema).parquet(f"{folder}/index")

    def batch(rows: DataFrame, number: int) -> None:
        sink(link_prepared(rows, normalised, index, ensemble, settings), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
