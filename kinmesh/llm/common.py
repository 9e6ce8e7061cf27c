"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.cluster import discard, materialise, shared_folder, ship  # noqa: F401

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_REGEX = r"[\x20\x09-\x0D]+"

#: Rows a Python worker gets at once; documents may be long, so batches are short.
ARROW_ROWS = 512
#: Bytes of text that the numpy kernels take at once.
CHUNK_BYTES = 2 << 20
#: Longest text that a classifier's bounded sample takes.
SAMPLE_BYTES = 1 << 17
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the Parquet tables under ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Limits the rows of an Arrow batch, so that a run of very long texts fits a worker; called before any Python function, it also sends workers the package.

    A smaller limit of the session stays. Spark reads the limit when a plan runs, so it cannot be that of one plan alone.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the hold-out rule of the contracts. Null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(n)), F.lit(0))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def word_slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in order, those of about :data:`CHUNK_BYTES` at a time.

    bytes.lower and bytes.split know ASCII letters and ASCII white space only, as the word definition has it.
    """
    if not text:
        return
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
        end = end.start() if end else len(text)
        if words := text[at:end].lower().split():
            yield words
        at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, nulls as empty texts."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def annotate(docs: DataFrame, fields: dict[str, str], func, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds columns that ``func(list of texts)`` computes, a list or array for each of ``fields`` (name: Spark type).

    ``carry`` names the input columns to keep (all by default); one that has the name of a result is replaced by it.
    Null texts reach ``func`` as None. Nothing is shuffled.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    results = {name.lower() for name in fields}
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in results]
    source = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").alias("__text"))
    kinds = {name: T._parse_datatype_string(kind) for name, kind in fields.items()}
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(name, kind) for name, kind in kinds.items()]])
    arrow = [to_arrow_type(kind) for kind in kinds.values()]
    names = [*own, *fields]

    def run(batches):
        for batch in chunks(batches, "__text"):
            made = func(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, type=kind) for x, kind in zip(made, arrow, strict=True)]], names=names)

    return source.mapInArrow(run, schema)


def known_labels(labels: DataFrame, label: str, folds: int, left_out: int) -> DataFrame:
    """(doc_id, label) of labelled ids, without those of the fold ``left_out``. Null labels teach nothing; of contradicting labels of one id the larger counts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != left_out))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def label_totals(known: DataFrame) -> dict[int, int]:
    return {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int) -> tuple[DataFrame, dict[int, int]]:
    """As :func:`labelled_sample`, but of every labelled document, however long; ids and texts are dealt by id and nothing is broadcast."""
    known = known_labels(labels, label, folds, left_out)
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != left_out))
    found = texts.join(known.hint("shuffle_hash"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return found.select("text", "label"), label_totals(known)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, left_out: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels to learn from: about ``per_class`` documents of each label value (0 and 1), by a hash of the id.

    Rows of the fold ``left_out`` (crc32 of the id modulo ``folds``) are never taken. Also returns how many labelled
    ids of each value there are. The sample of ids is bounded, so it alone is broadcast to the scan of the texts; a text that
    an id has several times is taken once, one of more than :data:`SAMPLE_BYTES` is not learned from, and of several texts of an id one is. Null
    labels teach nothing; of contradicting labels of one id the larger counts.
    """
    known = known_labels(labels, label, folds, left_out)
    totals = label_totals(known)
    share = F.lit(0.0)
    for value, n in totals.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    ids = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * float(1 << 20))
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label"), totals
