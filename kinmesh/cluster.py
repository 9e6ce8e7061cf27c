"""What a cluster needs: the package for Python workers (sent unless their search path has it), and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application; the driver serves the file."""
    context = spark.sparkContext
    if str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a folder of the warehouse is taken on one machine (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends at a table that every executor sees."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*written: DataFrame) -> None:
    """Deletes tables that :func:`materialise` wrote, once nothing reads them any more."""
    for df in written:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.written_to).getParent()
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
