"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder (tests); any other master is refused,
    since executors on other machines could not read what is written there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _written.append((spark, folder))
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends at the files, which outlive
    executors, and each reader prunes its own columns. Removed at the end of the ``scope`` around it, or of the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """``with scope(): ...`` removes the tables written inside at its end. Results must have been written or collected by
    then. A long session that runs many queries should put each into one."""
    before = len(_written)
    try:
        yield
    finally:
        _remove(before)


def _remove(first: int) -> None:
    """Removes what was written since; what cannot be removed does not keep the rest."""
    while len(_written) > first:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_remove, 0)
