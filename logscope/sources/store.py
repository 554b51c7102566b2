"""Tables between the steps of one job, in the folder that all executors share.

A written table cuts the plan and its lineage: what follows scans files, reads only the
columns it needs, and reads them again when an executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the session names none and everything runs on one machine, a temporary folder
    is made once per application; on a cluster that would lose rows, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_shared_tables", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.sparkContext._shared_tables = named
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for one job, put back afterwards; __ stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table's files; what still reads it fails."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables of this application: for the owner of the session, at its end."""
    delete(spark, _folder(spark))
