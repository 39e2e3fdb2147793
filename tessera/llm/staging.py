"""Tables that cut lineage: written to the folder that the cluster shares, so that they outlive executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.staging import shared_dir, ship


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back with its schema."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at its end; what is to outlive it is staged after it, by keep()."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


def keep(df: DataFrame, name: str = "result") -> DataFrame:
    """Stage df for those outside of the innermost scratch()."""
    out = stage(df, name)
    if _scratch and len(_scratch[-1]):
        path = _scratch[-1].pop()
        if len(_scratch) > 1:
            _scratch[-2].append(path)
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Prepare for Python workers: send them this package, and lower the limit of bytes in an Arrow batch to BATCH_BYTES.

    A batch is held by the JVM and by the Python worker at once, and long texts make one of 10,000 rows very large.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
