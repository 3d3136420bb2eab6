"""Tables written in the course of a job, in a folder of its own below the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from receivables.session import checkpoint_folder

FILES_PER_CORE = 4
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_find_package(spark: SparkSession) -> None:
    """Local Python workers find this package like the driver does; a cluster gets it by its own means (--py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it, for tasks that read or write files themselves."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


@contextmanager
def written(folder: str, name: str) -> Iterator:
    """A file to write, under a name that readers skip until it stands whole."""
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        yield out
    store.move(temporary, f"{base}/{name}")


class Run:
    """A folder for one run's tables: ``stored`` writes a table and reads it back, which cuts its plan and survives lost
    executors; leaving the ``with`` block deletes the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.delete([self.folder])

    def few(self, df: DataFrame) -> DataFrame:
        """In few, larger partitions: a written file costs processes of its own (Hadoop's local file system changes its mode by
        starting a program beside the executor), and an executor that starts one is twice as large for a moment."""
        return df.coalesce(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def delete(self, paths: Iterable[str | None]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            if p:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
