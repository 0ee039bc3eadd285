"""Storing a result that several consumers read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# folders of the open scratch blocks, below the application's, the innermost last
_blocks: ContextVar[tuple[str, ...]] = ContextVar("_blocks", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session without one gets a folder in its warehouse. Driver and executors must share either, so a
    folder on a local disk is refused unless they are one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(
                f"set spark.checkpoint.dir to a folder that all executors share: the warehouse is local ({folder})")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path that nothing has, in the innermost scratch block."""
    return "/".join([session_folder(spark), *_blocks.get(), uuid.uuid4().hex])


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and read that.

    The stored table outlives lost executors, lets each consumer read only its
    columns and tells the planner the true size, so joins with it are broadcast
    only when it is small.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """A short list that will be put into one row; more than ``most`` rows end the query with an error."""
    first = df.limit(most + 1)
    fits = F.assert_true(first.agg(F.count(F.lit(1))).scalar() <= most, F.lit(f"{what}: more than {most} rows"))
    return first.filter(fits.isNull())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored tables are removed at its end.

    Yields a function that stores a table outside the block. What leaves the block must have been stored by it.
    """
    outer = _blocks.get()
    block = uuid.uuid4().hex

    def keep(df: DataFrame) -> DataFrame:
        token = _blocks.set(outer)
        try:
            return cut(df)
        finally:
            _blocks.reset(token)

    token = _blocks.set((*outer, block))
    try:
        yield keep
    finally:
        _blocks.reset(token)
        _remove(spark, "/".join([session_folder(spark), *outer, block]))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_stored(spark: SparkSession) -> None:
    """Remove what this application has stored, at the end of a job."""
    _remove(spark, session_folder(spark))
