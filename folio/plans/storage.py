"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written since passing_tables() began.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Only where that setting is absent and the master is local, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, file_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no recomputation.

    file_rows: rows of a file at most, if given.
    """
    path = shared_dir(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at its end, but for those written by what it gives: the results, which are to depend on no other of them.

    Scopes nest: what an inner one keeps passes with the outer one.
    """
    outer, own = _PASSING.get(), []
    token = _PASSING.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _PASSING.set(outer)
        try:
            return written(df, name)
        finally:
            _PASSING.reset(inside)

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
