"""What the training-data operators share: tables in the shared folder, and Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.plans.storage import passing_tables, shared_dir, table, written  # noqa: F401

#: ASCII white space, as the contracts' word pattern [^\x20\x09-\x0D]+ has it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1_024

_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in re.findall(r"(\w+) ([\w<>]+)", ddl)])


def map_arrow(df: DataFrame, work: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows, giving back what Arrow's pool keeps when a task ends.

    Texts of a batch are in the JVM's and the worker's memory at once, and workers stay for later tasks with
    what they hold. The limit is the session's setting, which is lowered if it is larger.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict], ddl: str, rows: int = 512) -> DataFrame:
    """mapInArrow with a function from columns (lists) to columns, at most `rows` input rows at once."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return map_arrow(df, run, ddl)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
