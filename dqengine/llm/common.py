"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, stage_dir

#: ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09-\x0d"


def staged(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the session's shared folder and read it back.

    Lineage ends there: a lost executor re-reads files instead of re-running
    the scan, and plans that use the table twice do not compute it twice.
    """
    spark = spark or df.sparkSession
    return materialize(df, f"{stage_dir(spark)}/t")


#: Rows of text that Spark hands to a Python worker at once.
BATCH_ROWS = 1000


def text_rows(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs`` with just these columns, on their way to Python workers: Arrow
    batches of texts are kept short (both sides hold a whole batch)."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs.select(*columns)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column ``name`` as ``kind``, or a typed null where ``df`` has none."""
    if name in df.columns:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def arrow_rows(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that a batch of very long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def schema_of(spec: str) -> tuple[T.StructType, pa.Schema]:
    """A Spark schema and its Arrow twin from a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    s = T._parse_datatype_string(spec)
    return s, to_arrow_schema(s)
