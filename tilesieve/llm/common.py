"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str, key_type: str = "bigint") -> DataFrame:
    """``(id, text)`` with null text as empty; whatever else the input has, and how
    it is named, no longer matters below."""
    return docs.select(F.col(id_col).cast(key_type).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """Run ``start()`` once a task and its result on each batch's columns.

    The result takes one Python list a column and gives one list (or Arrow
    array) an output column. Batches keep memory bounded by Spark's Arrow batch
    size, whatever a partition holds.
    """
    struct = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                out = step(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)
