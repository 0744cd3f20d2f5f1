"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after lower-casing A-Z; a text's digest
is the SHA-256 of that form. A Misra-Gries sketch of ``counters`` entries runs
over the digests of each partition; the summed sketches name at most
``counters + 1`` digests, among them every one with a share of
2 / (counters + 1) of all rows. Their exact counts and winners are then taken
with map-side combine and broadcast (at most ``counters + 1`` rows), so that
rows of large groups are settled where they are read and never meet in one task.
All other digests use an ordinary shuffle, whose groups are small by then.

Of equal texts the row with the largest id stays, and of repeated rows with that
id exactly one. Null texts count as empty, null ids sort below all others. An
empty table gives an empty result. Other columns may have any names: ``dedup``
carries them in a struct of their own, ``mark`` does not read them. Every text
is digested whole; only digests are shuffled by ``mark``.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.llm.common import map_rows
from tilesieve.plans.shared import materialize

COUNTERS = 1024
LEAST = 32  # rows that a group needs to be worth a place in the broadcast


@F.pandas_udf(T.BinaryType())
def text_digest(text: pd.Series) -> pd.Series:
    # bytes.lower() changes A-Z only
    return text.map(lambda t: hashlib.sha256(t.encode().lower()).digest())


class MisraGries:
    """Frequent items: an item's count is at most ``seen / (counters + 1)`` below its true one."""

    def __init__(self, counters: int):
        self.counters, self.counts = counters, {}

    def add(self, item) -> None:
        counts = self.counts
        if item in counts:
            counts[item] += 1
        elif len(counts) < self.counters:
            counts[item] = 1
        else:
            for k in [k for k, n in counts.items() if n == 1]:
                del counts[k]
            for k in counts:
                counts[k] -= 1


def heavy_digests(tagged: DataFrame, counters: int) -> DataFrame:
    """``(digest)`` of the heavy hitters, at most ``counters + 1`` rows."""

    def sketch(batches):
        mg = MisraGries(counters)
        for batch in batches:
            for d in batch.column(0).to_pylist():
                mg.add(d)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(mg.counts), pa.binary()), "n": pa.array(list(mg.counts.values()), pa.int64())})

    least = max(LEAST, tagged.count() / (counters + 1))
    found = tagged.select("digest").mapInArrow(sketch, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = [(bytes(r.digest),) for r in found.select("digest").collect()]
    return tagged.sparkSession.createDataFrame(rows, "digest binary")


def _winners(tagged: DataFrame, counters: int) -> DataFrame:
    """Exact size and winner of each heavy digest."""
    heavy = F.broadcast(heavy_digests(tagged, counters))
    out = tagged.join(heavy, "digest").groupBy("digest").agg(F.max(F.struct("id", "row_id")).alias("winner"), F.count("*").alias("group_size"))
    return materialize(out, "winners")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row."""
    tagged = docs.select(F.col(id_col).cast("bigint").alias("id"), text_digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"))
    tagged = materialize(tagged.withColumn("row_id", F.monotonically_increasing_id()), "digests")
    winners = F.broadcast(_winners(tagged, counters))
    hot = tagged.join(winners, "digest")
    others = tagged.join(winners, "digest", "left_anti")
    # counted with map-side combine and joined back: no task buffers a group
    groups = others.groupBy("digest").agg(F.max(F.struct("id", "row_id")).alias("winner"), F.count("*").alias("group_size"))
    rest = others.join(groups, "digest").select("digest", "id", "row_id", "winner", "group_size")
    both = hot.select(rest.columns).union(rest)
    return both.select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("winner.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns.

    The rows are written down without Python and digested from there: a Python function
    beside other columns holds the whole rows of its batches in the heap of the task that
    reads and writes them.
    """
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"))
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")

    def start():
        def step(ids, row_ids, texts):
            return [[hashlib.sha256(t.encode().lower()).digest() for t in texts], ids, row_ids]

        return step

    tagged = map_rows(rows.select("id", "row_id", text.alias("text")), "digest binary, id bigint, row_id bigint", start)
    tagged = materialize(tagged, "digests")
    winners = F.broadcast(_winners(tagged, counters))
    others = tagged.join(winners, "digest", "left_anti").groupBy("digest").agg(F.max(F.struct("id", "row_id")).alias("winner"))
    stay = winners.select("winner.row_id").union(others.select("winner.row_id"))
    return rows.join(stay, "row_id", "left_semi").select("row.*")
