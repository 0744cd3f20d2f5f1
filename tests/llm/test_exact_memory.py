"""What a task holds of texts while a stage of the pipeline is written."""

import glob

import numpy as np
import pyarrow.parquet as pq

from tilesieve.llm import exact_dedup
from tilesieve.plans import shared


def test_written_tables_have_small_row_groups(spark, tmp_path):
    random = np.random.default_rng(5)
    rows = [(i, random.bytes(3000).hex()) for i in range(8000)]  # 24 MB compressed
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = shared.materialize(spark.read.parquet(f"{tmp_path}/in"), "texts")
    files = glob.glob(f"{out._tilesieve_path.removeprefix('file://')}/*.parquet")
    found = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in found) == 8000
    assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in found) < 12 << 20


def test_no_python_beside_whole_rows(spark, monkeypatch):
    """Digests are made from written rows: a Python function beside a row's columns holds its batches in the heap."""
    written = []

    def recorded(df, label):
        written.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return shared.materialize(df, label)

    monkeypatch.setattr(exact_dedup, "materialize", recorded)
    rows = [(1, "a B"), (2, "A b"), (2, "a b"), (None, "c"), (3, None), (4, "")]
    out = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id is None, r.doc_id, r.text.lower()) for r in out.collect()) == [(False, 2, "a b"), (False, 4, ""), (True, None, "c")]
    whole = [plan for columns, plan in written if "row" in columns]
    assert whole and not any("Python" in plan or "InArrow" in plan for plan in whole)
