"""Raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, as Parquet; all but the last return
the columns of ``documents``. ``ORACLE_SQL`` is None: the classifier, SimHash and
the packing cannot be said in SQL, and the run is tested against a plain
version instead.

Edge cases: null and empty texts have no words and go in the first stage; very long
texts are read whole by every stage; of rows with equal or near texts the exact stage
keeps the largest id and the near stage the smallest, of repeated rows exactly one;
null ids are kept and never held out; an empty table gives no rows; extra columns, also
ones whose names the operators use, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilesieve.llm import exact_dedup, packing, quality_fm, quality_rules, simhash
from tilesieve.llm.common import table
from tilesieve.llm.queries import vocabulary
from tilesieve.plans.shared import discard, materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, then documents that the rules reject. The least number of words that
    the query op5 has by its contract is no rule here: a short text may be a clean one."""
    return quality_rules.clean(docs, limits=quality_rules.Limits(min_words=1))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a low score go; learnt from the labels of the documents."""
    model = quality_fm.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_fm.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word similarity of 0.8 and more) one stays."""
    return simhash.dedup(docs, size=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # a stage's copy goes as soon as the next one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
