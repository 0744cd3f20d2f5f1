"""Scores a filtered run against the truth (SIM-9, AGG-22, JN-13, JN-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesieve.functions import names
from tilesieve.operators.components import connected_components
from tilesieve.sources.fastq import read_records, uri

TRUTH = "emitted_rank bigint, read_name string, molecule bigint, mechanism string, parent_read_name string, cross_tile int"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(uri(path), sep="\t", header=True, schema=TRUTH)


def kept_names(spark: SparkSession, filtered_r1: str) -> DataFrame:
    return read_records(spark, filtered_r1).select(names.normalized_name(F.col("header")).alias("read_name"))


def score(truth: DataFrame, kept: DataFrame, label: str = "run") -> dict:
    """Of a family (linked by optical children and their parents) all but one may go; more
    than that, or reads of no family, are false."""
    gone = truth.join(kept.withColumn("kept", F.lit(True)), "read_name", "left").withColumn("hit", F.col("kept").isNull().cast("int"))
    parent = truth.select(F.col("read_name").alias("parent_read_name"), F.col("emitted_rank").alias("parent_rank"))
    links = truth.where("mechanism = 'optical'").join(parent, "parent_read_name").select(F.col("emitted_rank").alias("l"), F.col("parent_rank").alias("r"))
    family = connected_components(links, "l", "r").withColumnRenamed("node", "emitted_rank")
    members = gone.join(family, "emitted_rank")
    each = members.groupBy("component").agg((F.count("*") - 1).alias("may_go"), F.sum("hit").alias("hits"), F.max("cross_tile").alias("crossed"))
    right = F.least("hits", "may_go")
    crossed = F.col("crossed") == 1
    row = each.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("may_go"), right, F.col("hits") - right, F.when(crossed, F.col("may_go")), F.when(crossed, right)))).first()
    removable, correct, too_many, cross_removable, cross_correct = row
    stray = {r.mechanism: r.n for r in gone.where("hit = 1").join(family, "emitted_rank", "left_anti").groupBy("mechanism").agg(F.count("*").alias("n")).collect()}
    total, removed = gone.agg(F.count("*"), F.sum("hit")).first()
    wrong = sum(stray.values()) + too_many
    null_wrong = wrong - stray.get("polyg", 0)

    def share(a, b):
        return a / b if b else None

    return {
        "label": label,
        "input_read_pairs": total,
        "removed_read_pairs": removed,
        "true_optical_removable": removable,
        "true_positives": correct,
        "false_positives": wrong,
        "false_negatives": removable - correct,
        "sensitivity": share(correct, removable),
        "empirical_read_level_fdr": wrong / removed if removed else 0.0,
        "spatially_null_fdr": null_wrong / removed if removed else 0.0,
        "spatially_null_false_positives": null_wrong,
        "false_positives_by_true_mechanism": dict(sorted(stray.items())),
        "cross_tile_removable": cross_removable,
        "cross_tile_recovered": cross_correct,
        "cross_tile_sensitivity": share(cross_correct, cross_removable),
        "same_tile_removable": removable - cross_removable,
        "same_tile_recovered": correct - cross_correct,
        "same_tile_sensitivity": share(correct - cross_correct, removable - cross_removable),
    }


def retrieval_recall(truth: DataFrame, tested: DataFrame) -> float:
    """Share of true optical pairs among the tested ones (AGG-25). ``tested``: two name columns."""
    a, b = tested.columns[:2]
    wanted = truth.where("mechanism = 'optical' and parent_read_name != 'NA'").select(F.least("read_name", "parent_read_name").alias("a"), F.greatest("read_name", "parent_read_name").alias("b")).distinct()
    found = wanted.join(tested.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), ["a", "b"], "left_semi")
    n = wanted.count()
    return found.count() / n if n else 0.0
