"""Tab-separated audits of pairs, removed reads and tested reads (SNK-4 to SNK-6).

Their column names and order are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesieve.functions.numbers import significant
from tilesieve.operators import multiplicity
from tilesieve.sources.sink import write_table


def _group(lane: str = "lane", surface: str = "surface") -> Column:
    return F.concat(F.col(lane), F.lit(":surface"), F.col(surface).cast("string"))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _texts(df: DataFrame, six: list[str], eight: list[str]) -> DataFrame:
    return df.withColumns({**{c: significant(F.col(c), 6) for c in six}, **{c: significant(F.col(c), 8) for c in eight}})


def candidate_audit(a) -> tuple[DataFrame, list[str]]:
    """A row a tested pair, whatever the inference unit; q-values are on pairs' p-values."""
    p = a.tested.select(F.col("edge_id").alias("id"), "spatial_p", F.col("conditional_p").alias("p"), "posterior", "compatibility_p")
    q, _ = multiplicity.local_fdr(p, a.config.pi0_lambda)
    q = multiplicity.local_fdr_q(q)
    q = multiplicity.bh_q(q, "spatial_p")
    q = multiplicity.by_q(q, "spatial_p")
    q = multiplicity.weighted_bh_q(q, "spatial_p")
    methods = {"bh": "q_bh", "by": "q_by", "local_fdr": "q_local_fdr", "weighted_bh": "q_weighted_bh"}
    chosen = methods.get(a.method.replace("-", "_"), "q_by")
    rows = a.tested.join(q.select(F.col("id").alias("edge_id"), "local_fdr", "weight", *methods.values()), "edge_id")
    for end, k in (("l", 1), ("r", 2)):
        side = a.reads.select(F.col("pair_index").alias(end), F.col("read_name").alias(f"read_pair_{k}_name"), F.col("tile").alias(f"tile_{k}"), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}"))
        rows = rows.join(side, end)
    out = rows.select(
        F.col("edge_id").alias("candidate_edge_id"),
        (F.col("l") + 1).alias("read_pair_1_index"), "read_pair_1_name", (F.col("r") + 1).alias("read_pair_2_index"), "read_pair_2_name",
        "lane", _group().alias("spatial_group"), "tile_1", "x_1", "y_1", "tile_2", "x_2", "y_2",
        _flag(F.col("same_tile")).alias("same_tile"), F.col("grid_step").alias("tile_grid_step"), _flag(F.col("testable")).alias("testable_relation"),
        F.col("distance").alias("spatial_distance"), F.col("mismatches").alias("observed_mismatches"), F.col("expected_mismatches").alias("expected_mismatches_from_phred"),
        F.col("mismatch_surprisal").alias("quality_weighted_mismatch_surprisal"), F.col("compatibility_p").alias("sequence_compatibility_p"), F.col("log10_bayes_factor").alias("sequence_log10_bayes_factor"),
        F.col("posterior").alias("same_template_posterior"), F.col("spatial_p").alias("spatial_p_value"), F.col("conditional_p").alias("conditional_spatial_p_value"), "local_fdr", F.col("weight").alias("sequence_weight"),
        *(F.col(c).alias(f"{m}_q_value") for m, c in methods.items()), F.col(chosen).alias("selected_q_value"), _flag(F.col(chosen) <= a.config.fdr).alias("called_optical_at_target_fdr"),
    )
    columns = out.columns
    numbers = columns[columns.index("expected_mismatches_from_phred") : columns.index("called_optical_at_target_fdr")]
    return _texts(out, ["spatial_distance"], numbers), columns


def write_candidate_audit(a, path: str) -> None:
    table, columns = candidate_audit(a)
    write_table(table, path, "candidate_edge_id", columns)


def removed_audit(a) -> tuple[DataFrame, list[str]]:
    """A row a removed read: its representative and the hypothesis that it went for."""
    read_unit = a.config.inference_unit == "read"
    support = a.units.select(F.col("id").alias("support_id"), F.col("nearest_distance").alias("support_distance"), *((F.col("partner_count"), F.col("neighbours")) if read_unit else (F.lit(None).cast("bigint").alias("partner_count"), F.lit(None).cast("bigint").alias("neighbours"))), "edge_id", F.col("p").alias("support_spatial_p"), F.col("local_fdr").alias("support_local_fdr"), F.col("q").alias("support_q"))
    rows = a.removed.join(support, "support_id").join(a.tested.select("edge_id", "mismatches", "expected_mismatches", "compatibility_p"), "edge_id")
    for own, name in (("read", "removed"), ("representative", "representative"), ("support_other", "supporting")):
        rows = rows.join(a.reads.select(F.col("pair_index").alias(own), F.col("read_name").alias(f"{name}_read_name")), own)
    out = rows.select(
        (F.col("read") + 1).alias("removed_pair_index"), "removed_read_name", (F.col("representative") + 1).alias("representative_pair_index"), "representative_read_name",
        "component_id", "component_size", "component_edge_count", "component_min_q", (F.col("support_other") + 1).alias("supporting_pair_index"), "supporting_read_name",
        "support_distance", F.col("partner_count").alias("support_candidate_partners"), F.col("neighbours").alias("support_neighbours_within_distance"), F.col("mismatches").alias("support_mismatches"),
        F.col("expected_mismatches").alias("support_expected_mismatches"), F.col("compatibility_p").alias("support_sequence_compatibility_p"), "support_spatial_p", "support_local_fdr", "support_q",
    )
    eight = ["component_min_q", "support_expected_mismatches", "support_sequence_compatibility_p", "support_spatial_p", "support_local_fdr", "support_q"]
    return _texts(out, ["support_distance", "support_neighbours_within_distance"], eight), out.columns


def write_removed_audit(a, path: str) -> None:
    table, columns = removed_audit(a)
    write_table(table, path, "removed_pair_index", columns)


def read_audit(a) -> tuple[DataFrame, list[str]]:
    """A row a tested read: its nearest look-alike, how crowded its place is, the call."""
    names = a.reads.select("pair_index", "read_name", "lane", "tile", "x", "y")
    place = a.positions.select("pair_index", "surface")
    partner = names.select(F.col("pair_index").alias("r"), F.col("read_name").alias("nearest_partner_name"), F.col("tile").alias("nearest_partner_tile"))
    gone = a.removed.select(F.col("read").alias("l"), F.lit(1).alias("removed"))
    rows = a.units.join(names.join(place, "pair_index").withColumnRenamed("pair_index", "l"), "l").join(partner, "r", "left").join(gone, "l", "left")
    out = rows.select(
        (F.col("l") + 1).alias("read_pair_index"), "read_name", "lane", _group().alias("spatial_group"), "tile", "x", "y",
        F.coalesce(F.col("r") + 1, F.lit(0)).alias("nearest_partner_index"), "nearest_partner_name", "nearest_partner_tile",
        F.coalesce("nearest_distance", F.lit(float("inf"))).alias("nearest_partner_distance"), _flag(F.col("tile") != F.col("nearest_partner_tile")).alias("cross_tile"), F.col("partner_count").alias("candidate_partners"),
        F.coalesce(F.col("neighbours").cast("double"), F.lit(float("inf"))).alias("neighbours_within_distance"), (F.col("population") + 1).alias("group_read_pairs"), F.col("p").alias("spatial_p_value"), "local_fdr",
        *(F.col(c).alias(f"{m}_q_value") for m, c in sorted(a.methods.items())), F.col("q").alias("selected_q_value"), _flag(F.col("q") <= a.config.fdr).alias("called_optical_at_target_fdr"), F.coalesce("removed", F.lit(0)).alias("removed"),
    )
    columns = out.columns
    eight = columns[columns.index("spatial_p_value") : columns.index("called_optical_at_target_fdr")]
    return _texts(out, ["nearest_partner_distance", "neighbours_within_distance"], eight), columns


def write_read_audit(a, path: str) -> None:
    table, columns = read_audit(a)
    write_table(table, path, "read_pair_index", columns)
