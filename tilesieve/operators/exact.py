"""The exact-match, fixed-distance mode (entry C: JN-9 to JN-11, AGG-21, FLT-10, FLT-11).

``reads``: ``pair_index, signature, location, x, y, quality_score, read_name``.
Reads with one signature at one location (lane and tile) that are within a
distance in both coordinates, directly or through others, are duplicates; the
best of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.operators.components import connected_components
from tilesieve.plans.shared import materialize


def exact_families(reads: DataFrame) -> DataFrame:
    """``(signature, size)`` of two and more (AGG-21)."""
    return reads.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1")


def family_stats(reads: DataFrame) -> DataFrame:
    """One row: families, their members and the members beyond one each."""
    return exact_families(reads).agg(F.count("*").alias("families"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("excess"))


def crowded(reads: DataFrame) -> DataFrame:
    """Reads that share signature and location with another (FLT-10, JN-9)."""
    sizes = reads.where("location is not null").groupBy("signature", "location").agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    return reads.join(sizes, ["signature", "location"])


def proximity_links(reads: DataFrame, distance: int) -> DataFrame:
    """``(l, r)`` with l < r: all pairs within the distance (JN-10).

    Square cells as wide as the distance: a read is joined with the reads of its own
    and the eight cells around, so pairs are only formed among neighbours. For
    components alone ``proximity_edges`` needs far fewer.
    """
    rows = crowded(reads).select("signature", "location", "pair_index", "x", "y")
    size = max(1, distance)
    cells = rows.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    sent = cells.select("signature", "location", F.col("pair_index").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), "cx", "cy", around.alias("d"))
    sent = sent.select("signature", "location", "l", "lx", "ly", (F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy"))
    met = sent.join(cells, ["signature", "location", "cx", "cy"])
    return met.where((F.col("l") < F.col("pair_index")) & (F.abs(F.col("lx") - F.col("x")) <= distance) & (F.abs(F.col("ly") - F.col("y")) <= distance)).select("l", F.col("pair_index").alias("r"))


def proximity_edges(reads: DataFrame, distance: int) -> DataFrame:
    """Links with the components of ``proximity_links``, linear in the reads of a dense spot.

    Reads of one cell that spans the distance all link, so there the first
    stands for all, and two cells around each other need one link at most.
    """
    rows = crowded(reads).select("signature", "location", "pair_index", "x", "y")
    width = distance + 1
    key = ["signature", "location", "cx", "cy"]
    cells = rows.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
    first = cells.groupBy(*key).agg(F.min("pair_index").alias("first"), F.count("*").alias("n"))
    inside = cells.join(first.where("n > 1"), key).where("pair_index != first").select(F.col("first").alias("l"), F.col("pair_index").alias("r"))
    ahead = [(0, 1), (1, -1), (1, 0), (1, 1)]
    sent = first.select("signature", "location", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ahead))).alias("d"))
    pairs = sent.select("signature", "location", "fx", "fy", (F.col("fx") + F.col("d.a")).alias("cx"), (F.col("fy") + F.col("d.b")).alias("cy")).join(first.select(key), key)
    near = pairs.join(cells.select("signature", "location", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("pair_index").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly")), ["signature", "location", "fx", "fy"])
    met = near.join(cells, key).where((F.abs(F.col("lx") - F.col("x")) <= distance) & (F.abs(F.col("ly") - F.col("y")) <= distance))
    across = met.groupBy("signature", "location", "fx", "fy", "cx", "cy").agg(F.min(F.struct("l", "pair_index")).alias("e")).select("e.l", F.col("e.pair_index").alias("r"))
    return inside.union(across)


def proximity_components(reads: DataFrame, distance: int) -> DataFrame:
    """``(pair_index, component)`` of reads with a link."""
    found = connected_components(proximity_edges(reads, distance), "l", "r")
    return found.select(F.col("node").alias("pair_index"), "component")


def removed_reads(reads: DataFrame, distance: int) -> DataFrame:
    """Removed reads and what they are represented by (D18, JN-11, SNK-12).

    ``pair_index, read_name, representative_index, representative_name, location, x, y,
    representative_x, representative_y, delta_x, delta_y, chebyshev_distance, component_size``.
    """
    members = materialize(proximity_components(reads, distance).join(reads, "pair_index"), "members")
    # the best is found with map-side combine and joined back: no task buffers a component
    best = F.max(F.struct("quality_score", (-F.col("pair_index")).alias("first"), "read_name", "x", "y"))
    rows = members.join(members.groupBy("component").agg(best.alias("best"), F.count("*").alias("component_size")), "component")
    return rows.where("pair_index != -best.first").select(
        "pair_index",
        "read_name",
        (-F.col("best.first")).alias("representative_index"),
        F.col("best.read_name").alias("representative_name"),
        "location",
        "x",
        "y",
        F.col("best.x").alias("representative_x"),
        F.col("best.y").alias("representative_y"),
        (F.col("x") - F.col("best.x")).alias("delta_x"),
        (F.col("y") - F.col("best.y")).alias("delta_y"),
        F.greatest(F.abs(F.col("x") - F.col("best.x")), F.abs(F.col("y") - F.col("best.y"))).alias("chebyshev_distance"),
        "component_size",
    )


def kept_reads(reads: DataFrame, removed: DataFrame) -> DataFrame:
    """Reads that stay (JN-12)."""
    return reads.join(removed.select("pair_index"), "pair_index", "left_anti")


def exact_report(reads: DataFrame, removed: DataFrame, distance: int) -> dict:
    """Counts of the run (SNK-13); removed and kept add up to the input."""
    total = reads.agg(F.count("*"), F.count_if(F.col("location").isNull())).first()
    fam = family_stats(reads).first()
    components = removed.groupBy("representative_index").agg(F.count("*").alias("n"))
    sizes = {str(r.s): r.c for r in components.groupBy((F.col("n") + 1).alias("s")).agg(F.count("*").alias("c")).orderBy("s").collect()}
    gone = removed.count()
    return {
        "component_size_histogram": sizes,
        "distance_threshold": distance,
        "exact_families": fam.families,
        "exact_family_members": fam.members,
        "exact_family_excess": fam.excess,
        "exact_excess_not_removed": fam.excess - gone,
        "input_read_pairs": total[0],
        "optical_components": sum(sizes.values()),
        "removed_read_pairs": gone,
        "retained_read_pairs": total[0] - gone,
        "unparsed_read_pairs": total[1],
    }
