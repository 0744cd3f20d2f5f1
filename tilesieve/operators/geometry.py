"""Tiles, the lane-wide coordinate frame and spatial predicates (FN-12 to FN-19, AGG-7).

Tables here:

* ``reads(pair_index, lane, tile, x, y, ...)``, unplaced reads with a null tile
* ``layout(tile, surface, col, row)``, one row a tile
* ``positions``: reads with ``surface, col, row, gx, gy`` added
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names of the tile numberings in reports.
SURFACE_SWATH_TILE = "illumina_surface_swath_tile"
SURFACE_SWATH_CAMERA_TILE = "illumina_surface_swath_camera_tile"
SINGLE_COLUMN = "unrecognised_single_column"

CONNECTED = ("same-tile", "adjacent", "lane")


@dataclass(frozen=True)
class Frame:
    """Run-wide numbers of the coordinate frame."""

    convention: str
    x_min: int
    y_min: int
    cell_x: int
    cell_y: int
    columns: int
    rows: int


def tile_convention(tiles: DataFrame) -> str:
    """How tile numbers are to be read, decided by all of them together."""
    text = F.col("tile").cast("string")
    shape = F.length(text)
    known = text.rlike("^[12]")
    row = tiles.agg(F.bool_and((shape == 4) & known).alias("four"), F.bool_and((shape == 5) & known).alias("five")).first()
    return SURFACE_SWATH_TILE if row.four else SURFACE_SWATH_CAMERA_TILE if row.five else SINGLE_COLUMN


def tile_layout(reads: DataFrame, convention: str | None = None) -> DataFrame:
    """``(tile, surface, col, row)`` with dense ranks over all tiles (WIN-9).

    The table has as many rows as the instrument has tiles, a few thousand at most.
    """
    tiles = reads.where("tile is not null").select("tile").distinct()
    convention = convention or tile_convention(tiles)
    text = F.col("tile").cast("string")
    if convention == SURFACE_SWATH_TILE:
        place = (F.substring(text, 1, 1), F.substring(text, 2, 1), F.substring(text, 3, 2))
    elif convention == SURFACE_SWATH_CAMERA_TILE:
        place = (F.substring(text, 1, 1), F.substring(text, 2, 1), F.concat(F.substring(text, 3, 1), F.lit("0"), F.substring(text, 4, 2)))
    else:
        place = (F.lit(1), F.lit(1), F.col("tile"))
    raw = tiles.select("tile", *(p.cast("int").alias(n) for p, n in zip(place, ("surface", "swath", "line"))))
    return raw.select(
        "tile",
        "surface",
        (F.dense_rank().over(Window.orderBy("swath")) - 1).alias("col"),
        (F.dense_rank().over(Window.orderBy("line")) - 1).alias("row"),
    )


def measure_frame(reads: DataFrame, layout: DataFrame, convention: str, tile_gap: int = 0) -> Frame:
    placed = reads.where("tile is not null")
    box = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        raise ValueError("no read has a lane, tile, X and Y that can be read")
    size = layout.agg(F.max("col"), F.max("row")).first()
    gap = max(0, tile_gap)
    return Frame(convention, box[0], box[2], box[1] - box[0] + 1 + gap, box[3] - box[2] + 1 + gap, size[0] + 1, size[1] + 1)


def place_reads(reads: DataFrame, layout: DataFrame, frame: Frame) -> DataFrame:
    """Placed reads with their tile's place and coordinates in the lane-wide frame.

    ``block`` is the spatial group: a lane and a surface.
    """
    joined = reads.where("tile is not null").join(F.broadcast(layout), "tile")
    return joined.select(
        *reads.columns,
        "surface",
        "col",
        "row",
        (F.col("col").cast("bigint") * frame.cell_x + F.col("x") - frame.x_min).alias("gx"),
        (F.col("row").cast("bigint") * frame.cell_y + F.col("y") - frame.y_min).alias("gy"),
    )


def grid_step(a: str, b: str) -> Column:
    """Distance in whole tiles between the ends ``a`` and ``b`` of a pair."""
    return F.greatest(F.abs(F.col(f"{a}col") - F.col(f"{b}col")), F.abs(F.col(f"{a}row") - F.col(f"{b}row")))


def step_limit(neighborhood: str, max_grid_step: int) -> int:
    return 0 if neighborhood == "same-tile" else max_grid_step


def is_testable(a: str, b: str, neighborhood: str, max_grid_step: int = 1) -> Column:
    """Whether a pair's tiles are close enough for a spatial test."""
    if neighborhood not in CONNECTED:
        raise ValueError(f"unknown neighbourhood {neighborhood}")
    same = F.col(f"{a}lane").eqNullSafe(F.col(f"{b}lane")) & (F.col(f"{a}surface") == F.col(f"{b}surface"))
    if neighborhood == "lane":
        return F.coalesce(same, F.lit(False))
    return F.coalesce(same & (grid_step(a, b) <= step_limit(neighborhood, max_grid_step)), F.lit(False))


def separation(dx: Column, dy: Column, metric: str) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy)).cast("double") if metric == "chebyshev" else F.hypot(dx, dy)


def pair_distance(a: str, b: str, testable: Column, metric: str = "chebyshev") -> Column:
    """Distance in the frame; null where there is no spatial test."""
    return F.when(testable, separation(F.col(f"{a}gx") - F.col(f"{b}gx"), F.col(f"{a}gy") - F.col(f"{b}gy"), metric))


def radius_grid(max_radius: float, resolution: int) -> np.ndarray:
    """Whole radii up to 256, then ``resolution`` in equal ratios up to the largest (FN-18)."""
    if not math.isfinite(max_radius) or max_radius < 0:
        return np.zeros(0)
    whole = np.arange(0.0, min(max_radius, 256.0) + 1.0)
    if max_radius <= 256.0:
        return np.unique(np.round(whole, 6))
    return np.unique(np.round(np.concatenate([whole, np.geomspace(257.0, max_radius, max(16, resolution)), [max_radius]]), 6))


def max_testable_distance(positions: DataFrame, frame: Frame, neighborhood: str, max_grid_step: int, metric: str) -> DataFrame:
    """``(lane, surface, max_radius)``: the largest distance a testable pair can have (FN-19)."""
    if neighborhood == "lane":
        span = (F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy"))
    else:
        steps = step_limit(neighborhood, max_grid_step) + 1
        span = (F.lit(steps * frame.cell_x), F.lit(steps * frame.cell_y))
    far = separation(span[0], span[1], metric)
    return positions.groupBy("lane", "surface").agg(F.when(F.count("*") > 1, far).otherwise(F.lit(0.0)).alias("max_radius"))


def tile_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy("lane", "surface", "tile", "col", "row").agg(F.count("*").alias("n"))


def tile_pairs(tiles: DataFrame, neighborhood: str, max_grid_step: int = 1) -> DataFrame:
    """Pairs of different tiles of one group that are close enough (JN-5); tiles are a small table."""
    a = tiles.select([F.col(c).alias(f"a_{c}") for c in tiles.columns])
    b = tiles.select([F.col(c).alias(f"b_{c}") for c in tiles.columns])
    near = F.col("a_lane").eqNullSafe(F.col("b_lane")) & (F.col("a_surface") == F.col("b_surface")) & (F.col("a_tile") < F.col("b_tile"))
    pairs = a.join(b, near)
    if neighborhood == "lane":
        return pairs
    return pairs.where(grid_step("a_", "b_") <= step_limit(neighborhood, max_grid_step))


def testable_relations(positions: DataFrame, neighborhood: str, max_grid_step: int = 1) -> DataFrame:
    """``(lane, surface, reads, relations, same_tile_relations, testable_relations)`` (AGG-7, AGG-11)."""
    tiles = tile_counts(positions)
    own = tiles.groupBy("lane", "surface").agg(F.sum("n").alias("reads"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).alias("same_tile_relations"))
    own = own.withColumn("relations", (F.col("reads") * (F.col("reads") - 1) / 2).cast("bigint"))
    if neighborhood == "same-tile":
        return own.withColumn("testable_relations", F.col("same_tile_relations"))
    cross = tile_pairs(tiles, neighborhood, max_grid_step).groupBy(F.col("a_lane").alias("l"), F.col("a_surface").alias("s")).agg(F.sum(F.col("a_n") * F.col("b_n")).alias("cross"))
    joined = own.join(cross, F.col("lane").eqNullSafe(F.col("l")) & (F.col("surface") == F.col("s")), "left")
    return joined.select("lane", "surface", "reads", "relations", "same_tile_relations", (F.col("same_tile_relations") + F.coalesce("cross", F.lit(0))).alias("testable_relations"))
