"""Nearest partners, neighbour counts and their p-values (AGG-8, AGG-10, JN-6, JN-7,
FN-20 to FN-23, ST-4 to ST-9).

Neighbour counts are range counts with a radius of their own for each query. They
are never joined out to rows: a tile's points are indexed once, and all queries of
all replicates that touch the tile are counted together, squares by a wavelet
matrix, discs by cells of which only those on the rim are looked into.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.operators.geometry import Frame, tile_counts, tile_pairs
from tilesieve.plans.ordered import Ordered
from tilesieve.plans.shared import materialize

QUERIES = 1_000_000
PAIR_BLOCK = 250_000


def both_directions(edges: DataFrame, extra: list[str]) -> DataFrame:
    """``(read, partner, is_right_end, ...)``: each edge from either end."""
    left = edges.select(F.col("l").alias("read"), F.col("r").alias("partner"), F.lit(0).alias("end"), *extra)
    return left.unionByName(edges.select(F.col("r").alias("read"), F.col("l").alias("partner"), F.lit(1).alias("end"), *extra))


def nearest_partner(edges: DataFrame, keys: list[str] = []) -> DataFrame:
    """For each read with a partner: how many, the nearest testable one, and its edge (AGG-8, WIN-8).

    ``edges``: ``l, r, edge_id, distance`` with a null distance where there is no
    test. All partners count. Of equal distances the edge wins in which the read
    is the left end, then the first edge. One aggregation with map-side combine.
    """
    each = both_directions(edges, ["edge_id", "distance", *keys])
    best = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "end", "edge_id", "partner")))
    out = each.groupBy(*keys, "read").agg(F.count("*").alias("partner_count"), best.alias("best"))
    return out.select(*keys, "read", "partner_count", F.col("best.partner").alias("partner"), F.col("best.distance").alias("nearest_distance"), F.col("best.edge_id").alias("edge_id"))


class BlockIndex:
    """Points of one block, ordered by cells, for counting within squares and discs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, per_cell: int = 8):
        n = len(x)
        self.x0, self.y0 = float(x.min()), float(y.min())
        span = max(float(x.max()) - self.x0, float(y.max()) - self.y0, 1.0)
        self.cell = max(1.0, span / max(1, int(math.sqrt(n / per_cell))))
        cx, cy = self._cell_of(x, self.x0), self._cell_of(y, self.y0)
        self.nx, self.ny = int(cx.max()) + 1, int(cy.max()) + 1
        key = cy * self.nx + cx
        order = np.argsort(key, kind="stable")
        self.x, self.y = x[order].astype(float), y[order].astype(float)
        self.starts = np.zeros(self.nx * self.ny + 1, np.int64)
        np.cumsum(np.bincount(key, minlength=self.nx * self.ny), out=self.starts[1:])

    def _cell_of(self, v: np.ndarray, low: float) -> np.ndarray:
        return np.floor((v - low) / self.cell).astype(np.int64)

    def _inside(self, a: int, b: int, qx: float, qy: float, r: float, euclid: bool) -> int:
        dx, dy = np.abs(self.x[a:b] - qx), np.abs(self.y[a:b] - qy)
        return int(np.count_nonzero(dx * dx + dy * dy <= r * r if euclid else (dx <= r) & (dy <= r)))

    def count(self, qx: float, qy: float, r: float, euclid: bool) -> int:
        """Points within ``r``, the query's own among them."""
        c = self.cell
        row_low = max(0, math.floor((qy - r - self.y0) / c))
        row_high = min(self.ny - 1, math.floor((qy + r - self.y0) / c))
        col_low = max(0, math.floor((qx - r - self.x0) / c))
        col_high = min(self.nx - 1, math.floor((qx + r - self.x0) / c))
        if row_low > row_high or col_low > col_high:
            return 0
        total = 0
        for row in range(row_low, row_high + 1):
            base = row * self.nx
            # how far the row of cells is from the query at most; a margin keeps rounding on the safe side
            low, high = self.y0 + row * c, self.y0 + (row + 1) * c
            far = max(abs(low - qy), abs(high - qy)) * (1 + 1e-12)
            half = (math.sqrt(r * r - far * far) if far <= r else -1.0) if euclid else (r if far <= r else -1.0)
            first, last = col_high + 1, col_high
            if half >= 0:
                first = max(col_low, math.ceil((qx - half - self.x0) / c + 1e-9))
                last = min(col_high, math.floor((qx + half - self.x0) / c - 1e-9) - 1)
            if first <= last:
                total += int(self.starts[base + last + 1] - self.starts[base + first])
                total += self._inside(self.starts[base + col_low], self.starts[base + first], qx, qy, r, euclid)
                total += self._inside(self.starts[base + last + 1], self.starts[base + col_high + 1], qx, qy, r, euclid)
            else:
                total += self._inside(self.starts[base + col_low], self.starts[base + col_high + 1], qx, qy, r, euclid)
        return total


class RankIndex:
    """Points of one tile for counting within squares: a wavelet matrix over the ranks of y
    in the order of x. All queries go through its levels together."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.x, self.y = x[order], np.sort(y)
        rank = np.empty(len(y), np.int64)
        rank[np.argsort(y, kind="stable")] = np.arange(len(y))
        rest, self.zeros = rank[order], []
        for level in range(len(y).bit_length() - 1, -1, -1):
            bit = (rest >> level) & 1
            before = np.zeros(len(y) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:])
            self.zeros.append((level, before))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def _below(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Points at places a to b in the order of x with a smaller rank of y."""
        found = np.zeros(len(rank), np.int64)
        for level, before in self.zeros:
            one = ((rank >> level) & 1).astype(bool)
            za, zb = before[a], before[b]
            found += np.where(one, zb - za, 0)
            a, b = np.where(one, before[-1] + a - za, za), np.where(one, before[-1] + b - zb, zb)
        return found

    def counts(self, qx: np.ndarray, qy: np.ndarray, r: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.x, qx - r, "left"), np.searchsorted(self.x, qx + r, "right")
        return self._below(a, b, np.searchsorted(self.y, qy + r, "right")) - self._below(a, b, np.searchsorted(self.y, qy - r, "left"))


def counts_within(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Points (x, y) within r of each query."""
    if metric == "chebyshev":
        return RankIndex(x, y).counts(qx, qy, r)
    index = BlockIndex(x, y)
    return np.array([index.count(a, b, c, True) for a, b, c in zip(qx.tolist(), qy.tolist(), r.tolist())], np.int64)


def neighbour_counts(points: DataFrame, queries: DataFrame, ids: list[str], frame: Frame, neighborhood: str, metric: str = "chebyshev") -> DataFrame:
    """``queries`` with ``neighbours``: other reads within ``radius`` of each query (JN-7).

    ``points``: ``lane, surface, col, row, gx, gy``; ``queries`` the same and
    ``radius``, told apart by ``ids``. Counted in the query's own tile if only that
    is testable, else in the lane and surface. A query goes to every tile that its
    range touches, so a task holds one tile's coordinates and never a lane's, and about
    ``QUERIES`` queries; the counts of its tiles are then summed.
    """
    place = ["lane", "surface", "col", "row"]
    if neighborhood == "same-tile":
        sent = queries.select(*ids, *place, "gx", "gy", "radius")
    else:
        def touched(g: str, cell: int, last: int) -> Column:
            low = F.greatest(F.lit(0), F.floor((F.col(g) - F.col("radius")) / cell)).cast("int")
            high = F.least(F.lit(last), F.floor((F.col(g) + F.col("radius")) / cell)).cast("int")
            return F.sequence(low, high)

        sent = queries.select(*ids, "lane", "surface", F.explode(touched("gx", frame.cell_x, frame.columns - 1)).alias("col"), "row", "gx", "gy", "radius")
        sent = sent.select(*ids, "lane", "surface", "col", F.explode(touched("gy", frame.cell_y, frame.rows - 1)).alias("row"), "gx", "gy", "radius")
    # a tile's queries are dealt into parts, each of which meets the tile's points in a task of its own
    sent = materialize(sent, "asked")
    parts = F.broadcast(sent.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    sent = sent.join(parts, place).withColumn("part", F.pmod(F.xxhash64(*ids), F.col("parts")).cast("int")).drop("parts")
    out = T.StructType([*(f for f in queries.schema.fields if f.name in ids), T.StructField("found", T.LongType())])
    names = [f.name for f in out.fields[:-1]]

    def count(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked_x, asked_y, r = (asked[c].to_numpy(float) for c in ("gx", "gy", "radius"))
        found = counts_within(own.px.to_numpy(float), own.py.to_numpy(float), asked_x, asked_y, r, metric) if len(own) and len(asked) else np.zeros(len(asked), np.int64)
        return asked[names].assign(found=found)

    own = points.join(parts, place).select(*(F.col(c).alias(f"p_{c}") for c in place), F.col("gx").alias("px"), F.col("gy").alias("py"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p_part"))
    own_place = [f"p_{c}" for c in (*place, "part")]
    each = own.groupBy(*own_place).cogroup(sent.groupBy(*place, "part")).applyInPandas(count, out)
    total = each.groupBy(*names).agg(F.sum("found").alias("found"))
    return queries.join(total, names).withColumn("neighbours", F.greatest(F.col("found") - 1, F.lit(0))).drop("found")


def nearest_partner_p(neighbours: str, partners: str, population: str) -> Column:
    """1 - prod_{j < m} (1 - K / (M - j)): the chance that one of m partners placed at random
    among M reads is among the K nearest (FN-21); 1 where K + m exceeds M or K is null."""
    k, m, big = (F.col(c).cast("double") for c in (neighbours, partners, population))
    none = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(partners).cast("bigint"), F.lit(1)) - 1),
        F.lit(0.0),
        lambda a, j: a + F.log1p(-F.least(F.lit(1.0), F.greatest(F.lit(0.0), k / (big - j)))),
    )
    feasible = k.isNotNull() & (m > 0) & (big > 0) & (big - k - m >= 0)
    return F.when(feasible, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.expm1(F.least(none, F.lit(0.0)))))).otherwise(F.lit(1.0))


def shuffled_positions(positions: DataFrame, replicates: int, seed: int, keep: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """``(replicate, pair_index, <keep>)``: within each lane and surface every read gets
    another's position, with the tile that goes with it (ST-4, ST-5).

    Reads in the order of lane, surface and index meet positions in the order of lane,
    surface and a hash of index, replicate and seed: equal ranks are in equal groups,
    and each replicate is a bijection. Ranks are taken over ranges, so that no lane has
    to fit a task. ``wanted`` (``pair_index``) keeps only some reads.
    """
    n = positions.count()
    reads = Ordered(positions.select("lane", "surface", "pair_index"), "lane", "surface", "pair_index").rank("place").result()
    if wanted is not None:
        reads = reads.join(wanted, "pair_index", "left_semi")
    columns = ["lane", "surface", *(c for c in keep if c not in ("lane", "surface"))]
    each = positions.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), F.col("pair_index").alias("from_"), *columns)
    each = each.withColumn("key_", F.xxhash64("from_", "replicate", F.lit(seed)))
    places = Ordered(each, "replicate", "lane", "surface", "key_", "from_").rank("rank_").result()
    places = places.withColumn("place", ((F.col("rank_") - 1) % n + 1).cast("bigint"))
    return reads.select("pair_index", F.col("place").cast("bigint").alias("place")).join(places, "place").select("replicate", "pair_index", *columns)


def pairs_within(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radii: np.ndarray, same: bool, metric: str) -> np.ndarray:
    """Pairs of a point of each set (or, ``same``, of one set) within each radius."""
    if metric == "chebyshev" and len(bx) > 4096:
        index = RankIndex(bx, by)
        total = np.array([index.counts(ax, ay, np.full(len(ax), r)).sum() for r in radii], np.int64)
        return (total - len(ax)) // 2 if same else total
    found = np.zeros(len(radii) + 1, np.int64)
    # both sets in the order of x: only points within the largest radius along x are looked at
    a, b = np.argsort(ax, kind="stable"), np.argsort(bx, kind="stable")
    ax, ay, bx, by = ax[a], ay[a], bx[b], by[b]
    far = float(radii[-1]) if len(radii) else -1.0
    step = max(1, 2_000_000 // max(1, len(bx)))
    for at in range(0, len(ax), step):
        x, y = ax[at : at + step], ay[at : at + step]
        low, high = np.searchsorted(bx, x[0] - far, "left"), np.searchsorted(bx, x[-1] + far, "right")
        dx, dy = np.abs(bx[None, low:high] - x[:, None]), np.abs(by[None, low:high] - y[:, None])
        d = np.hypot(dx, dy) if metric == "euclidean" else np.maximum(dx, dy)
        found += np.bincount(np.searchsorted(radii, d.ravel(), side="left"), minlength=len(found))
    total = np.cumsum(found[:-1])
    return (total - len(ax)) // 2 if same else total


def pair_distance_counts(positions: DataFrame, radii: DataFrame, neighborhood: str, max_grid_step: int, metric: str) -> DataFrame:
    """``(lane, surface, radius, pairs)``: testable pairs within each radius, exactly (JN-6, AGG-10, ST-8).

    ``radii``: ``lane, surface, radius``. For each pair of tiles that can hold such
    pairs, the counts of one tile's points around the other's at all radii come
    from one kernel; tile tables are bounded by the instrument.
    """
    tiles = tile_counts(positions)
    own = tiles.select("lane", "surface", F.col("tile").alias("a_tile"), F.col("tile").alias("b_tile"))
    cross = tile_pairs(tiles, neighborhood, max_grid_step).select(F.col("a_lane").alias("lane"), F.col("a_surface").alias("surface"), "a_tile", "b_tile")
    jobs = own.union(cross)
    grids = radii.groupBy("lane", "surface").agg(F.array_sort(F.collect_list("radius")).alias("radii"))
    jobs = jobs.join(F.broadcast(grids), jobs.lane.eqNullSafe(grids.lane) & (jobs.surface == grids.surface)).select(jobs.lane, jobs.surface, "a_tile", "b_tile", "radii")
    # tiles in blocks: a task holds two blocks of points, however many a tile has
    jobs = jobs.select("*", F.monotonically_increasing_id().alias("job"))
    jobs = materialize(jobs, "jobs")
    blocks = F.broadcast(tiles.select("lane", "surface", "tile", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")))
    points = positions.join(blocks, ["lane", "surface", "tile"]).withColumn("block", F.pmod(F.xxhash64("gx", "gy"), F.col("blocks")).cast("int"))
    sides = []
    for end, other in ("ab", "ba"):
        told = jobs.select("job", "lane", "surface", F.col(f"{end}_tile").alias("tile"), F.col(f"{other}_tile").alias("other"))
        size = blocks.select("lane", "surface", F.col("tile").alias("other"), F.col("blocks").alias("others"))
        each = points.join(F.broadcast(told.join(size, ["lane", "surface", "other"])), ["lane", "surface", "tile"])
        # within a tile a pair of blocks is met once, as (i, j) with i <= j
        met = F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda o: (F.col("tile") != F.col("other")) | ((o >= F.col("block")) if end == "a" else (o <= F.col("block"))))
        i, j = ("block", "o_") if end == "a" else ("o_", "block")
        sides.append(each.select("job", "block", "gx", "gy", F.explode(met).alias("o_")).select(F.col("job").alias(f"{end}_job"), F.col(i).alias(f"{end}_i"), F.col(j).alias(f"{end}_j"), F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y")))
    told = {r.job: (r.a_tile == r.b_tile, [float(x) for x in r.radii]) for r in jobs.collect()}
    shared = positions.sparkSession.sparkContext.broadcast(told)

    def counted(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        one_tile, grid = shared.value[int(key[0])]
        if not len(a) or not len(b):
            return pd.DataFrame({"job": [], "radius": [], "n": []})
        same = one_tile and key[1] == key[2]
        n = pairs_within(*(v.to_numpy(float) for v in (a.x, a.y, b.x, b.y)), np.asarray(grid, float), bool(same), metric)
        return pd.DataFrame({"job": int(key[0]), "radius": grid, "n": n})

    each = sides[0].groupBy("a_job", "a_i", "a_j").cogroup(sides[1].groupBy("b_job", "b_i", "b_j")).applyInPandas(counted, "job bigint, radius double, n bigint")
    named = F.broadcast(jobs.select("job", "lane", "surface"))
    return each.join(named, "job").groupBy("lane", "surface", "radius").agg(F.sum("n").alias("pairs"))


def null_cdf(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lane, surface, radius, cdf)`` with cdf = (pairs + 1) / (all pairs + 1) (AGG-10)."""
    return counts.join(F.broadcast(groups.select(F.col("lane").alias("l_"), F.col("surface").alias("s_"), "relations")), F.col("lane").eqNullSafe(F.col("l_")) & (F.col("surface") == F.col("s_"))).select("lane", "surface", "radius", ((F.col("pairs") + 1) / (F.col("relations") + 1)).alias("cdf"))


def group_enrichment(groups: DataFrame, tested: DataFrame) -> DataFrame:
    """``groups`` with the tested pairs and how many more of them are testable than by chance (AGG-18)."""
    seen = tested.groupBy(F.col("lane").alias("l_"), F.col("surface").alias("s_")).agg(F.count("*").alias("tested"), F.count_if("testable").alias("tested_testable"))
    both = groups.join(F.broadcast(seen), F.col("lane").eqNullSafe(F.col("l_")) & (F.col("surface") == F.col("s_")), "left").drop("l_", "s_").na.fill(0, ["tested", "tested_testable"])
    share = F.when(F.col("relations") > 0, F.col("testable_relations") / F.col("relations")).otherwise(0.0)
    both = both.withColumn("testable_share", share).withColumn("expected_testable", F.col("tested") * F.col("testable_share"))
    return both.withColumn("enrichment", F.when(F.col("expected_testable") > 0, F.col("tested_testable") / F.col("expected_testable")))


def spatial_p(edges: DataFrame, cdf: DataFrame) -> DataFrame:
    """``edges`` (lane, surface, distance) with ``spatial_p``: the null at the next radius of the
    grid, 1 without a distance (FN-20, ST-9). The grids are a few hundred values a group."""
    grids = cdf.groupBy("lane", "surface").agg(F.array_sort(F.collect_list(F.struct("radius", "cdf"))).alias("grid"))
    grids = F.broadcast(grids.select(F.col("lane").alias("l_"), F.col("surface").alias("s_"), "grid"))
    joined = edges.join(grids, F.col("lane").eqNullSafe(F.col("l_")) & (F.col("surface") == F.col("s_")), "left")
    last = F.expr("element_at(grid, -1).cdf")
    p = F.when(F.col("distance").isNull() | F.col("grid").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.expr("try_element_at(filter(grid, g -> g.radius >= distance), 1).cdf"), last))
    return joined.withColumn("spatial_p", p).drop("l_", "s_", "grid")


def conditional_p(p: str, testable_probability: str, testable: str) -> Column:
    """The p-value given that the pair can be tested, else 1 (FN-22)."""
    share = F.col(testable_probability)
    return F.when(F.col(testable) & (share > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p) / share))).otherwise(F.lit(1.0))


def read_test(edges: DataFrame, positions: DataFrame, frame: Frame, neighborhood: str, metric: str, points: DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """One hypothesis a read: is its nearest look-alike closer than chance (ST-6)?

    ``edges``: ``l, r, edge_id, distance``; ``positions``: where each read is, one
    row a read (and replicate); ``points``: the places of all reads, which a
    shuffle leaves as they are (ST-7). Returns ``read, partner, partner_count,
    nearest_distance, edge_id, neighbours, population, p``, the read's place and
    the keys.
    """
    points = positions if points is None else points
    near = nearest_partner(edges, keys)
    where = positions.select(*keys, F.col("pair_index").alias("read"), "lane", "surface", "col", "row", "gx", "gy")
    # three plans read it, which would each make the edges anew
    asked = materialize(near.join(where, [*keys, "read"]).withColumn("radius", F.col("nearest_distance")), "nearest")
    sizes = points.groupBy("lane", "surface").agg((F.count("*") - 1).alias("population"))
    sizes = F.broadcast(sizes.select(F.col("lane").alias("l_"), F.col("surface").alias("s_"), "population"))
    counted = neighbour_counts(points, asked.where("radius is not null"), [*keys, "read"], frame, neighborhood, metric)
    rest = asked.where("radius is null").withColumn("neighbours", F.lit(None).cast("bigint"))
    every = counted.unionByName(rest).join(sizes, F.col("lane").eqNullSafe(F.col("l_")) & (F.col("surface") == F.col("s_"))).drop("l_", "s_", "radius")
    return every.withColumn("p", nearest_partner_p("neighbours", "partner_count", "population"))
