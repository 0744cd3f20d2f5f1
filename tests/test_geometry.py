import numpy as np
import pytest
from pyspark.sql import functions as F

from tilesieve.operators import geometry, spatial


def reads_of(spark, tiles):
    return spark.createDataFrame([(i, "L", t, 10 * i, 7 * i) for i, t in enumerate(tiles)], "pair_index bigint, lane string, tile int, x int, y int")


def test_conventions(spark):
    def layout(tiles):
        return {r.tile: (r.surface, r.col, r.row) for r in geometry.tile_layout(reads_of(spark, tiles)).collect()}

    assert layout([1101, 1103, 1207, 2101]) == {1101: (1, 0, 0), 1103: (1, 0, 1), 1207: (1, 1, 2), 2101: (2, 0, 0)}
    assert layout([12304, 12201, 11304]) == {12304: (1, 1, 1), 12201: (1, 1, 0), 11304: (1, 0, 1)}
    assert layout([7, 1101]) == {7: (1, 0, 0), 1101: (1, 0, 1)}


def test_radius_grid():
    assert geometry.radius_grid(-1, 16).size == 0
    assert geometry.radius_grid(3, 16).tolist() == [0, 1, 2, 3]
    grid = geometry.radius_grid(5000, 32)
    assert grid[256] == 256 and grid[-1] == 5000 and len(grid) == 257 + 32 and (np.diff(grid) > 0).all()


def test_unplaced_reads_raise(spark):
    reads = spark.createDataFrame([(1, None, None, None, None)], "pair_index bigint, lane string, tile int, x int, y int")
    layout = geometry.tile_layout(reads, geometry.SINGLE_COLUMN)
    with pytest.raises(ValueError):
        geometry.measure_frame(reads, layout, geometry.SINGLE_COLUMN)


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_counts_within(metric, n):
    random = np.random.default_rng(n)
    x, y = random.integers(0, 60, n).astype(float), random.integers(0, 50, n).astype(float)
    q = random.integers(-10, 70, (80, 2)).astype(float)
    r = random.integers(0, 40, 80).astype(float)
    if metric == "euclidean":
        r = np.where(random.random(80) < 0.5, r, np.hypot(q[:, 0] - x[0], q[:, 1] - y[0]))
    got = spatial.counts_within(x, y, q[:, 0], q[:, 1], r, metric)
    dx, dy = np.abs(q[:, :1] - x), np.abs(q[:, 1:] - y)
    far = np.maximum(dx, dy) <= r[:, None] if metric == "chebyshev" else dx * dx + dy * dy <= (r * r)[:, None]
    assert got.tolist() == far.sum(axis=1).tolist()


@pytest.mark.parametrize("neighborhood", ["same-tile", "adjacent", "lane"])
@pytest.mark.parametrize("queries", [1_000_000, 7])
def test_neighbour_counts(spark, neighborhood, queries, monkeypatch):
    monkeypatch.setattr(spatial, "QUERIES", queries)
    random = np.random.default_rng(3)
    rows = [(i, random.choice(["A", "B"]).item(), int(random.choice([1101, 1102, 1103, 1201])), int(random.integers(0, 100)), int(random.integers(0, 80))) for i in range(300)]
    reads = spark.createDataFrame(rows, "pair_index bigint, lane string, tile int, x int, y int")
    convention = geometry.tile_convention(reads.select("tile").distinct())
    layout = geometry.tile_layout(reads, convention)
    frame = geometry.measure_frame(reads, layout, convention)
    placed = geometry.place_reads(reads, layout, frame)
    asked = placed.where("pair_index % 3 = 0").select("pair_index", "lane", "surface", "col", "row", "gx", "gy", (F.col("pair_index") % 140).cast("double").alias("radius"))
    got = {r.pair_index: r.neighbours for r in spatial.neighbour_counts(placed, asked, ["pair_index"], frame, neighborhood).collect()}
    points = placed.collect()
    for p in points:
        if p.pair_index % 3 == 0:
            r = p.pair_index % 140
            same = [o for o in points if o.lane == p.lane and (neighborhood != "same-tile" or o.tile == p.tile)]
            assert got[p.pair_index] == sum(abs(o.gx - p.gx) <= r and abs(o.gy - p.gy) <= r for o in same) - 1


def test_nearest_partner_p(spark):
    from math import comb

    rows = [(k, m, n) for n in (1, 5, 40) for m in (1, 2, 5) for k in (0, 1, 4, 30)]
    frame = spark.createDataFrame(rows, "k bigint, m bigint, n bigint")
    for r in frame.select("*", spatial.nearest_partner_p("k", "m", "n").alias("p")).collect():
        want = 1 - comb(r.n - r.k, r.m) / comb(r.n, r.m) if r.n - r.k - r.m >= 0 else 1.0
        assert abs(r.p - want) < 1e-12
    tiny = spark.createDataFrame([(1, 1, 10**8)], "k bigint, m bigint, n bigint").select(spatial.nearest_partner_p("k", "m", "n").alias("p")).first().p
    assert abs(tiny * 1e8 - 1) < 1e-9


def test_shuffle_is_a_bijection(spark):
    reads = spark.createDataFrame([(i, "AB"[i % 2], 1, i, -i) for i in range(60)], "pair_index bigint, lane string, surface int, gx bigint, gy bigint")
    rows = spatial.shuffled_positions(reads, 3, 9, ["gx", "gy"]).collect()
    assert len(rows) == 180
    for k in (1, 2, 3):
        own = [r for r in rows if r.replicate == k]
        assert sorted(r.gx for r in own) == list(range(60))
        assert all(r.gx % 2 == r.pair_index % 2 and r.gy == -r.gx for r in own)
        assert any(r.gx != r.pair_index for r in own)


def test_nearest_partner_ties(spark):
    edges = spark.createDataFrame([(1, 2, 10, 5.0), (0, 1, 20, 5.0), (1, 3, 30, 5.0), (3, 4, 40, None)], "l bigint, r bigint, edge_id bigint, distance double")
    got = {r.read: (r.partner_count, r.partner, r.edge_id) for r in spatial.nearest_partner(edges).collect()}
    assert got[1] == (3, 2, 10)  # left ends first, then the edge
    assert got[3] == (2, 1, 30) and got[4] == (1, None, None)


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("n", [40, 4200])
def test_pairs_within(metric, same, n):
    random = np.random.default_rng(n)
    b = random.integers(0, 400, (n, 2)).astype(float)
    a = b if same else random.integers(0, 400, (30, 2)).astype(float)
    radii = np.array([0.0, 1.0, 5.0, 50.0, 600.0])
    d = np.abs(a[:, None] - b[None])
    d = d.max(axis=2) if metric == "chebyshev" else np.hypot(d[..., 0], d[..., 1])
    want = [(d <= r).sum() for r in radii]
    want = [(w - n) // 2 for w in want] if same else want
    assert spatial.pairs_within(*a.T, *b.T, radii, same, metric).tolist() == want


@pytest.mark.parametrize("metric", ["chebyshev", "euclidean"])
@pytest.mark.parametrize("block", [250_000, 9])
def test_pair_distance_counts(spark, metric, block, monkeypatch):
    """All testable pairs once, also where tiles are dealt into blocks."""
    monkeypatch.setattr(spatial, "PAIR_BLOCK", block)
    random = np.random.default_rng(6)
    rows = [(i, random.choice(["A", "B"]).item(), int(random.choice([1101, 1102, 1104])), int(random.integers(0, 60)), int(random.integers(0, 60))) for i in range(160)]
    reads = spark.createDataFrame(rows, "pair_index bigint, lane string, tile int, x int, y int")
    convention = geometry.tile_convention(reads.select("tile").distinct())
    layout = geometry.tile_layout(reads, convention)
    placed = geometry.place_reads(reads, layout, geometry.measure_frame(reads, layout, convention))
    radii = spark.createDataFrame([(lane, 1, float(r)) for lane in "AB" for r in (0, 3, 20, 200)], "lane string, surface int, radius double")
    got = {(r.lane, r.radius): r.pairs for r in spatial.pair_distance_counts(placed, radii, "adjacent", 1, metric).collect()}
    points = placed.collect()
    for lane in "AB":
        own = [p for p in points if p.lane == lane]
        pairs = [(a, b) for i, a in enumerate(own) for b in own[:i] if max(abs(a.col - b.col), abs(a.row - b.row)) <= 1]
        for r in (0.0, 3.0, 20.0, 200.0):
            d = [max(abs(a.gx - b.gx), abs(a.gy - b.gy)) if metric == "chebyshev" else np.hypot(a.gx - b.gx, a.gy - b.gy) for a, b in pairs]
            assert got[lane, r] == sum(x <= r for x in d)
