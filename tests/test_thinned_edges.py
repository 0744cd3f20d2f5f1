import random

from tilesieve.operators import components, decisions


def test_edges_are_thinned_before_they_are_shuffled(spark, monkeypatch):
    """what a task holds of a component goes out as an edge a node."""
    cliques = [(a, b) for k in range(0, 3000, 30) for a in range(k, k + 30) for b in range(a + 1, k + 30)]
    df = spark.createDataFrame(cliques, "u bigint, v bigint").repartition(4, (components.F.col("u") / 30).cast("int"))
    assert components.thinned(df).count() == 100 * 29
    sizes = []
    settled = components._settled_form
    monkeypatch.setattr(components, "_settled_form", lambda edges: (sizes.append((out := settled(edges))[1][0]), out)[1])
    got = {r.node: r.component for r in components.connected_components(df, "u", "v").collect()}
    assert got == {n: n // 30 * 30 for n in range(3000)} and sizes[0] == 100 * 29


def test_small_batches_keep_components(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST", 7)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = list(range(2000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "l bigint, r bigint"), "l", "r").collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_sensitivity_counts(spark):
    rows = [(i, i, i + 1, i / 100, 1.0) for i in range(0, 20, 2)]
    tests = spark.createDataFrame(rows, "id bigint, l bigint, r bigint, q double, p double")
    got = decisions.sensitivity(tests, {"q": "q", "p": "p"}, (0.05, 0.5))
    assert [(r["q"]["significant_edges"], r["q"]["components"], r["q"]["read_pairs_removed"], r["p"]["significant_edges"]) for r in got] == [(3, 3, 3, 0), (10, 10, 10, 0)]
