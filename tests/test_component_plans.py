"""What the driver holds while components are found: the plans of the tables that rounds write."""

from tilesieve.operators import components
from tilesieve.plans import shared


def test_rounds_have_small_plans(spark, monkeypatch):
    """A plan of both stars reads the edges some fifty times over, each step of which the driver keeps while it runs."""
    scans = []

    def recorded(df, label):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return shared.materialize(df, label)

    monkeypatch.setattr(components, "materialize", recorded)
    monkeypatch.setattr(components, "LEAST", 20)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 140)] + [(39, 120)]
    found = components.connected_components(spark.createDataFrame([*edges, (200, 201)], "l bigint, r bigint"), "l", "r").collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in [*range(40), *range(100, 141)]} | {200: 200, 201: 200}
    assert len(scans) > 1 and max(scans) <= 8
