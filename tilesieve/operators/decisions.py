"""From q-values to removed reads (ST-11, AGG-14 to AGG-17, AGG-23, AGG-24)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tilesieve.operators.components import connected_components
from tilesieve.plans.shared import materialize

#: The targets of the sensitivity table.
THRESHOLDS = (0.001, 0.005, 0.01, 0.05, 0.1)


def significant(tests: DataFrame, q: str, target: float) -> DataFrame:
    """Hypotheses at the target that name two reads (FLT-8)."""
    return tests.where((F.col(q) <= target) & F.col("l").isNotNull() & F.col("r").isNotNull())


def components(calls: DataFrame) -> DataFrame:
    """``(read, component, component_id)``: component = smallest read, ids from 1 in that order."""
    found = materialize(connected_components(calls, "l", "r"), "components")
    from tilesieve.plans.ordered import Ordered

    ids = Ordered(found.select("component").distinct(), "component").rank("component_id").result()
    return found.join(ids.withColumn("component_id", F.col("component_id").cast("bigint")), "component").select(F.col("node").alias("read"), "component", "component_id")


def representatives(members: DataFrame, group: str = "component", read: str = "read") -> DataFrame:
    """The read of the highest quality sum of each group, the first of equals (AGG-24)."""
    return members.groupBy(group).agg(F.max_by(read, F.struct("quality_sum", -F.col(read))).alias("representative"), F.count("*").alias("component_size"))


def decide(tests: DataFrame, reads: DataFrame, q: str, target: float) -> DataFrame:
    """One row a removed read (D14): ``read, representative, component_id, component_size,
    component_edge_count, component_min_q, support_id, support_other``.

    ``tests``: ``id, l, r`` and the q-value; ``reads``: ``pair_index, quality_sum``.
    The support is the read's own call of the smallest q-value, the first of equals.
    """
    calls = materialize(significant(tests, q, target).select("id", "l", "r", F.col(q).alias("q")), "calls")
    parts = materialize(components(calls), "parts")
    members = parts.join(reads.select(F.col("pair_index").alias("read"), "quality_sum"), "read")
    best = representatives(members)
    own = calls.groupBy("l").agg(F.count("*").alias("n"), F.min("q").alias("q"))
    edges = own.join(parts.select(F.col("read").alias("l"), "component"), "l").groupBy("component").agg(F.sum("n").alias("component_edge_count"), F.min("q").alias("component_min_q"))
    ends = calls.select(F.col("l").alias("read"), F.col("r").alias("other"), "id", "q").union(calls.select(F.col("r").alias("read"), F.col("l").alias("other"), "id", "q"))
    support = ends.groupBy("read").agg(F.min(F.struct("q", "id", "other")).alias("s"))
    return (
        parts.join(best, "component").where("read != representative").join(edges, "component").join(support, "read")
        .select("read", "representative", "component_id", "component_size", "component_edge_count", "component_min_q", F.col("s.id").alias("support_id"), F.col("s.other").alias("support_other"))
    )


def component_stats(calls: DataFrame) -> tuple[DataFrame, dict]:
    """``(size, components)`` and totals (AGG-14)."""
    parts = connected_components(calls, "l", "r")
    sizes = materialize(parts.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components")), "sizes")
    row = sizes.agg(F.sum("components"), F.sum(F.col("components") * F.col("size"))).first()
    n, members = row[0] or 0, row[1] or 0
    return sizes, {"optical_components": n, "filtered_read_pairs": members - n, "forest_edges_used": members - n}


def sensitivity(tests: DataFrame, methods: dict[str, str], thresholds: tuple[float, ...] = THRESHOLDS) -> list[dict]:
    """Calls, components and removals by threshold and method (AGG-16, AGG-17).

    All thresholds and methods are one graph: a read's node is its index and, above
    the lowest 40 bits, the number of the threshold and method. The calls are counted as they
    go into the graph; they are not written down or shuffled as such.
    """
    cases = [(t, name) for t in thresholds for name in methods]
    named = tests.where("l is not null and r is not null")
    hits = [F.col(methods[name]) <= t for t, name in cases]
    seen = Observation()
    numbers = [F.count_if(hit).alias(f"n{i}") for i, hit in enumerate(hits)]
    last, first = F.max(F.when(some := reduce(or_, hits), F.greatest("l", "r"))).alias("last"), F.min(F.when(some, F.least("l", "r"))).alias("first")
    hit = F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(hits)))
    calls = named.observe(seen, last, first, *numbers).select("l", "r", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("case"))
    high = F.shiftleft(F.col("case").cast("bigint"), 40)
    parts = connected_components(calls.select((F.col("l") + high).alias("l"), (F.col("r") + high).alias("r")), "l", "r")
    got = seen.get
    if got["last"] is not None and (got["last"] >= 1 << 40 or got["first"] < 0):
        raise ValueError("read numbers must be within 0 and 2**40")
    sizes = parts.groupBy(F.shiftright("node", 40).alias("case")).agg(F.count("*").alias("nodes"), F.count_if(F.col("node") == F.col("component")).alias("components"))
    found = {r.case: r for r in sizes.collect()}
    edges = {i: got[f"n{i}"] for i in range(len(cases))}

    def row(case: int) -> dict:
        nodes, components = (found[case].nodes, found[case].components) if case in found else (0, 0)
        return {"significant_edges": edges.get(case, 0), "components": components, "read_pairs_removed": nodes - components}

    return [{"fdr": t, **{name: row(cases.index((t, name))) for name in methods}} for t in thresholds]


def read_level_fdr(removed: DataFrame, tests: DataFrame, lfdr: str = "local_fdr") -> dict:
    """Expected false removals: the local FDRs of the supports (AGG-15)."""
    row = removed.join(tests.select(F.col("id").alias("support_id"), F.col(lfdr).alias("f")), "support_id").agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0.0))).first()
    out = {"removed_read_pairs": row[0], "expected_false_removals": row[1], "estimated_read_level_fdr": row[1] / row[0] if row[0] else 0.0}
    return out | ({"method": "sum of the supporting hypothesis local FDR over removed read pairs"} if row[0] else {})
