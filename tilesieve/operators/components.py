"""Connected components of an edge table (AGG-23).

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"), after each task has thinned out the edges that it
holds to an edge a node: every round is two aggregations with
map-side combine and two equi joins, the edge table never grows, and the number
of rounds is logarithmic in practice even for long chains. Nothing is gathered
on the driver but one row of checksums a round. Nodes with over a ``HEAVY``-th of all
edges (twice ``HEAVY`` of them at most) get their minimum by broadcast, so a hub's
edges never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tilesieve.plans.shared import discard, materialize


def _settled_form(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written down, with their number and a sum of their hashes, both observed
    while writing, so no job of their own."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    out = materialize(edges.observe(seen, F.count("*").alias("edges"), hashes), "edges")
    return out, (seen.get["edges"], seen.get["hashes"])


#: Edges that a task thins out at once.
FOREST = 1 << 20


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each node's component, by its smallest number: minima go over the edges, and along the
    labels themselves, until nothing changes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def thinned(edges: DataFrame) -> DataFrame:
    """``(u, v)`` with the components of the edges ``(u, v)``, and fewer of them: a task links
    each node of a batch of its edges with the smallest that it reaches within the batch.

    Where the edges of a component lie together, as they do behind the join that made them,
    what is left is an edge a node. Memory is that of a batch, and nothing is shuffled.
    """

    def run(batches):
        def out(parts):
            u, v = (np.concatenate([p[i] for p in parts]) for i in range(2))
            nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = _labels(place[: len(u)], place[len(u) :], len(nodes))
            other = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["u", "v"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            size += batch.num_rows
            if size >= FOREST:
                yield out(waiting)
                waiting, size = [], 0
        if size:
            yield out(waiting)

    return edges.mapInArrow(run, "u bigint, v bigint")


HEAVY = 512
LEAST = 1024  # edges that a node needs to be a hub


def _lowest(edges: DataFrame, least: Column, total: int) -> tuple[DataFrame, int]:
    """Each node's minimum (``u, m`` and its edges ``n``) and the edges that a hub has at least,
    0 where there is no hub. Of more than a few edges the minima are written down: what reads
    them several times would repeat all that made them in its own plan."""
    low = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    bound = max(LEAST, total // HEAVY)
    if total <= bound:
        return low, 0
    seen = Observation()
    low = materialize(low.observe(seen, F.count(F.when(F.col("n") > bound, 1)).alias("hubs")), "lowest")
    return low, bound if seen.get["hubs"] else 0


def _with_lowest(edges: DataFrame, low: DataFrame, bound: int) -> DataFrame:
    """Each edge with its node's row of ``low``; nodes with over ``bound`` edges are hubs."""
    if not bound:
        return edges.join(low.drop("n"), "u")
    hubs = F.broadcast(low.where(F.col("n") > bound).drop("n"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("n") <= bound).drop("n"), "u")
    return edges.join(hubs, "u").union(others)


def _round(edges: DataFrame, total: int) -> tuple[DataFrame, tuple]:
    """A large star and a small star. Each is a job of its own, so that the driver never holds
    the plan of both, in which the edges would stand some fifty times."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, bound = _lowest(both, F.least(F.min("v"), F.col("u")), total)
    large = _with_lowest(both, low, bound).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    if total > LEAST:
        large = materialize(large, "large")
        discard(low)
    low, bound = _lowest(large, F.min("v"), total)
    small = _with_lowest(large, low, bound).select(
        F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    ).select("e.u", "e.v").where("u != v").distinct()
    out = _settled_form(small)
    discard(low, large)
    return out


#: Nodes between stars up to which the stars that hold them are told apart from the rest.
LOOSE = 100_000


def _settled_apart(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The edges of components that are stars around their smallest node, as thinning leaves
    those that one task held whole, and the others; None for none.

    A node with edges to two smaller ones, or to a smaller and a larger one, joins stars;
    stars without such a node share no node with any other edge.
    """
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = Observation()
    loose = ends.groupBy("n").agg((F.sum("up") + F.max("down")).alias("both")).where("both > 1").select("n")
    loose = materialize(loose.observe(seen, F.count("*").alias("loose")), "loose")
    if not seen.get["loose"]:
        return edges, None
    if seen.get["loose"] > LOOSE:
        return None, edges
    few = F.broadcast(loose)
    stars = F.broadcast(materialize(edges.join(few, F.col("u") == F.col("n")).select("v").union(edges.join(few, F.col("v") == F.col("n")).select("v")).distinct(), "stars"))
    return edges.join(stars, "v", "left_anti").select("u", "v"), edges.join(stars, "v", "left_semi").select("u", "v")


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the edges; component = smallest node id.

    Self loops and repeated edges are ignored, edges with a null end too. Nodes
    that occur in self loops only do not appear. Ids are LONG.
    """
    e = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    e, seen = _settled_form(thinned(e.where(f"{left} is not null and {right} is not null and u != v")).distinct())
    settled, rest = _settled_apart(e)
    if rest is not None and settled is not None:
        e, seen = _settled_form(rest)
    for _ in range(0 if rest is None else max_rounds):
        if not seen[0]:
            break
        after, now = _round(e, seen[0])
        discard(e)
        e = after
        if now == seen:
            break
        seen = now
    else:
        if rest is not None:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if rest is not None and settled is not None:
        e = settled.union(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
