"""Near duplicates by the similarity of word shingles: wide SimHash fingerprints and pivot
tables choose what is verified on the whole shingle sets.

Two texts link if the Jaccard similarity of their sets of shingles is at least
``similarity``; classes are the connected components of all links.

1. *Cells.* With all shingles in one order, two linked sets share one among the first
   ``n - ceil(similarity * n) + 1`` of each, so every link lies in a cell of texts that have
   such a shingle in common, whatever the texts. Shingles that are frequent in a sample
   come last in the order; the order decides how large cells are, never what links.
2. *Fingerprints.* Within a cell texts are compared by SimHash fingerprints of ``64 * WORDS``
   bits. At a similarity of 0.8 these differ in 39 bits, give or take 6; pairs that differ
   in more than ``RADIUS`` (72, six deviations off) are discarded, by pivot tables where
   the triangle inequality says so, else by their own distance. Sets of fewer than
   ``SMALL`` shingles, whose fingerprints are coarse, are never discarded.
3. *Blocks.* A cell gives fewer links than it has members, and the components of these links
   hold every pair that can link. The members of a component come together with their
   texts, and all of its links are decided on the whole sets: the exact distances of the
   first members visited to all others are the pivot table, a pair whose coordinates
   differ by more than the radius cannot link (the Jaccard distance is a metric), and
   what is left is verified.

Cells of more than ``CELL`` members, and components of more than ``BLOCK`` words, are dealt
into blocks, and every pair of blocks is a job of its own: a task holds two blocks,
whatever the size of the group, and a job gives fewer links than it has members. No pairs
are formed as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.operators.components import connected_components
from tilesieve.plans.shared import discard, materialize

SAMPLE = 20_000  # texts that frequent shingles are counted in
FREQUENT = 200_000  # frequent shingles that come last
WORDS = 4
RADIUS = 72
SMALL = 16
PIVOTS = 16
CELL = 8192
BLOCK = 2_000_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the SplitMix64 generator


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct XXH64 values of the shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    parts = [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts)).view(np.int64))


def wide_print(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A SimHash of ``words`` times 64 bits: a bit is set if it is in over half the mixed values."""
    h, n = shingles.view(np.uint64), len(shingles)
    out = np.zeros(words, np.uint64)
    for k in range(words if n else 0):
        z = h + np.uint64(_MIX[0] * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        z ^= z >> np.uint64(31)
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):
            counts += np.unpackbits(z[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
    return out


def traverse(m: int, distances: Callable[[int, np.ndarray], np.ndarray], radius: Callable[[int, np.ndarray], np.ndarray], pivots: int, tally: dict | None = None) -> list[tuple[int, int]]:
    """Links that connect ``m`` members as all their links do: each member is visited once
    and compared with those not reached yet.

    ``distances(u, members)`` must be a metric; the distances of the first members visited
    to all others are kept as a pivot table. ``radius`` may differ by pair.
    """
    open_, links = np.ones(m, bool), []
    table = np.empty((0, m))
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        todo = [seed]
        while todo:
            u = todo.pop()
            near = np.flatnonzero(open_)
            if not len(near):
                break
            reach = radius(u, near)
            if len(table) < pivots and len(near) > 4:
                own = distances(u, np.arange(m))
                table = np.concatenate([table, own[None, :]])
                d = own[near]
            else:
                if len(table):
                    stay = np.abs(table[:, near] - table[:, u : u + 1]).max(axis=0) <= reach + 1e-9  # for rounding
                    if tally is not None:
                        tally["discarded"] = tally.get("discarded", 0) + int((~stay).sum())
                    near, reach = near[stay], reach[stay]
                d = distances(u, near)
            if tally is not None:
                tally["verified"] = tally.get("verified", 0) + len(near)
            near = near[d <= reach]
            open_[near] = False
            todo += near.tolist()
            links += [(u, v) for v in near.tolist()]
    return links


def cell_links(prints: np.ndarray, sizes: np.ndarray, num: int, den: int, tally: dict | None = None) -> list[tuple[int, int]]:
    """Places of members (a row of words each) that connect as all pairs within the radius do."""
    small = sizes < SMALL
    bits = 64.0 * prints.shape[1]

    def distances(u, at):
        return np.bitwise_count(prints[at] ^ prints[u]).sum(axis=1, dtype=np.float64)

    def radius(u, at):
        reach = np.where(small[at] | small[u], bits, float(RADIUS))
        # no set of a link is smaller than the least share of the other
        return np.where(np.minimum(sizes[at], sizes[u]) * den >= num * np.maximum(sizes[at], sizes[u]), reach, -1.0)

    return traverse(len(prints), distances, radius, PIVOTS, tally)


def set_links(sets: list[np.ndarray], num: int, den: int, tally: dict | None = None) -> list[tuple[int, int]]:
    """Places of sets that connect as all pairs with a Jaccard similarity of ``num / den`` or more do."""
    n = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    limit = 1.0 - num / den

    def distances(u, at):
        mark[local[starts[u] : ends[u]]] = 1
        if 2 * len(at) > len(sets):
            common = np.add.reduceat(mark[local], starts)[at]
        else:
            common = np.array([mark[local[starts[k] : ends[k]]].sum() for k in at.tolist()], np.int64)
        mark[local[starts[u] : ends[u]]] = 0
        exact = 1.0 - common / (n[at] + n[u] - common)
        # whole numbers decide at the limit
        return np.where(common * (num + den) >= num * (n[at] + n[u]), np.minimum(exact, limit), np.maximum(exact, np.nextafter(limit, 2)))

    return traverse(len(sets), distances, lambda u, at: np.full(len(at), limit), PIVOTS, tally)


def _groups(batches, columns: int):
    """Rows of one key (the first ``columns``), which come together, as lists of columns."""
    held, key = [], None
    for batch in batches:
        rows = batch.to_pydict()
        names = list(rows)
        keys = list(zip(*(rows[c] for c in names[:columns])))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if keys[a] != key and held:
                yield key, [sum((h[i] for h in held), []) for i in range(len(names) - columns)]
                held = []
            key = keys[a]
            held.append([rows[c][a:b] for c in names[columns:]])
    if held:
        yield key, [sum((h[i] for h in held), []) for i in range(len(held[0]))]


def _block_jobs(members: DataFrame, blocks) -> DataFrame:
    """``members`` with ``i, j``: a row for each pair of blocks that the member's own is in.

    ``blocks`` is the number of blocks of the member's group; a block is a hash of the node.
    """
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks_")).cast("int")
    each = members.withColumn("blocks_", blocks.cast("int")).withColumn("own_", own)
    pairs = F.expr("transform(sequence(0, blocks_ - 1), o -> struct(least(o, own_) as i, greatest(o, own_) as j))")
    return each.select("*", F.explode(pairs).alias("p_")).select(*members.columns, "p_.i", "p_.j")


def _dealt(frame: DataFrame, *key: str) -> DataFrame:
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(n, *key).sortWithinPartitions(*key)


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles of more than one of the sampled texts, the rarest first."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")

    @F.pandas_udf("array<bigint>")
    def sets(column: pd.Series) -> pd.Series:
        return column.map(lambda t: shingle_set(t, size))

    top = some.distinct().select(F.explode(sets("text")).alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(FREQUENT)
    return np.array(top.select("s").toArrow()["s"].to_pylist(), np.int64)[::-1]


def _prints(texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(row_id, id, key, n, print, head)``: equal sets have one key; ``head`` are the first shingles."""
    frequent = _frequent(texts, size)
    shared = texts.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent)))

    @F.pandas_udf("key binary, n int, print binary, head array<bigint>")
    def prints(column: pd.Series) -> pd.DataFrame:
        known, ranks = shared.value
        rows = []
        for text in column:
            s = shingle_set(text, size)
            rank = np.full(len(s), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[at] == s, ranks[at], -1)
            ordered = s[np.lexsort((s, rank))]
            rows.append((xxhash.xxh128_digest(s.tobytes()), len(s), wide_print(s).tobytes(), ordered[: len(s) + num * len(s) // -den + 1] if len(s) else s))
        return pd.DataFrame(rows, columns=["key", "n", "print", "head"])

    return materialize(texts.select("row_id", "id", prints("text").alias("p")).select("row_id", "id", "p.*"), "prints")


def _candidates(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: pairs within cells that connect all that can link. ``nodes``: ``node, n, print, head``."""
    index = nodes.select("node", F.explode("head").alias("s"))
    sizes = index.groupBy("s").agg(F.count("*").alias("size")).where("size > 1")
    cells = materialize(index.join(sizes, "s").select("s", "node", "size"), "cells")
    # near copies share most of their first shingles: cells of the same members are looked at once
    alike = cells.where(F.col("size") <= CELL).groupBy("s").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    small = alike.select(F.xxhash64("nodes").alias("s"), F.explode("nodes").alias("node"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = cells.where(F.col("size") > CELL)
    large = _block_jobs(large, F.ceil(F.col("size") / CELL)).select("s", "node", "i", "j")
    jobs = small.union(large).join(nodes.select("node", "n", "print"), "node").select("s", "i", "j", "node", "n", "print")

    def run(batches):
        for _, (node, n, prints) in _groups(batches, 3):
            if len(node) > 1:
                links = cell_links(np.frombuffer(b"".join(prints), np.uint64).reshape(len(node), -1), np.array(n, np.int64), num, den)
                if links:
                    yield pa.RecordBatch.from_pydict({x: pa.array([node[p[k]] for p in links], pa.int64()) for k, x in enumerate("ab")})

    found = _dealt(jobs, "s", "i", "j").mapInArrow(run, "a bigint, b bigint")
    out = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    discard(cells)
    return out


def links(nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: links that connect nodes as all links do, decided on the whole sets."""
    pairs = _candidates(nodes, num, den)
    blocks = materialize(connected_components(pairs, "a", "b"), "blocks").distinct()
    sized = blocks.join(nodes.select("node", "n"), "node")
    totals = sized.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    members = sized.join(totals, "component").select("component", "node", "blocks")
    held = members.join(texts.select(F.col("row_id").alias("node"), "text"), "node")
    jobs = _block_jobs(held, F.col("blocks")).select("component", "i", "j", "node", "text")

    def run(batches):
        for _, (node, text) in _groups(batches, 3):
            if len(node) > 1:
                found = set_links([shingle_set(t, size) for t in text], num, den)
                if found:
                    yield pa.RecordBatch.from_pydict({x: pa.array([node[p[k]] for p in found], pa.int64()) for k, x in enumerate("ab")})

    out = materialize(_dealt(jobs, "component", "i", "j").mapInArrow(run, "a bigint, b bigint"), "links")
    discard(pairs)
    return out


def kept(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(row_id)`` of the row with the smallest id of each class; ``texts``: ``row_id, id, text``."""
    from fractions import Fraction

    least = Fraction(str(similarity))
    prints = _prints(texts, size, least.numerator, least.denominator)
    sets = prints.groupBy("key").agg(F.min("row_id").alias("node"), F.count("*").alias("rows"))
    more = prints.select("row_id", "key").join(sets.where("rows > 1"), "key").where("row_id != node").select("row_id", "node")
    more = materialize(more, "copies")
    nodes = prints.where("n > 0").join(more, "row_id", "left_anti").select(F.col("row_id").alias("node"), "n", "print", "head")
    found = links(nodes, texts, size, least.numerator, least.denominator)
    labels = materialize(connected_components(found, "a", "b"), "labels")
    discard(found)
    owned = prints.select("row_id", "id").join(more, "row_id", "left").select("row_id", "id", F.coalesce("node", "row_id").alias("node"))
    members = owned.join(labels, "node", "left").select("row_id", "id", F.coalesce("component", "node").alias("c"))
    # rows alone in their class stay without meeting any other
    low = F.struct("id", "row_id")
    lowest = members.groupBy("c").agg(F.coalesce(F.min(F.when(F.col("id").isNotNull(), low)), F.min(low)).alias("low"))
    out = materialize(lowest.select("low.row_id"), "kept")
    discard(labels, prints, more)
    return out
