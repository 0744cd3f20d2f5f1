"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has bit *i* set if bit *i* is set in over half the XXH64
values of its word shingles. Two fingerprints link if they differ in ``bits``
(2) bits at most, and classes are the connected components of all links.

Texts with one fingerprint are one node from the start, so copies cost nothing.
The distinct fingerprints are dealt into cells of equal 16-bit quarters: of four
quarters two differing bits leave two untouched, so every link lies in a cell of
one of the six pairs of quarters. Within a cell the distances of its members to
``PIVOTS`` reference fingerprints are tabulated. By the triangle inequality two
members can only link where no coordinate of their rows differs by more than
``bits``: a member is compared with the others in a band of the first
coordinate, pairs whose maximum coordinate difference is larger are discarded,
and the survivors are verified on the fingerprints. A traversal visits each
member once and keeps one link for every member reached, so a cell gives fewer
links than it has members, and no connection is lost.

A cell of more than ``CELL`` members is dealt on by pivots: members whose distances to
a pivot fall in one window meet, and windows overlap by ``bits``, so that no link is
lost. What is still larger after ``DEALS`` pivots takes an exact way of linear size:
each member names all fingerprints one flip away and itself; members that name
the same one differ in two bits at most, there are never more than 65 of them,
and every two members that link name one together.

Edge cases: texts with fewer words than a shingle are one shingle, texts without
words (null and empty ones) have fingerprint zero and link like any other; of
repeated rows all are in one class, and ``dedup`` keeps exactly one; null ids
are ignored in a class's smallest id where others exist; an empty table gives no
rows; other columns may have any names. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.llm import similar
from tilesieve.operators.components import connected_components
from tilesieve.plans.shared import discard, materialize

PIVOTS = 32
CELL = 8192
DEALS = 6
STEP = 4  # a window of pivot distances holds STEP + bits + 1 of them
HEAVY = 1024  # fingerprints with over a HEAVY-th of all rows are looked up by broadcast: HEAVY rows at most

_QUARTER = [0xFFFF << (16 * i) for i in range(4)]
_MASKS = [_QUARTER[a] | _QUARTER[b] for a in range(4) for b in range(a)]
#: Reference fingerprints: hashes of 0, 1, 2, ...
_PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little")) for i in range(PIVOTS)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, size: int = 3) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    digest = xxhash.xxh64_intdigest
    n, counts = len(shingles), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        h = np.fromiter((digest(s, 42) for s in shingles[at : at + (1 << 14)]), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3, carry: bool = False) -> DataFrame:
    """``(id, fp, row_id)`` and, where asked, the whole rows, written down."""

    @F.pandas_udf(T.LongType())
    def prints(texts):
        return texts.map(lambda t: _signed(fingerprint(t, size)))

    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), prints(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("fp"), *([F.struct("*").alias("row")] if carry else []))
    return materialize(frame.withColumn("row_id", F.monotonically_increasing_id()), "prints")


def cell_links(members: np.ndarray, bits: int, tally: dict | None = None) -> list[tuple[int, int]]:
    """Links that connect the members (distinct, unsigned) of a cell as all its links do;
    ``tally`` counts the pairs that pivots discard and those that are verified."""
    pivots = np.bitwise_count(members[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(pivots[:, 0], kind="stable")
    members, pivots = members[order], pivots[order]
    first = pivots[:, 0]
    low = np.searchsorted(first, first - bits, "left")
    high = np.searchsorted(first, first + bits, "right")
    open_ = np.ones(len(members), bool)
    links = []
    for seed in range(len(members)):
        if not open_[seed]:
            continue
        open_[seed] = False
        todo = [seed]
        while todo:
            u = todo.pop()
            near = low[u] + np.flatnonzero(open_[low[u] : high[u]])
            if len(near):
                stay = np.abs(pivots[near] - pivots[u]).max(axis=1) <= bits
                if tally is not None:
                    for what, n in (("discarded", int((~stay).sum())), ("verified", int(stay.sum()))):
                        tally[what] = tally.get(what, 0) + n
                near = near[stay]
                near = near[np.bitwise_count(members[near] ^ members[u]) <= bits]
                open_[near] = False
                todo += near.tolist()
                links += [(int(members[v]), int(members[u])) for v in near]
    return links


def _small_cells(cells: DataFrame, bits: int) -> DataFrame:
    """Links within cells; a cell's members come together and in order."""

    def run(batches):
        held, key = [], None
        for batch in _with_end(batches):
            links: list[tuple[int, int]] = []
            if batch is None:
                groups = [(key, np.concatenate(held))] if held else []
                held = []
            else:
                band, cell, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                cuts = np.flatnonzero((band[1:] != band[:-1]) | (cell[1:] != cell[:-1])) + 1
                starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
                groups = []
                for a, b in zip(starts, ends):
                    k = (int(band[a]), int(cell[a]))
                    if k != key and held:
                        groups.append((key, np.concatenate(held)))
                        held = []
                    key = k
                    held.append(fp[a:b])
            for _, fp in groups:
                if len(fp) > 1:
                    links += cell_links(np.ascontiguousarray(fp).view(np.uint64), bits)
            if links:
                yield pa.RecordBatch.from_pydict({x: pa.array([_signed(p[i]) for p in links], pa.int64()) for i, x in enumerate("ab")})

    n = cells.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = cells.select("band", "cell", "fp").repartition(int(n), "band", "cell").sortWithinPartitions("band", "cell")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _large_cells(cells: DataFrame) -> DataFrame:
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    named = cells.select("fp").distinct().select("fp", F.explode(flips).alias("name"))
    groups = named.groupBy("name").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    return groups.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b").distinct()


def _dealt_by_pivot(cells: DataFrame, bits: int, k: int) -> DataFrame:
    """The cells dealt into overlapping windows of their members' distances to pivot ``k``."""
    d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(_PIVOTS[k])))))
    last = F.floor(d / STEP).cast("int")
    # window w holds the distances from w * STEP to (w + 1) * STEP + bits - 1
    first = F.greatest(F.lit(0), F.floor((d - bits) / STEP).cast("int"))
    dealt = cells.select("fp", "band", F.col("cell").alias("c_"), F.explode(F.sequence(first, last)).alias("w_"))
    return dealt.select("fp", "band", F.xxhash64("c_", "w_", F.lit(k)).alias("cell"))


def _sized(cells: DataFrame) -> DataFrame:
    sizes = cells.groupBy("band", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(cells.join(sizes, ["band", "cell"]), "cells")


def links(nodes: DataFrame, bits: int = 2, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) with the components of all links."""
    if bits > 2:
        raise ValueError("cells of two equal quarters find links of two bits at most")
    keyed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(_MASKS)))).alias("k")).select("fp", "k.band", "k.cell")
    cells = _sized(keyed)
    found = _small_cells(cells.where(F.col("n") <= cell), bits)
    for k in range(DEALS):
        large = cells.where(F.col("n") > cell).select("fp", "band", "cell")
        if not large.limit(1).count():
            return found
        cells = _sized(_dealt_by_pivot(large, bits, k))
        found = found.union(_small_cells(cells.where(F.col("n") <= cell), bits))
    return found.union(_large_cells(cells.where(F.col("n") > cell)))


def classes(prints: DataFrame, bits: int = 2, cell: int = CELL) -> DataFrame:
    """``prints`` with ``first``: the smallest (id, row_id) of each row's class."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row_id"))).alias("known"), F.min("row_id").alias("any"), F.count("*").alias("n")).select("fp", F.coalesce("known", F.struct(F.lit(None).cast("bigint").alias("id"), F.col("any").alias("row_id"))).alias("low"), "n"), "nodes")
    labels = materialize(connected_components(links(nodes, bits, cell), "a", "b"), "labels")
    linked = labels.join(nodes, labels.node == nodes.fp).select("fp", "component", "low")
    known = F.min(F.when(F.col("low.id").isNotNull(), F.col("low")))
    lowest = linked.groupBy("component").agg(F.coalesce(known, F.min("low")).alias("class_low"))
    by_print = linked.join(lowest, "component").select("fp", "class_low")
    found = materialize(nodes.join(by_print, "fp", "left").select("fp", "n", F.coalesce("class_low", "low").alias("first")), "classes")
    discard(labels)
    least = max(64, prints.count() // HEAVY)
    heavy = F.broadcast(found.where(F.col("n") > least).drop("n"))
    light = found.where(F.col("n") <= least).drop("n")
    columns = [*prints.columns, "first"]
    hot = prints.join(heavy, "fp").select(columns)
    return hot.union(prints.join(heavy.select("fp"), "fp", "left_anti").join(light, "fp").select(columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row."""
    found = classes(fingerprints(docs, id_col, text_col))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns.

    With a ``similarity`` texts link by that of their shingles (``similar``), not by their fingerprints.
    """
    if similarity is not None:
        rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.struct("*").alias("row")).withColumn("row_id", F.monotonically_increasing_id())
        rows = materialize(rows, "rows")
        texts = rows.select("row_id", "id", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).alias("text"))
        return rows.join(similar.kept(texts, size, similarity), "row_id", "left_semi").select("row.*")
    rows = fingerprints(docs, id_col, text_col, size, carry=True)
    found = classes(rows.select("id", "fp", "row_id"))
    stay = found.where("row_id = first.row_id").select("row_id")
    return rows.join(stay, "row_id", "left_semi").select("row.*")
