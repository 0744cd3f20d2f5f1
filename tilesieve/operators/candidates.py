"""Similar pairs by a seed index (JN-1 to JN-3, AGG-2 to AGG-6, FLT-1 to FLT-5).

``reads`` has ``pair_index, lane, bases`` (both mates' letters, one string) and
``quals``; ``r1_length`` splits them. Only placed reads (lane not null) are
looked at. Keys that too many reads share are filtered by their counts before
any pair is formed, so a key gives at most ``cap * (cap - 1) / 2`` pairs; an
exact family above its limit, or more candidates than allowed, is an error
where a limit is given. All pairs of a family are wanted: their number grows
with the square of its size, what a task holds does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tilesieve.functions.names import seed_entropy, seed_offsets
from tilesieve.operators.quality import with_reads
from tilesieve.plans.shared import materialize


@dataclass(frozen=True)
class SeedLength:
    adaptive: bool
    requested_maximum: int
    expected_mismatches_between_copies: float
    mean_reported_error_rate: float
    length_supported_by_quality: int
    length_needed_to_discriminate: int
    selected: int


def choose_seed_length(cycle_errors: list[float], read_count: int, maximum: int, adaptive: bool) -> SeedLength:
    """The longest seed of which the qualities leave more windows than mismatches (AGG-2)."""
    errors = [min(0.75, max(0.0, e)) for e in cycle_errors]
    expected = sum(2 * e - 4 / 3 * e * e for e in errors)
    floor = max(8, math.ceil(math.log2(max(2, read_count)) / 2))
    supported = int(len(errors) / (expected + 1))
    chosen = min(maximum, max(floor, supported)) if adaptive else maximum
    return SeedLength(adaptive, maximum, expected, sum(errors) / max(1, len(errors)), supported, floor, int(chosen))


def mean_cycle_errors(reads: DataFrame) -> DataFrame:
    """``(cycle, error)``: mean reported error of each cycle, in cycles from 0 (AGG-2).

    Qualities are counted by cycle and value with map-side combine, so a shuffle
    of at most cycles x 61 rows a task.
    """
    cycles = reads.select(F.posexplode(F.filter(F.split("quals", ""), lambda c: c != "")).alias("cycle", "c"))
    counted = cycles.groupBy("cycle", F.least(F.greatest(F.ascii("c") - 33, F.lit(0)), F.lit(60)).alias("q")).agg(F.count("*").alias("n"))
    return counted.groupBy("cycle").agg((F.sum(F.col("n") * F.pow(F.lit(10.0), -F.col("q") / 10.0)) / F.sum("n")).alias("error"))


def base_priors(reads: DataFrame) -> DataFrame:
    """``(cycle, pa, pc, pg, pt)``: base shares of each cycle, one added to each count (AGG-1)."""
    cycles = reads.select(F.posexplode(F.filter(F.split("bases", ""), lambda c: c != "")).alias("cycle", "b"))
    counts = cycles.groupBy("cycle").agg(*(F.count_if(F.col("b") == x).alias(x) for x in "ACGT"))
    total = sum((F.col(x) for x in "CGT"), F.col("A")) + 4
    return counts.select("cycle", *(((F.col(x) + 1) / total).alias(f"p{x.lower()}") for x in "ACGT"))


def exact_families(reads: DataFrame) -> DataFrame:
    """``(lane, bases, size)`` of two reads and more with the same letters in one lane (AGG-3)."""
    return reads.where("lane is not null").groupBy("lane", "bases").agg(F.count("*").alias("size")).where("size > 1")


def seeds(reads: DataFrame, seed_length: int, r1_length: int, r2_length: int) -> DataFrame:
    """``(pair_index, lane, mate, at, seed)``: the non-overlapping windows of each mate; those a shorter read doesn't fill are left out."""
    places = windows(seed_length, r1_length, r2_length)
    if not places:
        return reads.select("pair_index", "lane", F.lit(1).alias("mate"), F.lit(0).alias("at"), F.lit("").alias("seed")).limit(0)
    each = F.array(*(F.struct(F.lit(m).alias("mate"), F.lit(o).alias("at"), F.substring("bases", start + 1, seed_length).alias("seed")) for m, o, start in places))
    return reads.where("lane is not null").select("pair_index", "lane", F.explode(each).alias("s")).select("pair_index", "lane", "s.*").where(F.length("seed") == seed_length)


def seed_buckets(index: DataFrame) -> DataFrame:
    """``(lane, mate, at, seed, size)`` of seeds that two reads and more share."""
    return index.groupBy("lane", "mate", "at", "seed").agg(F.count("*").alias("size")).where("size > 1")


#: Reads of one family that a task meets at once, from each of two blocks.
FAMILY_BLOCK = 512
#: Seeds above the cap up to which they go to the reads by broadcast; there is at most one for each ``max_bucket`` seeds.
BROADCAST = 200_000


def windows(seed_length: int, r1_length: int, r2_length: int) -> list[tuple[int, int, int]]:
    """``(mate, offset, start)`` of the seeds of a read; ``start`` counts through both mates."""
    return [(1, o, o) for o in seed_offsets(r1_length, seed_length)] + [(2, o, r1_length + o) for o in seed_offsets(r2_length, seed_length)]


def _pairs(members: DataFrame, key: list[str], also: Callable[[str, str], Column] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All ``(l, r)``, l < r, of the structs ``m`` of each key for which ``also`` holds, with
    the columns of ``carry`` from both ends.

    The keys were filtered by their sizes or dealt into blocks, so the lists are short; pairs
    are made where their members have met, without another shuffle or a self join.
    """
    groups = members.groupBy(*key).agg(F.sort_array(F.collect_list("m")).alias("ms")).where(F.size("ms") > 1)
    heads = groups.select("ms", *key, F.posexplode("ms").alias("nth", "a"))
    both = heads.select("a", *key, F.explode(F.slice("ms", F.col("nth") + 2, F.size("ms"))).alias("b"))
    kept = F.col("a.pair_index") < F.col("b.pair_index")
    both = both.where(kept if also is None else kept & also("a", "b"))
    return both.select(F.col("a.pair_index").alias("l"), F.col("b.pair_index").alias("r"), *(F.col(f"{side}.{c}").alias(f"{end}_{c}") for side, end in ("al", "br") for c in carry))


def _family_pairs(reads: DataFrame, carry: Sequence[str]) -> DataFrame:
    """All pairs of the same letters and lane. Families above a block are dealt into blocks of
    reads, each two of which meet in a task, so none holds a family however large it is."""
    key = ["lane", "bases"]
    large = reads.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > FAMILY_BLOCK)
    large = F.broadcast(large.select(*key, F.ceil(F.col("size") / FAMILY_BLOCK).cast("int").alias("blocks")))
    dealt = reads.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("pair_index"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("pair_index", "block", *carry).alias("m"))
    return _pairs(met, [*key, "i", "j"], lambda a, b: (F.col("i") == F.col("j")) | (F.col(f"{a}.block") != F.col(f"{b}.block")), carry)


def repeated_reads(reads: DataFrame) -> bool:
    """Whether an index stands for several reads."""
    return bool(reads.groupBy("pair_index").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def candidate_pairs(reads: DataFrame, seed_length: int, r1_length: int, r2_length: int, max_bucket: int = 500, max_family: int | None = 5000, max_candidates: int = 5_000_000, min_entropy: float = 0.0, carry: Sequence[str] = (), repeated: bool | None = None) -> tuple[DataFrame, dict]:
    """Distinct ``(l, r)`` with l < r, and the retrieval's numbers (AGG-4).

    Seeds are counted, then the reads of each kept seed meet once. A pair comes from the
    first kept seed that it shares, and from its family if its reads have no kept seed at
    all, so no pair is found twice and pairs are never shuffled. ``carry``: columns of both
    ends that come along, as ``l_`` and ``r_``. ``max_family``: None for no limit.
    ``repeated``: whether an index may stand for several reads, looked up unless given; then
    pairs are made distinct and what is carried is joined to them.
    """
    placed = reads.where("lane is not null")
    families = exact_families(placed)
    fam = families.agg(F.count("*"), F.sum((F.col("size") * (F.col("size") - 1) / 2).cast("bigint")), F.max("size")).first()
    if max_family is not None and (fam[2] or 0) > max_family:
        raise ValueError(f"an exact-sequence family contains {fam[2]:,} pairs, above the limit of {max_family:,}; adapter or low-complexity artifacts are a usual cause")
    frequent, stats = frequent_seeds(seeds(placed, seed_length, r1_length, r2_length), max_bucket, min_entropy)
    if repeated is None:
        repeated = repeated_reads(placed)
    brought = [] if repeated else list(carry)
    at = windows(seed_length, r1_length, r2_length)
    marked = placed.select("pair_index", "lane", "bases", *(c for c in brought if c != "bases"))
    tags = []
    for k, (mate, offset, start) in enumerate(at):
        seed = F.substring("bases", start + 1, seed_length)
        good = F.length(seed) == seed_length
        if min_entropy > 0:
            good = good & (seed_entropy(seed) >= min_entropy)
        if stats["skipped_high_frequency_seed_buckets"]:
            over = frequent.where((F.col("mate") == mate) & (F.col("at") == offset)).select(F.col("lane").alias("lane_"), F.col("seed").alias("seed_"), F.lit(True).alias(f"over{k}"))
            over = F.broadcast(over) if stats["skipped_high_frequency_seed_buckets"] <= BROADCAST else over
            marked = marked.join(over, (F.col("lane") == F.col("lane_")) & (seed == F.col("seed_")), "left").drop("lane_", "seed_")
            good = good & F.col(f"over{k}").isNull()
        tags.append(F.when(good, F.lit(1 << k)).otherwise(F.lit(0)))
    marked = marked.withColumn("own", sum(tags, F.lit(0)).cast("bigint"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.substring("bases", start + 1, seed_length).alias("seed")) for k, (_, _, start) in enumerate(at)))
    edges = _family_pairs(marked.where("own = 0"), brought)
    if at:
        met = marked.select("lane", F.explode(each).alias("s"), F.struct("pair_index", "own", "bases", *(c for c in brought if c != "bases")).alias("m"))
        met = met.where(F.expr("shiftright(m.own, s.k) & 1") == 1).select("lane", "s.*", "m")

        def first(a: str, b: str) -> Column:
            shared = F.lit(False)
            for k, (_, _, start) in enumerate(at[:-1]):
                equal = F.substring(f"{a}.bases", start + 1, seed_length) == F.substring(f"{b}.bases", start + 1, seed_length)
                shared = shared | ((F.col("k") > k) & (F.col(f"{a}.own").bitwiseAND(F.lit(1 << k)) != 0) & equal)
            return ~shared

        edges = edges.unionByName(_pairs(met, ["lane", "k", "seed"], first, brought))
    if repeated:
        edges = edges.distinct()
        edges = with_reads(edges, reads, list(carry)) if carry else edges
    details = {
        "seed_length": seed_length,
        "r1_seed_offsets": seed_offsets(r1_length, seed_length),
        "r2_seed_offsets": seed_offsets(r2_length, seed_length),
        "exact_sequence_families": fam[0],
        "exact_sequence_pair_relations": fam[1] or 0,
        **stats,
        "minimum_seed_entropy": min_entropy,
        "max_seed_bucket": max_bucket,
        "max_exact_family": max_family,
        "max_candidates": max_candidates,
    }
    details["largest_retained_seed_bucket"] = max(details["largest_retained_seed_bucket"], fam[2] or 0)
    return edges, details


def check_candidates(count: int, max_candidates: int, details: dict) -> None:
    if count > max_candidates:
        raise MemoryError(f"{count:,} candidate pairs, above the limit of {max_candidates:,}; the largest kept bucket has {details['largest_retained_seed_bucket']:,} reads")


def _bucket_numbers(max_bucket: int, min_entropy: float) -> list[Column]:
    large = F.col("size") > max_bucket
    plain = ~large & (seed_entropy(F.col("seed")) < min_entropy) if min_entropy > 0 else F.lit(False)
    size = F.col("size")
    return [
        F.count_if(large).alias("skipped_high_frequency_seed_buckets"),
        F.coalesce(F.max(F.when(large, size)), F.lit(0)).alias("largest_skipped_seed_bucket"),
        F.count_if(plain).alias("skipped_low_complexity_seed_buckets"),
        F.coalesce(F.max(F.when(~large & ~plain, size)), F.lit(0)).alias("largest_retained_seed_bucket"),
        F.coalesce(F.sum(F.when(large | plain, size)), F.lit(0)).alias("members_in_skipped_seed_buckets_with_multiplicity"),
    ]


def bucket_stats(buckets: DataFrame, max_bucket: int, min_entropy: float) -> DataFrame:
    """One row: what the bucket filters kept and left out."""
    return buckets.agg(*_bucket_numbers(max_bucket, min_entropy))


def frequent_seeds(index: DataFrame, max_bucket: int, min_entropy: float) -> tuple[DataFrame, dict]:
    """``(lane, mate, at, seed)`` above the cap, written down, and the numbers of ``bucket_stats``,
    observed meanwhile: the seeds are counted once."""
    seen = Observation()
    counted = seed_buckets(index).observe(seen, *_bucket_numbers(max_bucket, min_entropy))
    frequent = materialize(counted.where(F.col("size") > max_bucket).select("lane", "mate", "at", "seed"), "frequent")
    return frequent, dict(seen.get)


def lane_relations(reads: DataFrame) -> int:
    """Pairs of placed reads that share a lane (AGG-6)."""
    per_lane = reads.where("lane is not null").groupBy("lane").agg(F.count("*").alias("n"))
    return per_lane.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))).first()[0] or 0
