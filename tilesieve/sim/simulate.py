"""A simulated run with known duplicates, as DataFrames (SIM-1 to SIM-6).

Everything random is a hash of the seed, a purpose and a cluster, so a cluster can be drawn
anywhere, in any order and as often as needed: no state is passed on, and runs of any size
are made by Spark. Clusters are numbered by what they are: optical children first, then
library copies, then the reads of an artefact, then originals; the output is shuffled.

Originals lie on the tiles of a small flowcell, more on some tiles than on others and more
in some places of a tile than in others. A library copy has its original's molecule and a
place of its own; an optical child has a place close to its original's, a share of them
beyond the border with the next tile, to which the original is moved. The artefact reads
are all G and fill a disc. Some molecules carry a common motif.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilesieve.plans.ordered import Ordered
from tilesieve.plans.shared import discard, materialize
from tilesieve.sources import sink

#: The size of a tile, the lane key of simulated names and the mechanisms of the truth table.
WIDTH, HEIGHT = 30_000, 24_000
LANE = "SIMFC:1:HXXXXDRXX:1"
OPTICAL, PCR, POLYG, UNIQUE = "optical", "pcr", "polyg", "unique"
MOTIF = 30
DISC = 6000


@dataclass
class Scenario:
    reads: int = 60_000
    read_length: int = 90
    surfaces: int = 1
    swaths: int = 2
    tiles: int = 6
    pcr_duplicate_rate: float = 0.06
    optical_rate: float = 0.04
    optical_scale: float = 45.0
    cross_tile_fraction: float = 0.18
    polyg_rate: float = 0.004
    shared_motif_rate: float = 0.05
    bad_tail_cycles: int = 0
    bad_tail_quality: float = 10.0
    flat_quality: float = 0.0
    seed: int = 17

    def counts(self) -> dict[str, int]:
        """Clusters of each kind; at least half are originals."""
        left, out = self.reads // 2, {}
        for kind, rate in ((OPTICAL, self.optical_rate), (PCR, self.pcr_duplicate_rate), (POLYG, self.polyg_rate)):
            out[kind] = min(left, int(rate * self.reads))
            left -= out[kind]
        return out | {UNIQUE: self.reads - sum(out.values())}


def tile_number(surface: Column, swath: Column, tile: Column) -> Column:
    return (1000 * surface + 100 * swath + tile).cast("int")


def stream(seed: int, purpose: int, cluster: int) -> np.random.Generator:
    """The random numbers of one cluster for one purpose."""
    return np.random.Generator(np.random.Philox(key=[seed * 16 + purpose, cluster + 1]))


def quality_levels(s: Scenario) -> np.ndarray:
    """The mean score by cycle: level at first, falling over the last two fifths; or flat;
    with a bad tail, down to its score over its cycles."""
    at = np.arange(s.read_length) / max(1, s.read_length - 1)
    level = np.full(s.read_length, s.flat_quality) if s.flat_quality > 0 else 35 - 9 * np.clip((at - 0.6) / 0.4, 0, 1)
    tail = min(s.bad_tail_cycles, s.read_length)
    down = np.clip((np.arange(s.read_length) - s.read_length + tail + 1) / max(1, tail), 0, 1) if tail else 0.0
    return level + (s.bad_tail_quality - level) * down


def draw_qualities(random: np.random.Generator, level: np.ndarray) -> np.ndarray:
    """Scores within 2 to 41: the level, a shift a read and coin flips a base."""
    shift = random.uniform(-2.5, 2.5)
    return np.clip(np.rint(level + shift + random.binomial(8, 0.5, len(level)) - 4), 2, 41).astype(np.uint8)


def misread(random: np.random.Generator, bases: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bases (0 to 3) of which each is another one at the rate that its score says."""
    return np.where(random.random(len(bases)) < 10.0 ** (-q.astype(float) / 10), (bases + random.integers(1, 4, len(bases))) % 4, bases)


class Flowcell:
    """Places as expressions over cluster numbers."""

    def __init__(self, s: Scenario):
        self.s = s
        self.slots = [(a, b) for a in range(1, s.surfaces + 1) for b in range(1, s.swaths + 1)]
        own = np.random.default_rng([s.seed, 99])
        n = len(self.slots) * s.tiles
        weight = 0.3 + own.random(n) + own.random(n)
        self.upto = np.cumsum(weight / weight.sum())
        self.bend, self.wave = own.uniform(0.7, 1.6, n), own.uniform(-0.7, 0.7, n)

    def uniform(self, purpose: str, *key: Column) -> Column:
        """In [0, 1), by 53 bits of a hash."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.s.seed), F.lit(purpose), *key), 11) / F.lit(float(1 << 53))

    def distance(self, purpose: str, key: Column) -> Column:
        """Rayleigh, with the mean of the scenario."""
        return F.lit(self.s.optical_scale * 2 / np.sqrt(np.pi)) * F.sqrt(-F.log1p(-self.uniform(purpose, key)))

    def originals(self, ids: DataFrame) -> DataFrame:
        """``id, slot, tile, x, y``: the densities of a tile are powers along x, a wave along y."""
        def of(values) -> Column:
            return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("g") + 1)

        key = F.col("id")
        tile = F.least(F.lit(len(self.upto) - 1), F.size(F.filter(F.array(*(F.lit(float(v)) for v in self.upto)), lambda v: v <= self.uniform("tile", key))))
        v = self.uniform("y", key)
        return ids.withColumn("g", tile).select(
            "id",
            F.floor(F.col("g") / self.s.tiles).cast("int").alias("slot"),
            (F.col("g") % self.s.tiles + 1).cast("int").alias("tile"),
            (F.lit(float(WIDTH)) * F.pow(self.uniform("x", key), of(self.bend))).alias("x"),
            (F.lit(float(HEIGHT)) * (v + of(self.wave) * F.sin(2 * np.pi * v) / (2 * np.pi))).alias("y"),
        )


def clusters(spark: SparkSession, s: Scenario) -> DataFrame:
    """``id, mechanism, parent, molecule, slot, tile, x, y, cross_tile``; places are whole and unique."""
    cell, n = Flowcell(s), s.counts()
    first_original = s.reads - n[UNIQUE]
    ids = spark.range(s.reads)
    kind = F.when(F.col("id") < n[OPTICAL], OPTICAL).when(F.col("id") < n[OPTICAL] + n[PCR], PCR).when(F.col("id") < first_original, POLYG).otherwise(UNIQUE)
    parent = F.when(kind.isin(OPTICAL, PCR), first_original + F.floor(cell.uniform("parent", F.col("id")) * n[UNIQUE]).cast("bigint"))
    crosses = (kind == OPTICAL) & (cell.uniform("cross", F.col("id")) < s.cross_tile_fraction) & F.lit(s.tiles > 1)
    all_ = ids.select("id", kind.alias("mechanism"), parent.alias("parent"), crosses.alias("crosses"))

    # an original with a child beyond the border lies at the border itself
    moved = all_.where("crosses").groupBy(F.col("parent").alias("id")).agg(F.lit(True).alias("moved"))
    home = cell.originals(all_.where(F.col("mechanism").isin(UNIQUE, PCR)).select("id")).join(moved, "id", "left")
    up = (F.col("tile") == 1) | ((F.col("tile") < s.tiles) & (cell.uniform("way", F.col("id")) < 0.5))
    off = cell.distance("inside", F.col("id")) / 2
    home = home.withColumn("step", F.when(F.col("moved"), F.when(up, 1).otherwise(-1))).withColumn("y", F.when(F.col("step") == 1, HEIGHT - off).when(F.col("step") == -1, off).otherwise(F.col("y")))

    angle, far = 2 * np.pi * cell.uniform("angle", F.col("id")), cell.distance("far", F.col("id"))
    over = F.greatest(F.lit(1.0), cell.distance("beyond", F.col("id")) / 2)
    children = all_.where(F.col("mechanism") == OPTICAL).join(home.select(F.col("id").alias("parent"), "slot", F.col("tile").alias("t"), F.col("x").alias("px"), F.col("y").alias("py"), "step"), "parent")
    near = children.select(
        "id",
        "slot",
        F.when(F.col("crosses"), F.col("t") + F.col("step")).otherwise(F.col("t")).alias("tile"),
        (F.col("px") + far * F.cos(angle)).alias("x"),
        F.when(F.col("crosses") & (F.col("step") == 1), over).when(F.col("crosses"), HEIGHT - over).otherwise(F.col("py") + far * F.sin(angle)).alias("y"),
    )

    one = F.lit(0).cast("bigint")
    out, turn = DISC * F.sqrt(cell.uniform("disc", F.col("id"))), 2 * np.pi * cell.uniform("turn", F.col("id"))
    disc = all_.where(F.col("mechanism") == POLYG).select(
        "id",
        F.floor(cell.uniform("slot", one) * len(cell.slots)).cast("int").alias("slot"),
        (F.floor(cell.uniform("spot", one) * s.tiles) + 1).cast("int").alias("tile"),
        (DISC + (WIDTH - 2 * DISC) * cell.uniform("cx", one) + out * F.cos(turn)).alias("x"),
        (DISC + (HEIGHT - 2 * DISC) * cell.uniform("cy", one) + out * F.sin(turn)).alias("y"),
    )

    places = home.select("id", "slot", "tile", "x", "y").union(near).union(disc)
    whole = places.select("id", "slot", "tile", F.rint(F.least(F.lit(float(WIDTH)), F.greatest(F.lit(1.0), "x"))).cast("int").alias("x"), F.rint(F.least(F.lit(float(HEIGHT)), F.greatest(F.lit(1.0), "y"))).cast("int").alias("y"))
    molecule = F.when(F.col("mechanism") == POLYG, F.lit(-1)).otherwise(F.coalesce("parent", "id")).cast("bigint")
    named = all_.select("id", "mechanism", "parent", molecule.alias("molecule"), F.col("crosses").cast("int").alias("cross_tile")).join(_apart(whole), "id")
    surface, swath = (F.element_at(F.array(*(F.lit(p[k]) for p in cell.slots)), F.col("slot") + 1) for k in (0, 1))
    name = F.concat_ws(":", F.lit(LANE), tile_number(surface, swath, F.col("tile")).cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    return materialize(named.withColumn("name", name), "clusters")


def _apart(places: DataFrame) -> DataFrame:
    """Of clusters at one place all but the first move on by their number, until no two are at one."""
    same = Window.partitionBy("slot", "tile", "x", "y").orderBy("id")
    while True:
        ranked = materialize(places.withColumn("k", F.row_number().over(same) - 1), "places")
        if not ranked.where("k > 0").limit(1).count():
            return ranked.drop("k")
        places = ranked.select("id", "slot", "tile", (F.col("x") + F.col("k")).alias("x"), "y")


def sequences(found: DataFrame, s: Scenario) -> DataFrame:
    """``found`` with both mates' letters and scores."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    motif = np.random.default_rng([s.seed, 7]).integers(0, 4, min(MOTIF, s.read_length))

    def read(batches):
        level = quality_levels(s)
        for batch in batches:
            rows = []
            for key, molecule in zip(batch["id"].tolist(), batch["molecule"].tolist()):
                make = stream(s.seed, 1, molecule)
                mates = make.integers(0, 4, (2, s.read_length)) if molecule >= 0 else np.full((2, s.read_length), 2)
                if molecule >= 0 and make.random() < s.shared_motif_rate:
                    at = int(make.integers(0, s.read_length - len(motif) + 1))
                    mates[0, at : at + len(motif)] = motif
                noise, row = stream(s.seed, 2, key), []
                for bases in mates:
                    q = draw_qualities(noise, level)
                    row += [letters[misread(noise, bases, q)].tobytes().decode(), (q + 33).tobytes().decode()]
                rows.append(row)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["r1_seq", "r1_qual", "r2_seq", "r2_qual"])], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInPandas(read, schema + ", r1_seq string, r1_qual string, r2_seq string, r2_qual string")


def motif_reads(found: DataFrame, s: Scenario) -> int:
    @F.pandas_udf("boolean")
    def has(molecules: pd.Series) -> pd.Series:
        def one(m: int) -> bool:
            make = stream(s.seed, 1, m)
            make.integers(0, 4, (2, s.read_length))
            return make.random() < s.shared_motif_rate

        return molecules.map(one)

    return found.where("molecule >= 0").where(has("molecule")).count()


def simulate(spark: SparkSession, prefix: str, s: Scenario) -> dict:
    """Writes both mates, the truth table and a summary beside ``prefix``; returns the summary."""
    found = clusters(spark, s)
    ranked = Ordered(found.withColumn("turn", F.xxhash64(F.lit(s.seed), F.lit("order"), "id")), "turn", "id").rank("emitted_rank").result()
    ranked = materialize(ranked.withColumn("emitted_rank", F.col("emitted_rank").cast("bigint")), "emitted")
    reads = materialize(sequences(ranked.select("emitted_rank", "name", "id", "molecule"), s), "sequences")
    paths = [f"{prefix}_R{m}.fastq.gz" for m in (1, 2)]
    for m, path in enumerate(paths, 1):
        record = F.concat(F.lit("@"), "name", F.lit(f" {m}:N:0:1\n"), f"r{m}_seq", F.lit("\n+\n"), f"r{m}_qual")
        sink.write_lines(reads.select("emitted_rank", record.alias("value")), path, "emitted_rank", level=3)
    truth = ranked.join(found.select(F.col("id").alias("parent"), F.col("name").alias("parent_read_name")), "parent", "left").withColumnRenamed("name", "read_name")
    sink.write_table(truth, f"{prefix}.truth.tsv.gz", "emitted_rank", ["emitted_rank", "read_name", "molecule", "mechanism", "parent_read_name", "cross_tile"], 3)
    made = s.counts()
    summary = {
        "read_pairs": s.reads,
        "read_length": s.read_length,
        "tiles": s.surfaces * s.swaths * s.tiles,
        "layout": {"surfaces": s.surfaces, "swaths": s.swaths, "tiles_per_swath": s.tiles},
        "pcr_duplicate_children": made[PCR],
        "optical_children": made[OPTICAL],
        "optical_children_crossing_tiles": found.where("cross_tile = 1").count(),
        "polyg_reads": made[POLYG],
        "shared_motif_reads": motif_reads(found, s),
        **{k: asdict(s)[k] for k in ("bad_tail_cycles", "flat_quality", "seed")},
        "r1": paths[0],
        "r2": paths[1],
        "truth": f"{prefix}.truth.tsv.gz",
    }
    sink.write_json(spark, f"{prefix}.truth.json", summary)
    discard(reads, ranked, found)
    return summary
