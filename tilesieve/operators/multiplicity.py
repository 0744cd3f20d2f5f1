"""Multiple testing: q-values, local FDR and the choice of method (WIN-1 to WIN-7, ST-1 to ST-3).

Hypotheses come as ``(id, p)`` with unique ids; ties of p are ordered by id.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.plans.ordered import Ordered
from tilesieve.plans.shared import materialize


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n; beyond a million terms by its expansion, good to the last digit."""
    if n <= 1_000_000:
        return float(np.sum(1.0 / np.arange(1, n + 1))) if n else 0.0
    return float(np.log(n) + np.euler_gamma + 1 / (2 * n) - 1 / (12 * n * n))


def bh_q(tests: DataFrame, p: str = "p", id_col: str = "id", name: str = "q_bh", factor: float = 1.0) -> DataFrame:
    """Adds the Benjamini-Hochberg q-value: least p m / rank at this rank or a later one, 1 at most."""
    m = tests.count()
    ranked = Ordered(tests, p, id_col).rank("rank_").with_column("raw_", F.col(p) * m / F.col("rank_"))
    out = ranked.running("min", "raw_", name, backwards=True).result()
    return out.withColumn(name, F.least(F.lit(1.0), F.least(F.lit(1.0), F.col(name)) * factor)).drop("rank_", "raw_")


def by_q(tests: DataFrame, p: str = "p", id_col: str = "id", name: str = "q_by") -> DataFrame:
    """Benjamini-Yekutieli: BH times the harmonic number, valid under any dependence."""
    return bh_q(tests, p, id_col, name, harmonic(tests.count()))


def by_from_bh(tests: DataFrame, bh: str = "q_bh", name: str = "q_by") -> DataFrame:
    """Benjamini-Yekutieli from the Benjamini-Hochberg q-values, without ordering again."""
    return tests.withColumn(name, F.least(F.lit(1.0), F.col(bh) * harmonic(tests.count())))


def weighted_bh_q(tests: DataFrame, p: str = "p", posterior: str = "posterior", compatibility: str = "compatibility_p", id_col: str = "id", name: str = "q_weighted_bh") -> DataFrame:
    """BH of p / w, w the posterior times the root of the compatibility, with mean 1 (WIN-3).

    Adds ``weight`` and the q-value.
    """
    raw = F.greatest(F.col(posterior) * F.sqrt(F.col(compatibility)), F.lit(1e-12))
    mean = tests.agg(F.avg(raw)).first()[0] or 1.0
    weighed = tests.withColumn("weight", raw / mean).withColumn("weighted_p_", F.least(F.lit(1.0), F.col(p) / F.col("weight")))
    return bh_q(weighed, "weighted_p_", id_col, name).drop("weighted_p_")


def permutation_q(tests: DataFrame, permuted: DataFrame, replicates: int, p: str = "p", name: str = "q_permutation") -> DataFrame:
    """Adds the smallest estimate of the FDR at this p or a larger one: permuted calls a
    replicate over observed calls (WIN-4).

    Both sides are counted by p first, with map-side combine, so the order runs
    over distinct values only.
    """
    counts = tests.groupBy(F.col(p).alias("t_")).agg(F.count("*").alias("own_"), F.lit(0).cast("bigint").alias("other_")).union(
        permuted.groupBy(F.col(p).alias("t_")).agg(F.lit(0).cast("bigint").alias("own_"), F.count("*").alias("other_"))
    )
    values = Ordered(counts.groupBy("t_").agg(F.sum("own_").alias("own_"), F.sum("other_").alias("other_")), "t_")
    both = values.running("sum", "own_", "calls_").running("sum", "other_", "false_")
    rate = F.when(F.col("own_") > 0, F.least(F.lit(1.0), F.col("false_") / replicates / F.greatest(F.col("calls_"), F.lit(1.0))))
    found = both.with_column("fdr_", rate).running("min", "fdr_", name, backwards=True).result().where("own_ > 0")
    return tests.join(found.select(F.col("t_").alias(p), name), p).select(*tests.columns, name)


@dataclass(frozen=True)
class Mixture:
    pi0: float
    storey_pi0: float
    grenander_density_at_1: float
    lam: float
    atom_at_one: float


def empirical_cdf(tests: DataFrame, p: str = "p") -> DataFrame:
    """``(p, cdf)`` at distinct values, ties included (WIN-7)."""
    n = tests.count()
    counts = Ordered(tests.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n_")), "p")
    return counts.running("sum", "n_", "cdf_").result().select("p", (F.col("cdf_") / n).alias("cdf"))


def _majorant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the vertices of the least concave majorant of points in the order of x."""
    kept: list[int] = []
    for i in range(len(x)):
        # the last vertex goes while it is not above the line from the one before it to this point
        while len(kept) > 1 and (y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-2]]) <= (y[i] - y[kept[-2]]) * (x[kept[-1]] - x[kept[-2]]):
            kept.pop()
        kept.append(i)
    return np.array(kept, int)


def grenander(cdf: DataFrame) -> DataFrame:
    """``(low, high, density)``: the decreasing density whose integral is the least concave
    majorant of the CDF from (0, 0) to (1, 1) (ST-1).

    Ranges of the order give their own vertices, and the majorant of those is the majorant
    of all: only vertices meet in a task. As its slopes fall, the slope at a point is the
    least of the vertices' up to it.
    """
    from pyspark.sql import Window

    spark = cdf.sparkSession
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "p double, cdf double")
    points = Ordered(cdf.unionByName(ends).groupBy("p").agg(F.max("cdf").alias("cdf")), "p")

    def vertices(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        return part.iloc[_majorant(part.p.to_numpy(), part.cdf.to_numpy())][["p", "cdf"]]

    def slopes(part: pd.DataFrame) -> pd.DataFrame:
        part = vertices(part)
        x, y = part.p.to_numpy(), part.cdf.to_numpy()
        return pd.DataFrame({"p": x[:-1], "slope": np.diff(y) / np.diff(x)})

    found = points.df.groupBy("bucket").applyInPandas(vertices, "p double, cdf double").withColumn("all", F.lit(0))
    lines = found.groupBy("all").applyInPandas(slopes, "p double, slope double")
    order = Ordered(points.df.drop("bucket").join(lines, "p", "left"), "p").running("min", "slope", "density")
    # the next point is in the same bucket or is the first of a later one
    first = sorted(order.df.groupBy("bucket").agg(F.min("p").alias("p")).collect())
    after = F.broadcast(spark.createDataFrame([(x.bucket, y.p) for x, y in zip(first, first[1:])], "bucket int, next_ double"))
    ahead = F.lead("p").over(Window.partitionBy("bucket").orderBy("p"))
    return order.df.join(after, "bucket", "left").select(F.col("p").alias("low"), F.coalesce(ahead, "next_").alias("high"), "density").where("high is not null")


def local_fdr(tests: DataFrame, lam: float = 0.5, p: str = "p", id_col: str = "id", name: str = "local_fdr") -> tuple[DataFrame, Mixture]:
    """Adds the local FDR of the two-groups mixture: pi0 over the Grenander density (ST-2).

    pi0 is Storey's estimate, no less than the density at one; p of one and more
    has a local FDR of one.
    """
    n = tests.count()
    if not n:
        return tests.withColumn(name, F.lit(1.0)), Mixture(1.0, 1.0, 1.0, lam, 0.0)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p)))
    lam = min(0.95, max(0.05, lam))
    row = tests.agg(F.count_if(clipped >= 1.0), F.count_if(clipped > lam)).first()
    values = tests.select(clipped.alias("p"))
    density = materialize(grenander(empirical_cdf(values, "p")), "density")
    at_one = density.agg(F.max_by("density", "low")).first()[0]
    at_one = 1.0 if at_one is None else at_one
    storey = min(1.0, row[1] / ((1 - lam) * n))
    pi0 = min(1.0, max(storey, at_one, 1e-6))
    # the density at a value is that of the step that begins there; at one, of the last step
    steps = density.select(F.col("low").alias("t_"), F.greatest("density", F.lit(1e-12)).alias("d_"))
    distinct = values.distinct().select(F.col("p").alias("t_")).join(steps, "t_", "left")
    distinct = distinct.withColumn("raw_", F.least(F.lit(1.0), F.lit(pi0) / F.coalesce("d_", F.lit(max(at_one, 1e-12)))))
    # it must not fall as the p-value grows
    mono = Ordered(distinct, "t_").running("max", "raw_", "lfdr_").result().select("t_", "lfdr_")
    out = tests.withColumn("t_", clipped).join(mono, "t_")
    out = out.withColumn(name, F.when(F.col("t_") >= 1.0, F.lit(1.0)).otherwise(F.col("lfdr_"))).select(*tests.columns, name)
    return out, Mixture(pi0, storey, at_one, lam, row[0] / n)


def local_fdr_q(tests: DataFrame, lfdr: str = "local_fdr", id_col: str = "id", name: str = "q_local_fdr") -> DataFrame:
    """Adds the running mean of the local FDR in its order; 1 where the local FDR is 1 (WIN-5).

    The mean of an ascending sequence ascends, so it needs no further minimum.
    """
    order = Ordered(tests, lfdr, id_col).rank("rank_").running("sum", lfdr, "sum_")
    q = F.when(F.col(lfdr) >= 1.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("sum_") / F.col("rank_")))
    return order.result().withColumn(name, q).drop("rank_", "sum_")


def without_evidence(tests: DataFrame, columns: list[str]) -> DataFrame:
    """The columns are 1 where the p-value is, or where no partner was met (FLT-7)."""
    silent = (F.col("p") >= 1) | F.col("l").isNull() | F.col("r").isNull()
    return tests.withColumns({c: F.when(silent, F.lit(1.0)).otherwise(F.col(c)) for c in columns})


def by_sequence_alone() -> F.Column:
    """The q-value without a spatial test: every read with a partner is called (ST-12)."""
    return F.when(F.col("r").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))


def choose_method(method: str, pi0: float, threshold: float, replicates: int) -> tuple[str, str | None]:
    """``auto`` takes the mixture where most hypotheses are not null, else the permutation
    estimate, or BY without replicates (ST-3)."""
    if method != "auto":
        return method, None
    dominated = pi0 < threshold
    chosen = "local-fdr" if dominated else "permutation" if replicates else "by"
    return chosen, f"pi0={pi0:.4g} {'<' if dominated else '>='} {threshold:g}"


def mixture_report(m: Mixture) -> dict:
    out = asdict(m)
    out["lambda"] = out.pop("lam")
    return out
