"""A whole run: files in, filtered files, audits and a report out.

Steps that later ones read more than once are written to the shared folder; what
comes to the driver are run-wide numbers, a row a cycle, a tile, a group, a split
or a bucket.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesieve.config import Config
from tilesieve.operators import calibration, candidates, decisions, geometry, multiplicity, quality, spatial
from tilesieve.plans.ordered import Ordered
from tilesieve.plans.shared import materialize

PLACE = ["lane", "surface", "tile", "col", "row", "gx", "gy"]
CONTROL = 0  # the replicate that is the permutation control


@dataclass
class Analysis:
    """What a run found, as frames and small numbers."""

    config: Config
    meta: dict
    reads: DataFrame
    positions: DataFrame
    frame: geometry.Frame
    seed: candidates.SeedLength
    retrieval: dict
    scored: DataFrame
    relations: int
    prior: float
    em_rounds: int
    tested: DataFrame
    groups: DataFrame
    cdf: DataFrame | None
    units: DataFrame
    methods: dict[str, str]
    method: str
    auto_reason: str | None
    mixture: multiplicity.Mixture
    removed: DataFrame
    permuted: DataFrame | None
    controls: dict[str, dict] = field(default_factory=dict)
    decomposition: dict = field(default_factory=dict)
    control_p: dict[str, DataFrame] = field(default_factory=dict)


def _measure(edges: DataFrame, positions: DataFrame, config: Config, keys: list[str] = []) -> DataFrame:
    """Both ends' places, whether the pair is testable, and its distance."""
    out = edges
    for end in "lr":
        side = positions.select(*keys, F.col("pair_index").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in PLACE))
        out = out.join(side, [*keys, end])
    testable = geometry.is_testable("l_", "r_", config.tile_neighborhood, config.max_grid_step)
    out = out.withColumn("testable", testable).withColumn("distance", geometry.pair_distance("l_", "r_", F.col("testable"), config.spatial_metric))
    out = out.withColumn("grid_step", geometry.grid_step("l_", "r_")).withColumn("same_tile", F.col("l_tile") == F.col("r_tile"))
    return out.withColumns({"lane": F.col("l_lane"), "surface": F.col("l_surface")}).drop(*(f"{e}_{c}" for e in "lr" for c in PLACE))


def _edge_p(edges: DataFrame, cdf: DataFrame, groups: DataFrame) -> DataFrame:
    share = F.when(F.col("relations") > 0, F.col("testable_relations") / F.col("relations")).otherwise(0.0)
    shares = F.broadcast(groups.select(F.col("lane").alias("gl_"), F.col("surface").alias("gs_"), share.alias("share_")))
    out = spatial.spatial_p(edges, cdf).join(shares, F.col("lane").eqNullSafe(F.col("gl_")) & (F.col("surface") == F.col("gs_")), "left")
    return out.withColumn("conditional_p", spatial.conditional_p("spatial_p", "share_", "testable")).drop("gl_", "gs_", "share_")


def _null(positions: DataFrame, groups: DataFrame, frame: geometry.Frame, config: Config) -> DataFrame:
    spark = positions.sparkSession
    far = geometry.max_testable_distance(positions, frame, config.tile_neighborhood, config.max_grid_step, config.spatial_metric).collect()
    rows = [(r.lane, r.surface, float(x)) for r in far for x in geometry.radius_grid(r.max_radius, config.null_resolution)]
    radii = spark.createDataFrame(rows, "lane string, surface int, radius double")
    counts = spatial.pair_distance_counts(positions, radii, config.tile_neighborhood, config.max_grid_step, config.spatial_metric)
    return materialize(spatial.null_cdf(counts, groups), "null")


def _q_values(units: DataFrame, permuted: DataFrame | None, config: Config) -> tuple[DataFrame, dict[str, str], multiplicity.Mixture]:
    """All q-values; hypotheses without evidence get one."""
    out, mixture = multiplicity.local_fdr(units, config.pi0_lambda)
    out = materialize(out, "lfdr")
    out = multiplicity.local_fdr_q(out)
    out = multiplicity.by_from_bh(multiplicity.bh_q(out))
    methods = {"local_fdr": "q_local_fdr", "bh": "q_bh", "by": "q_by"}
    if permuted is not None and config.permutations:
        out = multiplicity.permutation_q(out, permuted.where(F.col("replicate") != CONTROL), config.permutations)
        methods["permutation"] = "q_permutation"
    if config.inference_unit == "edge":
        weighed = multiplicity.weighted_bh_q(units, "spatial_p").select("id", "weight", "q_weighted_bh")
        out = out.join(weighed, "id")
        methods["weighted_bh"] = "q_weighted_bh"
    return materialize(multiplicity.without_evidence(out, [*methods.values(), "local_fdr"]), "units"), methods, mixture


def analyse(spark: SparkSession, reads: DataFrame, meta: dict, config: Config, step=lambda name, text='': None) -> Analysis:
    """Everything between reading and writing. ``reads`` as from ``sources.fastq.to_reads``."""
    config.validate()
    convention = geometry.tile_convention(reads.where("tile is not null").select("tile").distinct())
    layout = geometry.tile_layout(reads, convention)
    frame = geometry.measure_frame(reads, layout, convention, config.tile_gap)
    positions = materialize(geometry.place_reads(reads.select("pair_index", "lane", "tile", "x", "y"), layout, frame), "positions")

    priors = [tuple(r)[1:] for r in candidates.base_priors(reads).orderBy("cycle").collect()]
    errors = [r.error for r in candidates.mean_cycle_errors(reads).orderBy("cycle").collect()]
    seed = candidates.choose_seed_length(errors, meta["read_count"], config.seed_length, config.adaptive_seed)
    edges, retrieval = candidates.candidate_pairs(reads, seed.selected, meta["r1_length"], meta["r2_length"], config.max_seed_bucket, config.max_exact_family, config.max_candidates, config.min_seed_entropy)
    edges = materialize(edges, "candidates")
    retrieval["retrieved_candidate_pair_relations"] = edges.count()
    candidates.check_candidates(retrieval["retrieved_candidate_pair_relations"], config.max_candidates, retrieval)

    step("candidates", f"pairs={retrieval['retrieved_candidate_pair_relations']:,}")
    scored = materialize(quality.score_pairs(quality.with_reads(edges, reads, ["bases", "quals"]), priors), "scored")
    rule, refusal = quality.eligibility(config.sequence_min_p, config.min_log10_bayes_factor)
    relations = candidates.lane_relations(reads)
    prior, used, rounds = quality.same_template_prior(scored, rule, relations)

    step("scores", f"prior={prior:.4g}")
    eligible = Ordered(scored.where(rule).withColumn("posterior", quality.posterior(used)), "l", "r").rank("edge_id").result()
    eligible = eligible.withColumn("edge_id", F.col("edge_id").cast("bigint"))
    tested = materialize(_measure(eligible, positions, config), "tested")
    groups = materialize(geometry.testable_relations(positions, config.tile_neighborhood, config.max_grid_step), "groups")
    edge_null = config.inference_unit == "edge" or config.candidate_audit or config.diagnostic_plot
    cdf = _null(positions, groups, frame, config) if edge_null else None
    if cdf is not None:
        tested = materialize(_edge_p(tested, cdf, groups), "tested")

    def test(edges: DataFrame, where: DataFrame, keys: list[str] = []) -> DataFrame:
        """Hypotheses ``(keys, id, l, r, p, ...)`` of the inference unit."""
        if config.inference_unit == "read":
            found = spatial.read_test(edges, where, frame, config.tile_neighborhood, config.spatial_metric, positions, keys)
            return found.select(*keys, F.col("read").alias("id"), F.col("read").alias("l"), F.col("partner").alias("r"), "p", "partner_count", "nearest_distance", "neighbours", "population", "edge_id")
        each = edges if "conditional_p" in edges.columns else _edge_p(edges, cdf, groups)
        more = [c for c in ("posterior", "compatibility_p", "spatial_p") if c in each.columns]
        return each.select(*keys, F.col("edge_id").alias("id"), "l", "r", F.col("conditional_p").alias("p"), F.col("distance").alias("nearest_distance"), "edge_id", "testable", *more)

    units = materialize(test(tested, positions), "hypotheses")

    step("tests")
    # the control and all replicates in one pass: the replicate is a grouping key
    ends = tested.select(F.col("l").alias("pair_index")).union(tested.select(F.col("r").alias("pair_index"))).distinct()
    shuffled = spatial.shuffled_positions(positions, config.permutations + 1, config.null_check_seed, PLACE, ends)
    shuffled = materialize(shuffled.withColumn("replicate", F.col("replicate") - 1), "shuffled")
    pairs = tested.select("l", "r", "edge_id").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(config.permutations))))
    permuted = materialize(test(_measure(pairs, shuffled, config, ["replicate"]), shuffled, ["replicate"]).select("replicate", "id", "p", "nearest_distance"), "permuted")

    step("permutations", f"replicates={config.permutations}")
    control_p = {"permutation": permuted.where(F.col("replicate") == CONTROL).select("id", "p")}
    refused = scored.where(refusal).select("l", "r", F.monotonically_increasing_id().alias("edge_id"))
    refused = materialize(refused, "refused")
    if refused.limit(1).count():
        control_p["sequence_incompatible"] = materialize(test(_measure(refused, positions, config), positions).select("id", "p"), "incompatible")
    control_p["analysis"] = units.select("id", "p")
    said = {
        "permutation": "reads reassigned to observed cluster positions within lane and surface",
        "sequence_incompatible": "seed-retrieved candidate edges rejected by the quality model",
        "analysis": "one hypothesis per read carried into FDR control" if config.inference_unit == "read" else "sequence-compatible candidate edges carried into FDR control",
    }
    controls = {k: {"description": said[k], **calibration.calibration(v)} for k, v in control_p.items()}

    units, methods, mixture = _q_values(units, permuted, config)
    method, reason = multiplicity.choose_method(config.fdr_method, mixture.pi0, config.auto_pi0_threshold, config.permutations)
    selected = F.col(methods[method.replace("-", "_")])
    if not config.spatial_test:
        selected = multiplicity.by_sequence_alone()
    units = units.withColumn("q", selected)
    removed = materialize(decisions.decide(units, reads, "q", config.fdr), "removed")
    split = calibration.decomposition(units, permuted.where(F.col("replicate") != CONTROL), config.permutations, meta["read_count"])
    return Analysis(config, meta, reads, positions, frame, seed, retrieval, scored, relations, prior, rounds, tested, groups, cdf, units, methods, method, reason, mixture, removed, permuted, controls, split, control_p)


def run(spark: SparkSession, config: Config, command: list[str] | None = None) -> dict:
    """Reads, analyses and writes; returns the report."""
    from tilesieve.plans import audits, report
    from tilesieve.sources import fastq, sink

    config.validate()
    started = time.monotonic()
    sink.check_outputs(spark, [config.r1, config.r2], config.outputs(), config.force)
    log = report.Log(spark, config.log)
    log("run", "status=start")
    pairs = fastq.read_pairs(spark, config.r1, config.r2)
    reads, meta = fastq.to_reads(pairs, config.unparsed)
    log.step("load", f"pairs={meta['read_count']:,} unparsed={meta['unparsed']:,}")
    found = analyse(spark, reads, meta, config, log.step)
    log.step("q-values", f"method={found.method} pi0={found.mixture.pi0:.6g}")
    counts = sink.write_filtered(pairs, found.removed.select(F.col("read").alias("pair_index")), config.output_r1, config.output_r2, config.gzip_level)
    log.step("write", f"kept={counts[0]:,} removed={counts[1]:,}")
    if config.candidate_audit:
        audits.write_candidate_audit(found, config.candidate_audit)
    if config.removed_audit:
        audits.write_removed_audit(found, config.removed_audit)
    if config.read_audit:
        audits.write_read_audit(found, config.read_audit)
    out = report.build(found, counts, time.monotonic() - started, command)
    sink.write_json(spark, config.report_json, out)
    if config.report_md:
        sink.write_text(spark, config.report_md, report.markdown(out))
    for path, panels in ((config.qq_plot, report.qq_panels), (config.diagnostic_plot, report.diagnostic_panels)):
        if path:
            report.write_plot(spark, path, panels(found))
    log("run", f"status=complete elapsed={time.monotonic() - started:.1f}s")
    log.write()
    return out


def run_exact(spark: SparkSession, r1: str, r2: str, output_r1: str, output_r2: str, report_json: str, audit: str | None = None, distance: int = 2500, unparsed: str = "error", gzip_level: int = 6, force: bool = False) -> dict:
    """The exact-match mode: one signature, one tile, a fixed distance."""
    from tilesieve.operators import exact
    from tilesieve.sources import fastq, sink

    if distance < 0:
        raise ValueError("the distance must not be negative")
    sink.check_outputs(spark, [r1, r2], [p for p in (output_r1, output_r2, report_json, audit) if p], force)
    pairs = fastq.read_pairs(spark, r1, r2)
    reads = fastq.to_exact_reads(pairs, unparsed)
    removed = materialize(exact.removed_reads(reads, distance), "removed")
    kept, gone = sink.write_filtered(pairs, removed, output_r1, output_r2, gzip_level)
    out = exact.exact_report(reads, removed, distance)
    if (kept, gone) != (out["retained_read_pairs"], out["removed_read_pairs"]):
        raise RuntimeError("the written pairs do not add up with the removed ones")
    if audit:
        sink.write_table(
            removed.select(
                "pair_index",
                (F.col("pair_index") + 1).alias("removed_pair_index"),
                F.col("read_name").alias("removed_read_name"),
                (F.col("representative_index") + 1).alias("representative_pair_index"),
                F.col("representative_name").alias("representative_read_name"),
                F.col("location").alias("run_lane_tile"),
                F.col("x").alias("removed_x"),
                F.col("y").alias("removed_y"),
                "representative_x",
                "representative_y",
                "delta_x",
                "delta_y",
                F.col("chebyshev_distance").alias("chebyshev_distance_to_representative"),
                "component_size",
            ),
            audit,
            "pair_index",
            ["removed_pair_index", "removed_read_name", "representative_pair_index", "representative_read_name", "run_lane_tile", "removed_x", "removed_y", "representative_x", "representative_y", "delta_x", "delta_y", "chebyshev_distance_to_representative", "component_size"],
            gzip_level,
        )
    sink.write_json(spark, report_json, out, sort_keys=True)
    return out
