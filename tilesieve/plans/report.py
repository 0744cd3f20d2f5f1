"""The report of a run, its text form, its plots' data and its log (SNK-7 to SNK-10)."""

from __future__ import annotations

import io
import json
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesieve.functions.numbers import duration, with_commas
from tilesieve.operators import calibration, decisions, geometry, multiplicity, spatial
from tilesieve.sources import sink
from tilesieve.sources.fastq import uri

NAME, VERSION = "tilesieve", "0.2.0"
#: The last chunk of a PNG file.
PNG_END = b"\0\0\0\0IEND\xaeB`\x82"

LIMITATIONS = [
    "A pair is only found if it shares an exact seed or is an exact copy.",
    "Copies that are not proximity duplicates are taken to lie anywhere among the observed positions of their lane and surface.",
    "Base qualities are taken to be calibrated, and errors independent by cycle.",
    "Which tiles are neighbours is read from the tile numbers; an unknown numbering counts as one column.",
    "The mixture needs enough duplicates to fit them; with almost none it calls nothing.",
    "Without molecular tags, different molecules with the same insert cannot always be told apart.",
]


#: The steps of a run and the share of its time that each takes, measured on simulated runs.
STEPS = {"load": 0.1, "candidates": 0.15, "scores": 0.1, "tests": 0.2, "permutations": 0.2, "q-values": 0.1, "write": 0.15}


class Log:
    """Lines with time, topic, progress and time to finish, to standard error and, at the end, to a file."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path, self.lines = spark, path, []
        self.started, self.done = time.monotonic(), 0.0

    def step(self, name: str, text: str = "") -> None:
        """A step is done: how much of the run is, and how long the rest should take."""
        self.done = min(1.0, self.done + STEPS[name])
        spent = time.monotonic() - self.started
        left = duration(spent / self.done * (1 - self.done))
        self(name, f"{text} progress={100 * self.done:.0f}% elapsed={duration(spent)} eta={left}".strip())

    def __call__(self, topic: str, text: str) -> None:
        line = f"{datetime.now(timezone.utc).isoformat(timespec='seconds')}\t{topic}\t{text}"
        self.lines.append(line)
        print(line, file=sys.stderr)

    def write(self) -> None:
        if self.path:
            sink.write_text(self.spark, self.path, "\n".join(self.lines) + "\n")


def _size(spark: SparkSession, path: str) -> int:
    p, fs = sink._fs(spark, uri(path))
    return fs.getFileStatus(p).getLen()


def group_summaries(a) -> list[dict]:
    """A group's reads, relations and tested pairs (AGG-18)."""
    tiles = geometry.tile_counts(a.positions).select("lane", "surface", "tile", "n").collect()
    null = {} if a.cdf is None else {(r.lane, r.surface): r for r in a.cdf.groupBy("lane", "surface").agg(F.max("radius").alias("radius"), F.max_by("cdf", "radius").alias("cdf"), F.count("*").alias("n")).collect()}
    out = []
    for i, g in enumerate(spatial.group_enrichment(a.groups, a.tested).orderBy("lane", "surface").collect()):
        key = g.lane, g.surface
        own = {str(r.tile): r.n for r in sorted(tiles, key=lambda r: r.tile) if (r.lane, r.surface) == key}
        out.append(
            {
                "group_id": i,
                "group_label": f"{g.lane}:surface{g.surface}",
                "read_pairs": g.reads,
                "tiles": len(own),
                "tile_read_pair_counts": own,
                "total_random_pair_relations": g.relations,
                "testable_random_pair_relations": g.testable_relations,
                "testable_random_pair_probability": g.testable_share,
                "same_tile_random_pair_probability": g.same_tile_relations / g.relations if g.relations else 0.0,
                "tested_hypotheses": g.tested,
                "testable_tested_hypotheses": g.tested_testable,
                "untestable_tested_hypotheses": g.tested - g.tested_testable,
                "expected_testable_hypotheses_if_all_null": g.expected_testable,
                "testable_enrichment_fold": g.enrichment,
                "maximum_null_radius": null[key].radius if key in null else None,
                "null_cdf_at_maximum_radius": null[key].cdf if key in null else None,
                "null_radii_evaluated": null[key].n if key in null else 0,
            }
        )
    return out


def build(a, counts: tuple[int, int], elapsed: float, command: list[str] | None = None) -> dict:
    c, spark = a.config, a.reads.sparkSession
    eligible = a.tested.agg(F.count("*").alias("n"), F.count_if("testable").alias("t"), F.percentile("log10_bayes_factor", 0.5).alias("bf"), F.percentile("compatibility_p", 0.5).alias("p")).first()
    called = a.units.where(F.col("q") <= c.fdr)
    tiles = a.positions.select("pair_index", "tile")
    ends = called.join(tiles.select(F.col("pair_index").alias("l"), F.col("tile").alias("lt")), "l").join(tiles.select(F.col("pair_index").alias("r"), F.col("tile").alias("rt")), "r")
    extent = called.agg(F.max("nearest_distance").alias("far"), F.min("q").alias("low"), F.max("q").alias("high")).first()
    groups = group_summaries(a)
    total, testable = (sum(g[k] for g in groups) for k in ("total_random_pair_relations", "testable_random_pair_relations"))
    sizes, filtering = decisions.component_stats(decisions.significant(a.units, "q", c.fdr))
    filtering |= {
        "significant_candidate_edges": decisions.significant(a.units, "q", c.fdr).count(),
        "component_size_histogram": {str(r.size_): r.components for r in sizes.withColumnRenamed("size", "size_").orderBy("size_").collect()},
        "retained_read_pairs": counts[0],
        "removed_read_pairs": counts[1],
        "removed_fraction": counts[1] / max(1, a.meta["read_count"]),
        "maximum_called_distance_data_derived": extent.far,
        "minimum_called_q": extent.low,
        "maximum_called_q": extent.high,
    }
    lanes = a.reads.where("lane is not null").select("lane").distinct().count()
    return {
        "tool": NAME,
        "version": VERSION,
        "generated_at_utc": datetime.now(timezone.utc).isoformat(),
        "elapsed_seconds": elapsed,
        "command": command or [],
        "inputs": {"r1": c.r1, "r2": c.r2, "r1_bytes": _size(spark, c.r1), "r2_bytes": _size(spark, c.r2)},
        "outputs": {"r1": c.output_r1, "r2": c.output_r2, "candidate_audit": c.candidate_audit, "removed_audit": c.removed_audit, "read_audit": c.read_audit, "diagnostic_plot": c.diagnostic_plot, "qq_plot": c.qq_plot, "log": c.log},
        "configuration": {
            "target_fdr": c.fdr,
            **{k: getattr(c, k) for k in ("fdr_method", "inference_unit", "spatial_test", "permutations", "min_log10_bayes_factor", "min_seed_entropy", "adaptive_seed", "sequence_min_p", "spatial_metric", "tile_neighborhood", "tile_gap", "max_grid_step", "null_resolution", "pi0_lambda", "threads", "gzip_level")},
            "unparsed_header_action": c.unparsed,
        },
        "counts": {
            "input_read_pairs": a.meta["read_count"],
            "read1_length": a.meta["r1_length"],
            "read2_length": a.meta["r2_length"],
            "lanes": lanes,
            "unparsed_headers": a.meta["unparsed"],
            "total_possible_within_lane_pair_relations": a.relations,
            "retrieved_candidate_pair_relations": a.retrieval["retrieved_candidate_pair_relations"],
            "tested_candidate_edges": eligible.n,
        },
        "candidate_retrieval": a.retrieval | {"seed_length_selection": vars(a.seed)},
        "quality_model": {
            "estimated_same_template_prior": a.prior,
            "em_iterations": a.em_rounds,
            "eligible_log10_bayes_factor_rule": f"> {c.min_log10_bayes_factor:g}",
            "median_eligible_log10_bayes_factor": eligible.bf,
            "median_eligible_compatibility_p": eligible.p,
        },
        "flowcell_geometry": {
            "tile_identifier_convention": a.frame.convention,
            "tile_grid_columns": a.frame.columns,
            "tile_grid_rows": a.frame.rows,
            "tile_cell_pixels": {"x": a.frame.cell_x, "y": a.frame.cell_y},
            "spatial_groups": [g["group_label"] for g in groups],
            "neighborhood": c.tile_neighborhood,
        },
        "spatial_model": {
            "fixed_distance_cutoff_used": False,
            "metric": c.spatial_metric,
            "testable_tested_hypotheses": eligible.t,
            "untestable_tested_hypotheses": eligible.n - eligible.t,
            "testable_random_pair_probability": testable / total if total else 0.0,
            "cross_tile_called_edges": ends.where("lt != rt").count(),
            "groups": groups,
        },
        "duplicate_decomposition": a.decomposition,
        "null_calibration": {"controls": a.controls},
        "multiple_testing": {
            "primary_method": a.method,
            "requested_method": c.fdr_method,
            "auto_selection_reason": a.auto_reason,
            "mixture": multiplicity.mixture_report(a.mixture),
            "permutation": {"permutations": c.permutations, "hypotheses": a.units.count()},
            "read_level_fdr_estimate": decisions.read_level_fdr(a.removed, a.units),
        },
        "filtering": filtering,
        "fdr_sensitivity": decisions.sensitivity(a.units, a.methods),
        "limitations": LIMITATIONS,
    }


def markdown(report: dict) -> str:
    """The report's main numbers as text."""
    f, n, m, d = report["filtering"], report["counts"], report["multiple_testing"], report["duplicate_decomposition"]
    c, q, g, r = report["configuration"], report["quality_model"], report["flowcell_geometry"], report["candidate_retrieval"]
    rows = [
        "# Proximity duplicates",
        "",
        f"Made on {report['generated_at_utc']} by {report['tool']} {report['version']}.",
        "",
        f"{with_commas(n['input_read_pairs'])} read pairs, {with_commas(f['removed_read_pairs'])} removed ({100 * f['removed_fraction']:.3f}%), in {duration(report['elapsed_seconds'])}.",
        "",
        "## Decision rule",
        "",
        f"One hypothesis a {c['inference_unit']}; called at a false-discovery rate of {c['target_fdr']:g} by {m['primary_method']}"
        + (f" ({m['auto_selection_reason']})" if m["auto_selection_reason"] else "")
        + f". Calls form components, and the read of the highest quality sum of each is kept. {'Distances decide.' if c['spatial_test'] else 'Sequences alone decide.'}",
        "",
        "| | |",
        "|-|-|",
        f"| candidate pairs | {with_commas(n['retrieved_candidate_pair_relations'])} |",
        f"| tested pairs | {with_commas(n['tested_candidate_edges'])} |",
        f"| method | {m['primary_method']} (asked for: {m['requested_method']}) |",
        f"| share of null hypotheses | {m['mixture']['pi0']:.4g} |",
        f"| components | {with_commas(f['optical_components'])} |",
        f"| estimated share of false removals | {m['read_level_fdr_estimate']['estimated_read_level_fdr']:.4g} |",
        f"| largest called distance | {f['maximum_called_distance_data_derived']} |",
        "",
        "## Quality model",
        "",
        f"Seeds of {r['seed_length']} bases. Prior of one template {q['estimated_same_template_prior']:.4g} after {q['em_iterations']} rounds; of the eligible pairs (log10 Bayes factor {q['eligible_log10_bayes_factor_rule']}) the median log10 Bayes factor is {q['median_eligible_log10_bayes_factor']} and the median compatibility {q['median_eligible_compatibility_p']}.",
        "",
        "## Geometry",
        "",
        f"{g['tile_identifier_convention']}: {g['tile_grid_columns']} x {g['tile_grid_rows']} tiles of {g['tile_cell_pixels']['x']} x {g['tile_cell_pixels']['y']} pixels, neighbourhood {g['neighborhood']}, metric {report['spatial_model']['metric']}.",
        "",
        "| group | read pairs | tiles | testable by chance | tested | testable | enrichment |",
        "|-|-|-|-|-|-|-|",
        *(f"| {x['group_label']} | {with_commas(x['read_pairs'])} | {x['tiles']} | {x['testable_random_pair_probability']:.4g} | {with_commas(x['tested_hypotheses'])} | {with_commas(x['testable_tested_hypotheses'])} | {'NA' if x['testable_enrichment_fold'] is None else format(x['testable_enrichment_fold'], '.4g')} |" for x in report["spatial_model"]["groups"]),
        "",
        "## Null controls",
        "",
        "| control | hypotheses | at one | tail inflation | largest excess |",
        "|-|-|-|-|-|",
    ]
    for name, c in report["null_calibration"]["controls"].items():
        rows.append(f"| {name} | {c['count']} | {c.get('atom_at_one')} | {c.get('tail_inflation')} | {c.get('max_excess_over_uniform')} |")
    if d.get("permutations"):
        rows += ["", "## Duplicates by distance", "", "| pixels | observed | by chance | excess |", "|-|-|-|-|"]
        rows += [f"| {r['distance_px']:g} | {r['observed_reads']} | {r['expected_if_positions_random']:.1f} | {r['excess_reads']:.1f} |" for r in d["curve"]]
    rows += ["", "## Removed at other targets", "", "| target | " + " | ".join(k for k in report["fdr_sensitivity"][0] if k != "fdr") + " |", "|-" * len(report["fdr_sensitivity"][0]) + "|"]
    rows += [f"| {r['fdr']} | " + " | ".join(str(v["read_pairs_removed"]) for k, v in r.items() if k != "fdr") + " |" for r in report["fdr_sensitivity"]]
    rows += ["", "## Limitations", "", *(f"- {x}" for x in report["limitations"])]
    return "\n".join(rows) + "\n"


def qq_panels(a) -> dict[str, DataFrame]:
    """Data of the calibration figure: quantiles, tail ratios, histogram, local FDR by distance (PL-1)."""
    spark = a.reads.sparkSession
    out = {f"qq_{k}": calibration.qq_points(v) for k, v in a.control_p.items()}
    alphas = [10 ** (-4 + 4 * i / 59) for i in range(60)]
    n = a.units.count()
    hits = a.units.agg(*(F.count_if(F.col("p") <= x) for x in alphas)).first()
    out["tail"] = spark.createDataFrame([(x, h / max(1, n) / x) for x, h in zip(alphas, hits)], "alpha double, ratio double")
    out["histogram"] = calibration.histogram(a.units)
    out["local_fdr"] = _thinned(a.units.where("nearest_distance is not null")).select("nearest_distance", "local_fdr")
    return out


def _thinned(points: DataFrame, most: int = 100_000) -> DataFrame:
    """About ``most`` points of a plot, chosen by their ids' hashes."""
    return points.where(F.pmod(F.xxhash64("id"), F.lit(max(1, points.count() // most))) == 0)


def diagnostic_panels(a) -> dict[str, DataFrame]:
    """Data of the diagnostic figure: distances against the null, q by distance, mismatches, counts (PL-2)."""
    spark = a.reads.sparkSession
    out = {
        "q_by_distance": _thinned(a.units.where("nearest_distance is not null")).select("nearest_distance", (-F.log10(F.greatest("q", F.lit(1e-300)))).alias("minus_log10_q")),
        "mismatches": calibration.mismatch_bars(a.tested),
        "counts": spark.createDataFrame([("reads", a.meta["read_count"]), ("tested", a.units.count()), ("removed", a.removed.count())], "what string, n bigint"),
    }
    if a.cdf is not None:
        radii = [r.radius for r in a.cdf.select("radius").distinct().orderBy("radius").collect()]
        curve = calibration.weighted_null_curve(a.cdf, a.tested, radii)
        out["null"] = spark.createDataFrame(list(zip(radii, curve)), "radius double, cdf double")
    return out


def write_plot(spark: SparkSession, path: str, panels: dict[str, DataFrame]) -> None:
    """A figure where matplotlib is there, else the panels' data as JSON beside the path's name."""
    data = {k: [r.asDict() for r in v.collect()] for k, v in panels.items()}
    try:
        import matplotlib
    except ImportError:
        sink.write_text(spark, f"{path}.json", json.dumps(data) + "\n")
        return
    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots(1, max(1, len(data)), figsize=(5 * len(data), 4))
    for axis, (name, rows) in zip(axes, data.items()):
        x, y = (list(c) for c in zip(*(list(r.values())[:2] for r in rows))) if rows else ([], [])
        axis.plot(x, y, ".", markersize=2)
        axis.set_title(name)
    out = io.BytesIO()
    figure.savefig(out, format="png", dpi=120)
    pyplot.close(figure)
    if not out.getvalue().endswith(PNG_END):
        raise RuntimeError(f"{path}: the figure has no end mark")
    # one write of the whole file, so no reader ever sees a part of it
    sink.write_bytes(spark, uri(path), out.getvalue())
