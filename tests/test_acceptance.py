"""Whole runs on simulated reads with known duplicates."""

import csv
import gzip
import json

import pytest

from tilesieve.config import Config
from tilesieve.plans.run import run
from tilesieve.sim import score, spike
from tilesieve.sim.simulate import Scenario, simulate
from tilesieve.sources.fastq import read_records

READS = 40_000


def filtered(spark, prefix, out, **options):
    out.mkdir()
    kind = options.get("inference_unit", "read")
    audits = {"candidate_audit": str(out / "pairs.tsv.gz"), "removed_audit": str(out / "removed.tsv"), "read_audit": str(out / "reads.tsv") if kind == "read" else None}
    config = Config(f"{prefix}_R1.fastq.gz", f"{prefix}_R2.fastq.gz", str(out / "o1.fastq.gz"), str(out / "o2.fastq.gz"), str(out / "r.json"), report_md=str(out / "r.md"), qq_plot=str(out / "qq.png"), **audits, **options)
    return run(spark, config)


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    work = tmp_path_factory.mktemp("mixed")
    simulate(spark, str(work / "m"), Scenario(reads=READS, seed=17))
    report = filtered(spark, work / "m", work / "default")
    truth = score.read_truth(spark, str(work / "m.truth.tsv.gz"))
    return work, report, truth, score.score(truth, score.kept_names(spark, str(work / "default/o1.fastq.gz")))


def test_defaults_find_duplicates(mixed):
    work, report, _, found = mixed
    assert found["sensitivity"] >= 0.95 and found["cross_tile_sensitivity"] >= 0.85
    assert found["empirical_read_level_fdr"] <= 0.02
    controls = report["null_calibration"]["controls"]
    assert controls["permutation"]["max_excess_over_uniform"] <= 0.03 and controls["analysis"]["tail_inflation"] >= 2
    f = report["filtering"]
    assert f["retained_read_pairs"] + f["removed_read_pairs"] == READS
    assert sum((int(k) - 1) * n for k, n in f["component_size_histogram"].items()) == f["removed_read_pairs"] == found["removed_read_pairs"]
    assert json.load(open(work / "default/r.json")) == json.loads(json.dumps(report))


def test_audits_agree(mixed):
    work, report, _, _ = mixed
    removed = list(csv.DictReader(open(work / "default/removed.tsv"), delimiter="\t"))
    reads = list(csv.DictReader(open(work / "default/reads.tsv"), delimiter="\t"))
    with gzip.open(work / "default/pairs.tsv.gz", "rt") as f:
        pairs = list(csv.DictReader(f, delimiter="\t"))
    assert len(removed) == report["filtering"]["removed_read_pairs"] and len(removed[0]) == 19
    assert len(pairs) == report["counts"]["tested_candidate_edges"] and len(pairs[0]) == 27 + 4 + 2
    assert len(reads) == report["multiple_testing"]["permutation"]["hypotheses"]
    gone = {r["removed_pair_index"] for r in removed}
    assert {r["read_pair_index"] for r in reads if r["removed"] == "1"} == gone
    assert [int(p["candidate_edge_id"]) for p in pairs] == list(range(1, len(pairs) + 1))
    names = {r["removed_read_name"] for r in removed}
    with gzip.open(work / "default/o1.fastq.gz", "rt") as f:
        kept = [line[1:].split()[0] for i, line in enumerate(f) if i % 4 == 0]
    assert len(kept) + len(names) == READS and not names & set(kept)


def test_same_tile_edges_miss_crossing_pairs(spark, mixed):
    work, _, truth, default = mixed
    filtered(spark, work / "m", work / "edge", tile_neighborhood="same-tile", inference_unit="edge", fdr_method="bh", permutations=2)
    legacy = score.score(truth, score.kept_names(spark, str(work / "edge/o1.fastq.gz")))
    assert legacy["cross_tile_sensitivity"] <= 0.1 and default["cross_tile_sensitivity"] - legacy["cross_tile_sensitivity"] >= 0.5
    assert default["removed_read_pairs"] <= 1.3 * legacy["removed_read_pairs"]


def test_nothing_to_find(spark, tmp_path):
    simulate(spark, str(tmp_path / "n"), Scenario(reads=READS, seed=101, optical_rate=0, polyg_rate=0, pcr_duplicate_rate=0.15))
    report = filtered(spark, tmp_path / "n", tmp_path / "out")
    controls = report["null_calibration"]["controls"]
    assert report["filtering"]["removed_read_pairs"] == 0
    assert controls["analysis"]["max_excess_over_uniform"] <= 0.02 and 0.7 <= controls["analysis"]["tail_inflation"] <= 1.35
    assert controls["permutation"]["max_excess_over_uniform"] <= 0.02
    assert report["multiple_testing"]["mixture"]["pi0"] >= 0.95


def test_seeds_follow_the_qualities(spark, tmp_path):
    simulate(spark, str(tmp_path / "q"), Scenario(reads=READS, seed=17, flat_quality=13))
    truth = score.read_truth(spark, str(tmp_path / "q.truth.tsv.gz"))
    recall, length = {}, {}
    for adaptive in (False, True):
        out = tmp_path / f"adaptive{adaptive}"
        report = filtered(spark, tmp_path / "q", out, adaptive_seed=adaptive, permutations=2)
        pairs = spark.read.csv(str(out / "pairs.tsv.gz"), sep="\t", header=True).select("read_pair_1_name", "read_pair_2_name")
        recall[adaptive] = score.retrieval_recall(truth, pairs)
        length[adaptive] = report["candidate_retrieval"]["seed_length_selection"]["selected"]
    assert length[True] < length[False]
    assert recall[True] - recall[False] >= 0.2 and recall[True] >= 0.95


def test_spiked_copies_stay(spark, tmp_path):
    """Copies put in the place of other reads: none is removed with its donor as the reason."""
    made = simulate(spark, str(tmp_path / "s"), Scenario(reads=8000, seed=3, optical_rate=0, polyg_rate=0, pcr_duplicate_rate=0))
    truth = spike.spike(spark, made["r1"], made["r2"], str(tmp_path / "k"), 0.1)
    at = {r.header[1:].split()[0]: r.seq for r in read_records(spark, str(tmp_path / "k_R1.fastq.gz")).collect()}
    assert truth["spiked_pcr_duplicates"] == len(truth["spiked"]) == 800
    assert all(sum(a != b for a, b in zip(at[to], at[source])) < 20 for to, source in truth["spiked"].items())
    report = filtered(spark, tmp_path / "k", tmp_path / "out")
    kept = {r.read_name for r in score.kept_names(spark, str(tmp_path / "out/o1.fastq.gz")).collect()}
    assert report["counts"]["tested_candidate_edges"] >= 700 and len(set(truth["spiked"]) - kept) == 0
