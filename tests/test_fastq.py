import gzip
import json

import pytest

from tilesieve.config import Config
from tilesieve.plans.run import run_exact
from tilesieve.sources import fastq, sink


def record(name, seq, qual=None, plus="+"):
    return f"@{name}\n{seq}\n{plus}\n{qual if qual is not None else 'I' * len(seq)}\n"


def write(path, text):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)
    return str(path)


NAMES = [f"L:1101:{10 * i}:{7 * i}" for i in range(12)]


def pair(tmp_path, one, two, suffix=".fastq"):
    return write(tmp_path / f"a{suffix}", one), write(tmp_path / f"b{suffix}", two)


@pytest.mark.parametrize("suffix", [".fastq", ".fastq.gz"])
def test_reads_and_pairs(spark, tmp_path, suffix):
    one = "".join(record(f"{n} 1:N", "ACgT", "I!~I") for n in NAMES)
    two = "".join(record(f"{n}/2 2:N", "GGN") for n in NAMES)[:-1]  # the last line is not ended
    pairs = fastq.read_pairs(spark, *pair(tmp_path, one.replace("1:N\n", "1:N\r\n"), two, suffix))
    reads, meta = fastq.to_reads(pairs)
    rows = reads.orderBy("pair_index").collect()
    assert [r.read_name for r in rows] == NAMES and meta == {"read_count": 12, "r1_length": 4, "r2_length": 3, "unparsed": 0}
    assert rows[3].bases == "ACGTGGN" and (rows[3].lane, rows[3].tile, rows[3].x, rows[3].y) == ("L", 1101, 30, 21) and rows[3].quality_sum == 40 + 0 + 60 + 40 + 3 * 40
    assert pairs.orderBy("pair_index").first().r1_header.endswith("\r")


@pytest.mark.parametrize(
    "one,two,why",
    [
        (record("a:1:2:3", "AC") + "@a:1:2:4\nAC\n", record("a:1:2:3", "AC") * 2, "truncated"),
        ("a:1:2:3\nAC\n+\nII\n", record("a:1:2:3", "AC"), "start with @"),
        (record("a:1:2:3", "AC", plus="-"), record("a:1:2:3", "AC"), "start with +"),
        (record("a:1:2:3", "AC", "I"), record("a:1:2:3", "AC"), "lengths differ"),
        (record("a:1:2:3", "AC") * 2, record("a:1:2:3", "AC"), "different numbers"),
        (record("a:1:2:3", "AC"), record("a:1:2:4", "AC"), "names differ at pair 1"),
        ("", "", "no records"),
    ],
)
def test_bad_files(spark, tmp_path, one, two, why):
    with pytest.raises(fastq.FastqError, match=why):
        fastq.read_pairs(spark, *pair(tmp_path, one, two))


def test_lengths_and_unparsed(spark, tmp_path):
    two = record("a:1:2:3", "AC") + record("a:1:2:4", "ACG")
    pairs = fastq.read_pairs(spark, *pair(tmp_path, two, two))
    with pytest.raises(fastq.FastqError, match="fixed lengths; pair 2"):
        fastq.to_reads(pairs)
    odd = record("a:1:2:3", "AC") + record("nowhere", "AC")
    pairs = fastq.read_pairs(spark, *pair(tmp_path, odd, odd))
    with pytest.raises(fastq.FastqError, match="pair 2"):
        fastq.to_reads(pairs)
    assert fastq.to_reads(pairs, "keep")[1]["unparsed"] == 1


@pytest.mark.parametrize("suffix", [".fastq", ".fastq.gz"])
def test_exact_mode(spark, tmp_path, suffix):
    # three copies in a chain, one far away, one on another tile, one different
    spots = [("1101", 0, 0, "I"), ("1101", 90, 0, "J"), ("1101", 180, 10, "H"), ("1101", 5000, 0, "I"), ("1102", 0, 0, "I")]
    lines = [record(f"R:{t}:{x}:{y}", "ACGT", q * 4) for t, x, y, q in spots] + [record("R:1101:1:1", "TTTT"), record("none", "ACGT")]
    r1, r2 = pair(tmp_path, "".join(lines), "".join(lines), suffix)
    out = [str(tmp_path / f"o{k}{suffix}") for k in (1, 2)]
    report = run_exact(spark, r1, r2, *out, str(tmp_path / "r.json"), str(tmp_path / "audit.tsv"), distance=100, unparsed="keep")
    assert (report["input_read_pairs"], report["removed_read_pairs"], report["retained_read_pairs"], report["optical_components"], report["unparsed_read_pairs"]) == (7, 2, 5, 1, 1)
    assert report["component_size_histogram"] == {"3": 1} and report["exact_family_excess"] == 5
    assert json.load(open(tmp_path / "r.json")) == report
    kept = (gzip.open if suffix.endswith("gz") else open)(out[0], "rt").read()
    assert kept == "".join(lines[i] for i in (1, 3, 4, 5, 6))
    audit = [x.split("\t") for x in open(tmp_path / "audit.tsv").read().splitlines()]
    assert audit[0][0] == "removed_pair_index" and [(a[0], a[2], a[9], a[11]) for a in audit[1:]] == [("1", "2", "-90", "90"), ("3", "2", "90", "90")]
    with pytest.raises(sink.OutputExists):
        run_exact(spark, r1, r2, *out, str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        sink.check_outputs(spark, [r1, r2], [r1])


def test_config():
    good = dict(r1="a", r2="b", output_r1="c", output_r2="d", report_json="e")
    Config(**good).validate()
    for bad in (dict(fdr=0), dict(seed_length=7), dict(fdr_method="weighted-bh"), dict(read_audit="x", inference_unit="edge"), dict(fdr_method="permutation", permutations=0), dict(null_resolution=3), dict(max_grid_step=0), dict(pi0_lambda=1)):
        with pytest.raises(ValueError):
            Config(**good, **bad).validate()


def test_command_line():
    from tilesieve.cli import parser

    args = parser().parse_args("filter --r1 a --r2 b --output-r1 c --output-r2 d --report-json e --no-spatial-test --no-adaptive-seed --fdr 0.05 --force".split())
    assert args.fdr == 0.05 and not args.spatial_test and not args.adaptive_seed and args.force and args.permutations == 20
    args = parser().parse_args("exact --r1 a --r2 b --output-r1 c --output-r2 d --report e".split())
    assert args.distance == 2500
