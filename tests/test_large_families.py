"""Families and seeds above what one task or the run's limits hold."""

import random

from tilesieve import queries
from tilesieve.operators import candidates, quality
from tilesieve.plans import adapters


def _documents(spark, path, texts):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_family_above_the_limit_of_a_run_is_whole(spark, tmp_path):
    """F2 to F9: the SQL has no limit of families, so the queries have none."""
    n = 5010
    sf_dir = _documents(spark, tmp_path, ["twelve signs"] * n)
    assert queries.seed_candidates(spark, sf_dir).count() == n * (n - 1) // 2
    assert f"{n * (n - 1) // 2:,} candidate pairs" in queries.candidate_limit(spark, sf_dir).first().message


def test_pairs_by_seeds_and_families_come_once(spark, monkeypatch):
    """Blocks smaller than the families, seeds over and under the cap, short reads, repeated indexes."""
    monkeypatch.setattr(candidates, "FAMILY_BLOCK", 8)
    rng = random.Random(5)
    parts = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(6)]
    rows = [(i, "L" if i % 3 else "M", "".join(rng.choice(parts[:2] if rng.random() < 0.5 else parts) for _ in range(3))[: rng.choice((24, 24, 24, 18, 5))]) for i in range(400)]
    for reads in (rows, [*rows, *((i, "L", parts[0] * 3) for i in range(0, 40, 7))]):
        df = spark.createDataFrame([(i, lane, b, "I" * len(b)) for i, lane, b in reads], "pair_index bigint, lane string, bases string, quals string")
        found, details = candidates.candidate_pairs(df, 8, 16, 8, max_bucket=60, max_family=None)
        at = candidates.windows(8, 16, 8)
        sizes, want = {}, set()
        for _, lane, b in reads:
            for k, (_, _, s) in enumerate(at):
                if len(b[s : s + 8]) == 8:
                    sizes[lane, k, b[s : s + 8]] = sizes.get((lane, k, b[s : s + 8]), 0) + 1
        for x, lane, b in reads:
            for y, other, c in reads:
                if x < y and lane == other and (b == c or any(b[s : s + 8] == c[s : s + 8] and sizes.get((lane, k, b[s : s + 8]), 61) <= 60 for k, (_, _, s) in enumerate(at))):
                    want.add((x, y))
        got = sorted((r.l, r.r) for r in found.collect())
        assert got == sorted(want) and details["skipped_high_frequency_seed_buckets"] == sum(n > 60 for n in sizes.values()) > 0
        if reads is rows:
            carried = candidates.candidate_pairs(df, 8, 16, 8, max_bucket=60, max_family=None, carry=["bases", "quals"])[0]
            joined = quality.with_reads(found, df, ["bases", "quals"])
            assert sorted(carried.select(joined.columns).collect()) == sorted(joined.collect()) and carried.count() == len(want)


def test_scores_of_short_and_long_reads(spark):
    """Looked-up terms are those of the formulas, for reads of fewer cycles too."""
    import numpy as np

    rng = np.random.default_rng(3)
    for width in (20, quality.TABLED + 5):
        priors = rng.dirichlet(np.ones(4), width)
        texts = [("".join(rng.choice(list("ACGTN"), n)), "".join(chr(33 + q) for q in rng.integers(0, 70, n))) for n in rng.integers(width - 6, width + 1, 40)]
        rows = [(i, *texts[i], *texts[i + 20]) for i in range(20)]
        df = spark.createDataFrame(rows, "id bigint, l_bases string, l_quals string, r_bases string, r_quals string")
        got = quality.score_pairs(df, [tuple(map(float, p)) for p in priors]).orderBy("id").toPandas()
        code = {c: i for i, c in enumerate("ACGTN")}
        b = [np.array([[code[x] for x in t[0].ljust(width, "N")] for t in part]) for part in (texts[:20], texts[20:])]
        q = [np.array([[min(60, ord(x) - 33) for x in t[1].ljust(width, "!")] for t in part], float) for part in (texts[:20], texts[20:])]
        for name, want in quality.score_arrays(*b, *q, priors).items():
            assert np.array_equal(got[name], want), name


def test_reads_of_texts_are_the_letters_in_order(spark, tmp_path):
    texts = ["", "a", "Zebra\tÄÖ ſ İ\U0001f600 end" * 20, "x" * 60, "y z" * 40, "\n", None, "K" * 61]
    sf_dir = _documents(spark, tmp_path, texts)
    whole = {r.pair_index: r for r in adapters.whole_letters(spark, sf_dir).collect()}
    reads = adapters.text_reads(spark, sf_dir).orderBy("pair_index").collect()
    for c in ("bases", "quals"):
        assert {i: "".join(r[c] for r in reads if r.pair_index >> 26 == i) for i in whole} == {i: r[c] for i, r in whole.items()}
    assert all(len(r.bases) == 60 for r, s in zip(reads, reads[1:]) if r.pair_index >> 26 == s.pair_index >> 26)
