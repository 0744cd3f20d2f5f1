import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilesieve.operators import calibration, candidates, multiplicity, quality
from tilesieve.operators.components import connected_components
from tilesieve.plans.ordered import Ordered


def frame(spark, p):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id bigint, p double")


def by_id(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def bh(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_bh_by_and_permutation(spark):
    random = np.random.default_rng(1)
    p = np.round(random.random(500) ** 2, 2)
    tests = frame(spark, p)
    assert np.allclose(by_id(multiplicity.bh_q(tests), "q_bh"), bh(p))
    assert np.allclose(by_id(multiplicity.by_q(tests), "q_by"), np.minimum(1, bh(p) * (1 / np.arange(1, 501)).sum()))
    assert np.allclose(by_id(multiplicity.by_from_bh(multiplicity.bh_q(tests)), "q_by"), by_id(multiplicity.by_q(tests), "q_by"))
    other = np.round(random.random((3, 500)), 2)
    permuted = spark.createDataFrame([(k, float(x)) for k in range(3) for x in other[k]], "replicate int, p double")
    rate = np.array([min(1, (other <= t).sum() / 3 / (p <= t).sum()) for t in p])
    want = np.array([rate[p >= t].min() for t in p])
    assert np.allclose(by_id(multiplicity.permutation_q(tests, permuted, 3), "q_permutation"), want)
    assert multiplicity.bh_q(tests.where("id < 0")).count() == 0


def local_fdr_plain(p, lam=0.5):
    x = np.unique(np.concatenate([[0], p, [1]]))
    f = np.array([(p <= v).mean() for v in x])
    f[-1] = 1
    slopes = np.array([min(max((f[b] - f[a]) / (x[b] - x[a]) for b in range(k + 1, len(x))) for a in range(k + 1)) for k in range(len(x) - 1)])
    at = np.clip(np.searchsorted(x, p, "right") - 1, 0, len(slopes) - 1)
    pi0 = min(1, max(min(1, (p > lam).mean() / (1 - lam)), slopes[-1], 1e-6))
    lf = np.minimum(1, pi0 / np.maximum(slopes[at], 1e-12))
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.maximum.accumulate(lf[order])
    out[p >= 1] = 1
    return out, pi0


@pytest.mark.parametrize("power,atom", [(1, 0), (4, 0), (4, 20)])
def test_local_fdr(spark, power, atom):
    p = np.round(np.random.default_rng(power).random(120) ** power, 3)
    p[:atom] = 1.0
    got, mixture = multiplicity.local_fdr(frame(spark, p))
    want, pi0 = local_fdr_plain(p)
    assert abs(mixture.pi0 - pi0) < 1e-9
    assert np.allclose(by_id(got, "local_fdr"), want, atol=1e-9)
    q = by_id(multiplicity.local_fdr_q(got), "q_local_fdr")
    order = np.argsort(want, kind="stable")
    run = np.empty(len(p))
    run[order] = np.cumsum(want[order]) / np.arange(1, len(p) + 1)
    assert np.allclose(q, np.where(want >= 1, 1, run), atol=1e-9)


def test_calibration(spark):
    p = np.linspace(0.001, 1, 1000)
    c = calibration.calibration(frame(spark, p))
    assert c["count"] == 1000 and abs(c["max_excess_over_uniform"]) < 1e-9 and abs(c["tail_inflation"] - 1) < 0.01
    assert calibration.calibration(frame(spark, []))["count"] == 0
    assert abs(calibration.chi2_upper(0.5) - 0.454936423) < 1e-8


def test_ordered_is_global(spark):
    random = np.random.default_rng(4)
    v = random.random(300)
    o = Ordered(frame(spark, v), "p", "id", buckets=7).rank().running("sum", "p", "s").running("min", "p", "m", backwards=True).result()
    order = np.argsort(v)
    assert np.allclose(by_id(o, "rank")[order], np.arange(1, 301))
    assert np.allclose(by_id(o, "s")[order], np.cumsum(v[order]))
    assert np.allclose(by_id(o, "m"), v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=30))
def test_scores_against_four_bases(cycles):
    b1, b2, q1, q2 = (np.array([c]) for c in zip(*cycles))
    random = np.random.default_rng(len(cycles))
    priors = random.dirichlet([2, 2, 2, 2], len(cycles))
    got = quality.score_arrays(b1, b2, q1.astype(float), q2.astype(float), priors)
    bayes, chances, m = 0.0, [], 0
    for c, (x, y, u, v) in enumerate(cycles):
        if x == 4 or y == 4:
            continue
        e, f = min(0.75, 10 ** (-u / 10)), min(0.75, 10 ** (-v / 10))
        call = lambda b, t, w: 1 - w if b == t else w / 3
        joint = sum(priors[c][t] * call(x, t, e) * call(y, t, f) for t in range(4))
        own = sum(priors[c][t] * call(x, t, e) for t in range(4)) * sum(priors[c][t] * call(y, t, f) for t in range(4))
        bayes += np.log10(max(joint / own, 1e-300)) if own > 0 else 0.0
        chances.append(e + f - 4 / 3 * e * f)
        m += x != y
    state = np.array([1.0])
    for q in chances:
        state = np.convolve(state, [1 - q, q])
    assert got["mismatches"][0] == m and got["valid_bases"][0] == len(chances)
    assert abs(got["log10_bayes_factor"][0] - bayes) < 1e-6
    assert abs(got["expected_mismatches"][0] - sum(chances)) < 1e-9
    assert abs(got["compatibility_p"][0] - max(1e-300, state[m:].sum())) < 1e-9


def test_tail_keeps_its_precision():
    p = np.full((1, 40), 1e-3)
    from math import comb

    want = sum(comb(40, k) * 1e-3**k * (1 - 1e-3) ** (40 - k) for k in range(8, 41))
    assert abs(quality.tail_at_least(p, np.array([8]))[0] / want - 1) < 1e-9


def test_seed_length():
    good = candidates.choose_seed_length([0.0001] * 180, 40_000, 20, True)
    poor = candidates.choose_seed_length([0.05] * 180, 40_000, 20, True)
    assert good.selected == 20 and poor.selected == max(8, poor.length_supported_by_quality, poor.length_needed_to_discriminate) < 20
    assert candidates.choose_seed_length([0.05] * 180, 40_000, 20, False).selected == 20


@pytest.mark.parametrize("hub", [1024, 3])
@pytest.mark.parametrize("shape", ["path", "random", "stars", "none"])
def test_components(spark, shape, hub, monkeypatch):
    from tilesieve.operators import components

    monkeypatch.setattr(components, "LEAST", hub)
    random = np.random.default_rng(2)
    edges = {"path": [(i, i + 1) for i in range(80)], "random": random.integers(0, 300, (200, 2)).tolist(), "stars": [(k, 1000 + i) for k in range(3) for i in range(k, 60, 3)], "none": []}[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (5, None)], "l bigint, r bigint"), "l", "r").collect()}
    assert got == {x: find(x) for x in parent}


def test_candidates_limits(spark):
    reads = spark.createDataFrame([(i, "L", "ACGTACGTACGTACGT" if i < 5 else "A" * 16, "I" * 16) for i in range(9)], "pair_index bigint, lane string, bases string, quals string")
    pairs, details = candidates.candidate_pairs(reads, 8, 8, 8, max_bucket=4)
    assert pairs.count() == 10 + 6 and details["skipped_high_frequency_seed_buckets"] == 2
    with pytest.raises(ValueError):
        candidates.candidate_pairs(reads, 8, 8, 8, max_family=4)
    with pytest.raises(MemoryError):
        candidates.check_candidates(17, 16, details)
    assert candidates.candidate_pairs(reads, 8, 8, 8, max_bucket=9, min_entropy=1.0)[1]["skipped_low_complexity_seed_buckets"] == 2


def test_shared_folder_is_demanded_on_a_cluster():
    """Without the setting only a local session gets a folder of its own."""
    from types import SimpleNamespace

    from tilesieve.plans.shared import shared_dir

    def session(master, given=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: given), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[2]")).startswith("file://")


def test_simulator_draws_by_cluster(spark):
    """Clusters are the same whatever the partitioning; kinds and rates are the scenario's."""
    from tilesieve.sim.simulate import Scenario, clusters, quality_levels

    s = Scenario(reads=2000, seed=5)
    rows = {r.id: r for r in clusters(spark, s).collect()}
    assert len(rows) == 2000 and len({r.name for r in rows.values()}) == 2000
    kinds = {k: sum(r.mechanism == k for r in rows.values()) for k in ("optical", "pcr", "polyg", "unique")}
    assert kinds == s.counts()
    for r in rows.values():
        if r.mechanism == "optical":
            p = rows[r.parent]
            assert p.mechanism == "unique" and r.molecule == r.parent and abs(p.tile - r.tile) == r.cross_tile and p.slot == r.slot
    crossing = sum(r.cross_tile for r in rows.values()) / kinds["optical"]
    assert 0.05 < crossing < 0.35
    level = quality_levels(Scenario(bad_tail_cycles=10, bad_tail_quality=8))
    assert level[0] == 35 and abs(level[-1] - 8) < 1e-9 and set(quality_levels(Scenario(flat_quality=13))) == {13}
