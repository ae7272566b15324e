import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.functions import graphs, models, penalized, special, trees
from cellgrid.operators import modeling
from cellgrid.sources import fcs, panel


def test_t_and_bh_against_published_table():
    t = [-5.48, -3.86, -2.88, 2.88, 3.39, -0.955, 5.14, -1.30]
    p = special.t_two_sided(t, 7)
    assert p == pytest.approx([0.000924, 0.00623, 0.0235, 0.0235, 0.0116, 0.371, 0.00134, 0.236], rel=0.02)
    assert special.benjamini_hochberg(p) == pytest.approx([0.00535, 0.0166, 0.0314, 0.0314, 0.0232, 0.371, 0.00535, 0.270], rel=0.02)


def test_tails_at_known_points():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert math.isnan(special.t_two_sided(float("nan"), 3))


@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_bh_is_monotone_and_not_below_p(p):
    a = special.benjamini_hochberg(np.array(p))
    order = np.argsort(p)
    assert (np.diff(a[order]) >= -1e-12).all() and (a >= np.array(p) - 1e-12).all() and (a <= 1).all()


def test_louvain_finds_two_cliques():
    a, b = zip(*[(i, j) for base in (0, 5) for i in range(base, base + 5) for j in range(base, i)] + [(0, 5)])
    labels, q = graphs.louvain(np.array(a), np.array(b), np.ones(len(a)), 10)
    assert len(set(labels[:5])) == 1 and len(set(labels[5:])) == 1 and labels[0] != labels[5] and q > 0.3


def test_spanning_tree_weight():
    x = np.random.default_rng(0).normal(size=(7, 2))
    tree = graphs.minimum_spanning_tree(trees.pairwise(x))
    assert len(tree) == 6 and {i for e in tree for i in e[:2]} == set(range(7))


@pytest.mark.parametrize("linkage", trees.LINKAGES)
def test_linkage_separates_blobs(linkage):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in (0, 5, 10)])
    labels = trees.linkage_labels(trees.pairwise(x), 3, linkage)
    assert [len(set(labels[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and len(set(labels)) == 3


@pytest.mark.parametrize("algorithm", ["hierarchical", "pam", "kmeans"])
def test_consensus_separates_blobs(algorithm):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (8, 2)) for c in (0, 5)])
    labels = trees.consensus_labels(x, 2, 20, algorithm=algorithm)
    assert set(labels[:8]) != set(labels[8:]) and len(set(labels)) == 2


def plain_elbow(errors):
    """The rule word by word: places from 1 to K, smoothed from left to right, lines through 1..i-1 and i..K."""
    s = {k: float(v) for k, v in enumerate(errors, 1)}
    last = len(s)
    for i in range(2, last):
        s[i] = 0.8 * s[i] + 0.1 * s[i - 1] + 0.1 * s[i + 1]
    best, least = 1, math.inf
    for i in range(2, last):
        miss = 0.0
        for places in (range(1, i), range(i, last + 1)):
            x, y = np.array(places, float), np.array([s[k] for k in places])
            slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum() if len(x) > 1 else 0.0
            miss += np.abs(y - y.mean() - slope * (x - x.mean())).sum()
        if miss < least - 1e-9:
            best, least = i, miss
    return best


def test_elbow_is_the_rule():
    assert trees.elbow(np.array([100, 60, 20, 19, 18, 17, 16.0])) == plain_elbow([100, 60, 20, 19, 18, 17, 16])
    rng = np.random.default_rng(8)
    for _ in range(200):
        curve = np.sort(rng.exponential(size=rng.integers(3, 15)))[::-1] * 100
        assert trees.elbow(curve) == plain_elbow(curve)


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = x @ np.array([2, -1, 0, 0, 0.5, 0]) + rng.normal(size=80)
    lam, mix = 0.1, 0.7
    beta, b0 = penalized.fit_gaussian(x, y, lam, mix)
    grad = x.T @ (y - x @ beta - b0) / 80 - lam * (1 - mix) * beta
    on = beta != 0
    assert np.abs(grad[on] - lam * mix * np.sign(beta[on])).max() < 1e-6 and np.abs(grad[~on]).max(initial=0) <= lam * mix + 1e-6
    p, c = penalized.fit_binomial(x, (y > 0).astype(float), lam, mix)
    mu = 1 / (1 + np.exp(-(x @ p + c)))
    grad = x.T @ ((y > 0) - mu) / 80 - lam * (1 - mix) * p
    assert np.abs(grad[p != 0] - lam * mix * np.sign(p[p != 0])).max(initial=0) < 1e-4


def test_cox_gradient_vanishes_without_penalty():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    time, event = rng.exponential(np.exp(-x[:, 0])), np.ones(60)
    beta = penalized.fit_cox(x, time, event, 0.0, 0.5)
    h = 1e-4
    slope = [(penalized.partial_likelihood(x @ (beta + h * e), time, event) - penalized.partial_likelihood(x @ (beta - h * e), time, event)) / (2 * h) for e in np.eye(2)]
    assert np.abs(slope).max() < 1e-2


def test_auc_and_concordance():
    assert penalized.auc(np.array([0.1, 0.4, 0.35, 0.8]), np.array([0, 0, 1, 1])) == pytest.approx(0.75)
    assert penalized.concordance(np.array([3.0, 2, 1]), np.array([1.0, 2, 3]), np.ones(3)) == 1.0


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 5), st.booleans()), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_survival_measures_by_hand(rows):
    eta, time, event = np.array(rows, float).T
    pairs = [(i, j) for i in range(len(eta)) for j in range(len(eta)) if event[i] and (time[j] > time[i] or time[j] == time[i] and not event[j])]
    good = [1.0 if eta[i] > eta[j] else 0.5 if eta[i] == eta[j] else 0.0 for i, j in pairs]
    assert penalized.concordance(eta, time, event) == pytest.approx(np.mean(good) if good else math.nan, nan_ok=True)
    like = sum(eta[i] - math.log(np.exp(eta[time >= time[i]]).sum()) for i in np.flatnonzero(event))
    assert penalized.partial_likelihood(eta, time, event) == pytest.approx(like)
    at, hazard = penalized.breslow(np.exp(eta), time, event)
    assert hazard.tolist() == pytest.approx(np.cumsum([event[time == t].sum() / np.exp(eta[time >= t]).sum() for t in at]).tolist())


def test_survival_measures_of_many_samples():
    rng = np.random.default_rng(4)
    eta, time, event = rng.normal(size=300_000), rng.random(300_000), np.ones(300_000)
    assert penalized.concordance(eta, time, event) == pytest.approx(0.5, abs=0.01)  # pair by pair this takes hours
    assert np.isfinite(penalized.partial_likelihood(eta, time, event)) and len(modeling.log_rank_thresholds(eta, time, event)) == 300_000


def test_mixed_models_of_many_samples():
    n = 60_000
    rng = np.random.default_rng(8)
    g, side = np.repeat(np.arange(n // 2), 2), np.arange(n) % 2
    x, own = np.column_stack((np.ones(n), side)), rng.normal(size=n // 2)[g]
    y = 3 + 0.5 * side + own + rng.normal(size=n)
    got = models.lmm(x, y, [g.astype(str)])  # a matrix of these samples takes 29 GB
    gap = y[1::2] - y[::2]
    assert got["beta"][1] == pytest.approx(gap.mean(), abs=1e-9) and got["se"][1] == pytest.approx(gap.std(ddof=1) / math.sqrt(n / 2), rel=1e-4) and got["ratios"][0] == pytest.approx(1, abs=0.05)
    total = np.full(n, 100.0)
    share = rng.binomial(100, 1 / (1 + np.exp(-(-1 + 0.3 * side + 0.5 * own)))) / total
    got = models.glmm(x, share, total, [g.astype(str)])
    assert got["beta"] == pytest.approx([-1, 0.3], abs=0.02) and got["variances"][0] == pytest.approx(0.25, abs=0.02)


def test_mixed_model_of_two_factors_by_dense_matrices():
    rng = np.random.default_rng(5)
    g, h = rng.integers(0, 9, 60), rng.integers(0, 4, 60)
    x = np.column_stack((np.ones(60), rng.normal(size=60)))
    y = x @ [2.0, 1.0] + rng.normal(size=9)[g] + rng.normal(size=4)[h] + rng.normal(size=60)
    got = models.lmm(x, y, [h.astype(str), g.astype(str)])
    v = np.eye(60) + sum(t * (c[:, None] == c[None]) for t, c in zip(got["ratios"], (h, g), strict=True))
    inverse = np.linalg.inv(x.T @ np.linalg.solve(v, x))
    assert got["beta"] == pytest.approx(inverse @ x.T @ np.linalg.solve(v, y))
    assert got["se"] == pytest.approx(np.sqrt(np.diag(inverse) * got["s2"]))


def test_mixed_model_with_no_group_effect_is_least_squares():
    rng = np.random.default_rng(5)
    x = np.column_stack((np.ones(40), np.tile([0.0, 1.0], 20)))
    y = x @ [1.0, 0.5] + rng.normal(size=40)
    group = np.repeat(np.arange(20), 2).astype(str)
    paired = models.lmm(x, y + np.repeat(rng.normal(0, 3, 20), 2), [group])
    assert paired["beta"][1] == pytest.approx(models.ols(x, y)["beta"][1], abs=1e-6)
    assert paired["df"][1] == pytest.approx(19, abs=1.0)


def test_binomial_model_is_log_odds():
    x = np.column_stack((np.ones(2), [0.0, 1.0]))
    fit = models.binomial_glm(x, np.array([0.2, 0.5]), np.array([100.0, 100.0]))
    assert fit["beta"] == pytest.approx([math.log(0.25), math.log(4)], abs=1e-6)


def test_fcs_bytes_round_trip():
    data = np.random.default_rng(6).normal(size=(20, 3)).astype("f4").astype(float)
    text, back = fcs.parse_fcs(fcs.encode_fcs(data, ["a", "b|c", "d"]))
    assert np.array_equal(data, back) and text["$TOT"] == "20" and text["$P2N"] == "b_c"


def test_panel_from_names():
    assert panel.split_channel("Nd142Di", "142Nd_CD19") == ("Nd142", "CD19")
    assert panel.split_channel("Time", "") == ("Time", "empty")
    assert panel.panel_of(["Time", "FSC-A"], ["", ""]) == [("Time", "Time"), ("FSC-A", "FSC-A")]


def test_lowess_follows_a_line_and_shrugs_off_an_outlier():
    x = np.arange(30.0)
    assert models.lowess(x, 2 * x + 1) == pytest.approx(2 * x + 1)
    y = 2 * x + 1 + np.random.default_rng(9).normal(0, 0.1, 30)
    y[10] = 500
    assert np.abs(models.lowess(x, y) - (2 * x + 1)).max() < 1


def test_dispersions_follow_the_rows():
    """Half the rows are Poisson, half vary much more: a small change of a calm row tells less the more its dispersion is drawn to all."""
    rng = np.random.default_rng(10)
    x = np.column_stack((np.ones(24), np.repeat([0.0, 1.0], 12)))
    mean = np.full(24, 200.0)
    calm = rng.poisson(mean, (10, 24)).astype(float)
    wild = rng.poisson(mean * rng.gamma(2, 0.5, (10, 24))).astype(float)
    changed = calm[:1] * np.where(x[:, 1] > 0, 1.3, 1.0)
    rows = np.concatenate((calm, wild, changed))
    own, drawn, common = (models.negative_binomial(rows, np.full(24, 4000.0), x, [np.array([[0.0], [1.0]])], prior)[0] for prior in (0.0, 10.0, 1000.0))
    assert own["p"][20] < 1e-6 < drawn["p"][20] < 0.05 < common["p"][20]
    assert all((f["p"][:20] < 0.05).sum() <= 4 for f in (own, drawn, common))
    assert drawn["effect"][20] == pytest.approx(math.log2(1.3), abs=0.15)
    assert np.abs(drawn["effect"][10:20]).max() > np.abs(drawn["effect"][:10]).max()
