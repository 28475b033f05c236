import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.plans import privacy as P
from marginalia.plans.graph import DisjointSets, JunctionTree, elimination_order, triangulate
from marginalia.plans.schema import Domain, all_kway, containing, downward_closure, powerset, workload_scores


def test_domain_algebra():
    d = Domain.fromdict({"a": 10, "b": 20, "c": 30})
    assert Domain(("a", "b"), (10, 20)).merge(Domain(("b", "c"), (20, 30))) == d
    assert d.project(("c", "a")).shape == (30, 10) and d.project("b").attrs == ("b",)
    assert d.marginalize(["b"]) == d.project(("a", "c")) and d.invert(["a"]) == ("b", "c")
    assert d.axes(("c", "a")) == (2, 0) and d.strides() == (600, 30, 1) and d.size() == 6000 and d.size(("a",)) == 10
    assert d.sort("name").attrs == ("a", "b", "c") and Domain(("x", "y"), (5, 2)).sort().attrs == ("y", "x")
    assert d.canonical(("c", "a")) == ("a", "c") and d.contains(d.project(("b",))) and "a" in d and len(d) == 3 and list(d) == ["a", "b", "c"]
    assert Domain.from_struct(d.struct()) == d and "a: 10" in str(d)
    with pytest.raises(ValueError):
        d.sort("other")
    with pytest.raises(ValueError):
        d.merge(Domain(("a",), (3,)))
    with pytest.raises(KeyError):
        d["z"]


def test_workloads():
    assert powerset([1, 2, 3]) == [(1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3)]
    assert downward_closure([("b", "a"), ("b", "c")]) == [("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    d = Domain.fromdict(dict.fromkeys("abcdef", 2))
    assert len(all_kway(d, 2)) == 15 and len(set(all_kway(d, 3, 5, seed=1))) == 5
    assert containing([("a", "b", "c"), ("a", "b")], ("b",), d) == ("a", "b") and containing([("a",)], ("b",), d) is None
    assert workload_scores([("a", "b"), ("b", "c")])[("b",)] == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 8))
def test_junction_tree_properties(seed, n):
    rng = random.Random(seed)
    d = Domain.fromdict({f"x{i}": rng.randint(2, 5) for i in range(n)})
    cliques = [tuple(rng.sample(d.attrs, min(n, rng.randint(1, 3)))) for _ in range(rng.randint(0, 6))]
    t = JunctionTree(d, cliques, order=rng.choice([None, 3]))
    assert all(any(set(c) <= set(m) for m in t.cliques) for c in cliques)
    assert {a for c in t.cliques for a in c} == set(d.attrs) and len(t.edges) == len(t.cliques) - 1
    for a in d:  # running intersection
        own = [c for c in t.cliques if a in c]
        sets = DisjointSets()
        for u, v in t.edges:
            if a in u and a in v:
                sets.union(u, v)
        assert all(sets.connected(own[0], c) for c in own)
    sent = set()
    for i, j in t.message_order:
        assert all((k, i) in sent for k in t.neighbors[i] if k != j)
        sent.add((i, j))
    assert len(sent) == 2 * len(t.edges) and sorted(t.preorder) == sorted(t.cliques)
    assert triangulate(d, cliques, elimination_order(d, cliques))[1] >= t.size()


def test_path_runs_along_the_tree():
    t = JunctionTree(Domain.fromdict(dict.fromkeys("abcd", 2)), [("a", "b"), ("b", "c"), ("c", "d")])
    assert t.path(("a", "b"), ("c", "d")) == [("a", "b"), ("b", "c"), ("c", "d")]


@pytest.mark.parametrize("eps,delta", [(0.1, 1e-6), (1.0, 1e-5), (2.5, 1e-5), (8.0, 1e-9)])
def test_concentrated_privacy_round_trip(eps, delta):
    rho = P.cdp_rho(eps, delta)
    assert P.cdp_delta(rho, eps) <= delta * (1 + 1e-6) and P.cdp_eps(rho, delta) == pytest.approx(eps, rel=1e-6)
    assert P.cdp_delta(rho, eps) <= P.cdp_delta_standard(rho, eps)
    best = math.exp(min((a - 1) * (a * rho - eps) + a * math.log1p(-1 / a) - math.log(a - 1) for a in np.linspace(1.01, 400, 400_000)))
    assert P.cdp_delta(rho, eps) == pytest.approx(best, rel=1e-3)
    assert P.cdp_rho(eps, 0) == 0 and P.cdp_delta(0, eps) == 0 and P.cdp_eps(0.1, 1.5) == 0


def test_noise_calibration():
    s = P.gaussian_mech(1.0, 1e-5)
    rho = 1 / (2 * s * s)
    assert rho + 2 * math.sqrt(rho * math.log(1e5)) == pytest.approx(1.0)
    assert P.gaussian_mech(1.0, 1e-5, k=4) == pytest.approx(2 * s)
    a = P.ana_gaussian_mech(1.0, 1e-5)
    assert a < P.classical_gaussian_mech(1.0, 1e-5) and a == pytest.approx(3.73, abs=0.01)
    assert P.laplace_mech(1.0, 0) == 1.0 and P.laplace_mech(1.0, 1e-5, k=50) < 50
    assert P.randresponse_mech(1.0, 0) == pytest.approx(math.e / (1 + math.e)) and P.randresponse_mech(1.0, 1e-5, k=20) > P.randresponse_mech(1.0, 0, k=20)
    e, d = P.subsample_epsdelta(1.0, 1e-5, 0.1)
    assert P.subsample_epsdelta_inverse(e, d, 0.1) == pytest.approx((1.0, 1e-5)) and P.subsample_prob(1.0, 1e-5, e, d) == pytest.approx(0.1)
    assert 0 < P.subsampled_prob_for(lambda x: P.rdp_gaussian(1.0, x), 1.0, 1e-5) < 1
    with pytest.raises(ValueError):
        P.classical_gaussian_mech(2.0, 1e-5)


def test_budget():
    b, u = P.Budget(1.0, 1e-5), P.Budget(1.0, 1e-5, bounded=False)
    assert (b.sensitivity, u.sensitivity) == (2.0, 1.0) and b.marginal_sensitivity == pytest.approx(math.sqrt(2)) and P.Budget(1.0, 0).rho == 0
    assert b.best_noise(1, 1, 1.0, 1e-5)[0] == "laplace" and b.best_noise(1000, 1, 1.0, 1e-5)[0] == "gaussian"
    assert b.laplace_noise_scale(1, 0.5) == 4.0 and u.laplace_noise_scale(1, 0.5) == 2.0
    assert len({frozenset(c) for c in combinations("abc", 2)}) == 3


def test_subsampled_noise_grows_with_the_probability():
    for mech in (P.gaussian_mech, P.laplace_mech):
        noise = [mech(1.0, 1e-5, prob=p) for p in (1e-4, 0.01, 0.1, 0.5, 0.9, 1 - 1e-9)]
        assert noise == sorted(noise) and noise[0] > 0.05
        assert noise[-1] == pytest.approx(mech(1.0, 1e-5), rel=0.02)
        assert mech(1.0, 1e-5, 50, 0.1) > mech(1.0, 1e-5, 1, 0.1)
    s = P.gaussian_mech(1.0, 1e-5, 10, 0.05)
    rdp = lambda a: P.rdp_subsampled(lambda x: P.rdp_gaussian(s, x), 0.05, a, True)
    assert P.eps_from_rdp(rdp, 1e-5, 10) == pytest.approx(1.0, rel=1e-6)
    assert P.subsampled_prob_for(lambda a: P.rdp_gaussian(0.01, a), 1.0, 1e-5) < 1e-3
    assert P.subsampled_prob_for(lambda a: P.rdp_gaussian(100.0, a), 1.0, 1e-5) > 0.99
    for p in (0.0, 0.3, 1.0):
        assert P.rdp_subsampled(lambda a: 2.0, p, 3.0) == pytest.approx(math.log(1 - p + p * math.exp(4.0)) / 2)
    with pytest.raises(ValueError):
        P.gaussian_mech(1.0, 1e-5, prob=0.0)
    assert P.subsample_epsdelta_inverse(1.0, 0.5, 0.1)[1] == 1.0


def test_sampled_gaussian_divergence_is_exact():
    """Against numeric integration of the mixture's density ratio."""
    import numpy as np

    for a, q, s in ((2, 0.3, 1.0), (5, 0.1, 1.5)):
        x = np.linspace(-30, 30, 600_001)
        base = np.exp(-(x**2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
        ratio = 1 - q + q * np.exp((2 * x - 1) / (2 * s * s))
        want = math.log(float((base * ratio**a).sum() * (x[1] - x[0]))) / (a - 1)
        assert P.rdp_subsampled(lambda o, s=s: P.rdp_gaussian(s, o), q, a, True) == pytest.approx(want, rel=1e-6)


def test_budgets_draw_their_own_seeds():
    assert P.Budget(1.0, 1e-5).seed != P.Budget(1.0, 1e-5).seed and P.Budget(1.0, 1e-5, seed=3).seed == 3


@pytest.mark.parametrize("prob", [0.02, 0.1, 0.6])
def test_the_sampling_probability_comes_back(prob):
    sigma = P.gaussian_mech(1.0, 1e-5, 3, prob)
    assert P.subsampled_prob_for(lambda a: P.rdp_gaussian(sigma, a), 1.0, 1e-5, 3, exact=True) == pytest.approx(prob, rel=1e-4)


def test_random_response_on_samples():
    answers = [P.randresponse_mech(1.0, 1e-5, 5, p) for p in (1.0, 0.5, 0.1)]
    assert answers == sorted(answers) and P.randresponse_mech(1.0, 1e-5, 5, 1 - 1e-9) == pytest.approx(answers[0])
    p = P.randresponse_mech(1.0, 0, 2, 0.5)
    assert 2 * math.log1p(0.5 * math.expm1(math.log(p / (1 - p)))) == pytest.approx(1.0)
