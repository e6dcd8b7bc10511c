"""Solvers against finite differences, brute force and each other."""

import numpy as np
import pytest
from cadenza.operators import solve as S


def series(n=120, s=4, seed=0, growth="linear", multiplicative=False):
    r = np.random.default_rng(seed)
    t = np.linspace(0, 1, n)
    x = np.column_stack([np.sin(2 * np.pi * 12 * t), np.cos(2 * np.pi * 12 * t)])
    points = np.linspace(0.2, 0.8, s)
    cap = np.full(n, 1.5) if growth == "logistic" else None
    rows = S.Rows(t, np.zeros(n), x, points, growth, np.full(2, float(multiplicative)), cap)
    theta = np.concatenate([[1.5, 0.3], np.r_[0.8, np.zeros(s - 1)], [0.1, -0.05]])
    rows.y = rows.mean(theta)[0] + 0.02 * r.standard_normal(n)
    return rows, theta


@pytest.mark.parametrize("growth", ["linear", "flat", "logistic"])
@pytest.mark.parametrize("multiplicative", [False, True])
def test_jacobian_is_the_derivative(growth, multiplicative):
    rows, _ = series(growth=growth, multiplicative=multiplicative)
    theta = np.random.default_rng(1).normal(0, 0.3, 8) + np.r_[1.0, 0.2, np.zeros(6)]
    mu, jac = rows.mean(theta)
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-6
        fd = (rows.mean(theta + step)[0] - rows.mean(theta - step)[0]) / 2e-6
        assert np.allclose(jac[:, k], fd, atol=1e-5)


def test_logistic_trend_is_continuous():
    s, delta = np.array([0.3, 0.6]), np.array([1.0, -2.0])
    gamma, _ = S.logistic_parts(2.0, 0.4, delta, s)
    k, m = 2.0, 0.4
    for i in range(2):
        left = k * (s[i] - m)
        k, m = k + delta[i], m + gamma[i]
        assert np.isclose(left, k * (s[i] - m))


def test_signed_quadratic_meets_its_conditions():
    r = np.random.default_rng(3)
    for _ in range(60):
        p = int(r.integers(1, 12))
        a = r.normal(size=(p + 3, p)) * 10 ** r.uniform(-2, 2, p)
        h, g = a.T @ a + 1e-3 * np.eye(p), r.normal(size=p) * 5
        l1 = np.where(r.random(p) < 0.6, r.uniform(0, 5, p), 0.0)
        x = S.signed_quadratic(h, g, l1)
        slope = h @ x + g
        assert np.all(np.abs(slope[x == 0]) <= l1[x == 0] + 1e-6)
        assert np.allclose((slope + l1 * np.sign(x))[x != 0], 0, atol=1e-6 * max(1, np.abs(g).max()))


def test_sigma_is_stationary():
    for ssr, n in ((0.3, 50), (12.0, 10), (1e-6, 1000)):
        s = S.best_sigma(ssr, n)
        assert abs(n / s - ssr / s**3 + s / 0.25) < 1e-6 * n / s
    assert S.best_sigma(0.0, 10) > 0


@pytest.mark.parametrize("n", [12, 60, 120, 1000])
def test_moments_and_rows_agree(n):
    rows, truth = series(n=n)
    z = np.column_stack([rows.t, np.ones(n), rows.hinge, rows.x])
    mo = S.Moments(n, z.T @ z, z.T @ rows.y, float(rows.y @ rows.y))
    a = S.fit_moments(mo, 4, np.full(2, 10.0), 0.05)
    b = S.fit_rows(rows, np.r_[a.k * 0.5, a.m, np.zeros(6)], np.full(2, 10.0), 0.05)
    assert a.status == b.status == "ok" and a.kkt < 1e-5
    assert abs(a.lp - b.lp) < 1e-5 * abs(a.lp)
    assert np.allclose(np.r_[a.k, a.m, a.delta, a.beta], np.r_[b.k, b.m, b.delta, b.beta], atol=1e-3)
    assert (a.delta == 0).any()


@pytest.mark.parametrize(("growth", "multiplicative"), [("linear", True), ("logistic", False), ("logistic", True), ("flat", True)])
def test_row_kernel_recovers(growth, multiplicative):
    rows, truth = series(n=400, growth=growth, multiplicative=multiplicative)
    start = np.r_[1.0, 0.2, np.zeros(6)]
    found = S.fit_rows(rows, start, np.full(2, 10.0), 0.05)
    theta = np.r_[found.k, found.m, found.delta, found.beta]
    assert found.kkt < 1e-2
    assert np.abs(rows.mean(theta)[0] - rows.mean(truth)[0]).max() < 0.03
    if growth == "flat":
        assert found.k == 0 and not found.delta.any()


@pytest.mark.parametrize(("noise", "seed"), [(0.08, 1), (0.01, 1), (0.01, 4)])
def test_logistic_fits_settle(noise, seed):
    """Series without growth: the objective is so flat that its rounding hides the last steps' gain."""
    n, r = 2500, np.random.default_rng(seed)
    t = np.linspace(0, 1, n)
    x = np.column_stack([f(j * 2 * np.pi * n / 7 * t) for j in (1, 2, 3) for f in (np.sin, np.cos)])
    rows = S.Rows(t, 0.6 + noise * r.standard_normal(n), x, np.linspace(0, 0.8, 6)[1:], "logistic", np.zeros(6), np.full(n, 1.25))
    found = S.fit_rows(rows, np.r_[0.2, 0.4, np.zeros(11)], np.full(6, 10.0), 0.05)
    theta = np.r_[found.k, found.m, found.delta, found.beta]
    d, l1 = S.priors({"tau": 0.05}, 5, np.full(6, 10.0))
    ssr, gradient = rows.gradient(theta, found.sigma)
    assert found.status == "ok" and S.kkt_residual(theta, found.sigma, gradient, ssr, n, d, l1) < 1e-6
    assert np.isclose(S.objective(theta, found.sigma, ssr, n, d, l1), -found.lp, rtol=1e-12) and S.least_curvature(rows, theta, d, l1) > -1e-6


def test_no_point_nearby_is_better():
    rows, _ = series(n=80)
    z = np.column_stack([rows.t, np.ones(80), rows.hinge, rows.x])
    mo = S.Moments(80, z.T @ z, z.T @ rows.y, float(rows.y @ rows.y))
    found = S.fit_moments(mo, 4, np.full(2, 10.0), 0.05)
    theta = np.r_[found.k, found.m, found.delta, found.beta]
    d, l1 = S.priors({"tau": 0.05}, 4, np.full(2, 10.0))
    best = S.objective(theta, found.sigma, mo.ssr(theta), 80, d, l1)
    r = np.random.default_rng(0)
    for _ in range(300):
        other = theta + r.normal(0, 10 ** r.uniform(-5, -1), 8)
        assert S.objective(other, found.sigma * np.exp(r.normal(0, 0.01)), mo.ssr(other), 80, d, l1) >= best - 1e-9
    assert np.isclose(S.quadratic_change(np.eye(2), np.zeros(2), np.ones(2)), 1.0)
    assert (S.curvature_spectrum(S.smooth_hessian(z, found.sigma, d)) > 0).all()
