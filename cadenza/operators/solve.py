"""NumPy solvers for one series: maximum a posteriori parameters and their optimality certificate.

The posterior's negative logarithm is, up to a constant,

    T ln sigma + SSR / (2 sigma^2) + sigma^2 / (2 * 0.5^2) + k^2 / 50 + m^2 / 50 + sum beta^2 / (2 s^2) + sum |delta| / tau

Its kink at delta = 0 is met by an active-set search over signs, so that unused rate changes are exactly zero. sigma has a closed
form given the residuals. Where predictions are linear in the parameters, the data enter by their moments only;
otherwise each step linearises the mean and solves the same subproblem, damped until the posterior falls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .. import constants as C

FLAT_EPS = 1e-10


@dataclass
class Moments:
    """Sums over the rows z = (t, 1, hinges, features) and scaled target y."""

    n: int
    zz: np.ndarray
    zy: np.ndarray
    yy: float

    def ssr(self, theta: np.ndarray) -> float:
        return max(0.0, float(self.yy - 2 * self.zy @ theta + theta @ self.zz @ theta))


def best_sigma(ssr: float, n: int) -> float:
    """The positive root of n / sigma - ssr / sigma^3 + sigma / s^2."""
    s2 = C.SIGMA_PRIOR**2
    root = np.sqrt(float(n) ** 2 + 4 * ssr / s2)
    return float(max(np.sqrt(s2 * 2 * (ssr / s2) / (n + root)), 1e-9)) if ssr > 0 else 1e-9


def signed_quadratic(h: np.ndarray, g: np.ndarray, l1: np.ndarray, start: np.ndarray | None = None, most: int = 500) -> np.ndarray:
    """Minimises x'Hx / 2 + g'x + sum l1 |x| for positive definite H, with exact zeros where l1 > 0.

    Keeps a set of free entries with their signs, moves towards that set's minimiser up to the first sign change, and frees
    the zero entry whose gradient breaks its bound most once the set is optimal.
    """
    p = len(g)
    scale = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))  # unit diagonal: the moments are badly conditioned
    h, g, l1 = h * scale[:, None] * scale[None, :], g * scale, l1 * scale
    x = np.zeros(p) if start is None else start / scale
    sign = np.where(l1 > 0, np.sign(x), 0.0)
    free = (l1 == 0) | (sign != 0)
    for _ in range(most):
        a = np.flatnonzero(free)
        target = np.zeros(p)
        target[a] = np.linalg.solve(h[np.ix_(a, a)] + 1e-14 * np.eye(len(a)), -(g + l1 * sign)[a])
        crossing = np.flatnonzero(free & (l1 > 0) & (target * sign < 0))
        if len(crossing):
            ratio = x[crossing] / (x[crossing] - target[crossing])
            k = int(ratio.argmin())
            x = x + max(0.0, float(ratio[k])) * (target - x)
            x[crossing[k]], sign[crossing[k]], free[crossing[k]] = 0.0, 0.0, False
            continue
        x = target
        slope = h @ x + g
        broken = np.where(~free, np.abs(slope) - l1, -np.inf)
        k = int(broken.argmax())
        if broken[k] <= FLAT_EPS * max(1.0, float(np.abs(g).max())):
            break
        free[k], sign[k] = True, -np.sign(slope[k])
    return x * scale


def priors(spec: dict, n_changepoints: int, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Precisions of the Gaussian priors and weights of the Laplace ones, in the order k, m, delta, beta."""
    d = np.concatenate([[1 / C.SLOPE_PRIOR**2, 1 / C.OFFSET_PRIOR**2], np.zeros(n_changepoints), 1 / scales**2])
    l1 = np.concatenate([[0.0, 0.0], np.full(n_changepoints, 1 / spec["tau"]), np.zeros(len(scales))])
    return d, l1


def objective(theta: np.ndarray, sigma: float, ssr: float, n: int, d: np.ndarray, l1: np.ndarray) -> float:
    return float(n * np.log(sigma) + ssr / (2 * sigma**2) + sigma**2 / (2 * C.SIGMA_PRIOR**2) + (d * theta**2).sum() / 2 + (l1 * np.abs(theta)).sum())


def kkt_residual(theta: np.ndarray, sigma: float, gradient: np.ndarray, ssr: float, n: int, d: np.ndarray, l1: np.ndarray) -> float:
    """Largest entry of the smallest subgradient; ``gradient`` is the data's part for theta. Relative to the data's scale of the
    gradient, as the moments are only known to rounding."""
    g = gradient + d * theta
    at_zero = (l1 > 0) & (theta == 0)
    sub = np.where(at_zero, np.sign(g) * np.maximum(np.abs(g) - l1, 0), g + l1 * np.sign(theta))
    own = n / sigma - ssr / sigma**3 + sigma / C.SIGMA_PRIOR**2
    return float(max(np.abs(sub).max(initial=0), abs(own) * sigma / n))


@dataclass
class Fit:
    k: float
    m: float
    delta: np.ndarray
    beta: np.ndarray
    sigma: float
    lp: float
    kkt: float
    iterations: int
    status: str
    #: The objective after each round.
    trace: list[float] = field(default_factory=list)


def _fit(theta: np.ndarray, sigma: float, s: int, value: float, kkt: float, rounds: int, status: str, trace: list[float]) -> Fit:
    return Fit(float(theta[0]), float(theta[1]), theta[2 : 2 + s], theta[2 + s :], sigma, -value, kkt, rounds, status, trace)


def fit_moments(mo: Moments, n_changepoints: int, scales: np.ndarray, tau: float, flat: bool = False, most: int = 200) -> Fit:
    """The convex case at fixed sigma, alternated with sigma's closed form. With flat growth k and delta never enter and are 0."""
    d, l1 = priors({"tau": tau}, n_changepoints, scales)
    p = len(d)
    use = np.r_[1, 2 + n_changepoints : p] if flat else np.arange(p)
    theta, sigma, rounds, trace = np.zeros(p), C.SIGMA_INIT, 0, []
    zz, zy = mo.zz[np.ix_(use, use)], mo.zy[use]
    for rounds in range(1, most + 1):
        new = signed_quadratic(zz / sigma**2 + np.diag(d[use]), -zy / sigma**2, l1[use], theta[use])
        theta[use] = new
        after = best_sigma(mo.ssr(theta), mo.n)
        done = abs(after - sigma) <= 1e-13 * sigma
        sigma = after
        trace.append(objective(theta, sigma, mo.ssr(theta), mo.n, d, l1))
        if done:
            break
    theta[use] = signed_quadratic(zz / sigma**2 + np.diag(d[use]), -zy / sigma**2, l1[use], theta[use])
    ssr = mo.ssr(theta)
    gradient = np.zeros(p)
    gradient[use] = (zz @ theta[use] - zy) / sigma**2
    kkt = kkt_residual(theta, sigma, gradient, ssr, mo.n, d, l1)
    return _fit(theta, sigma, n_changepoints, objective(theta, sigma, ssr, mo.n, d, l1), kkt, rounds, "ok" if kkt < 1e-3 else "not converged", trace)


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def logistic_parts(k: float, m: float, delta: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the curve's offset moves at each changepoint, and the derivatives by (k, m, delta).

    Continuity fixes the level k m + sum(delta s) of the argument behind every changepoint; the offset is the level by the rate there. Where a
    rate is 0 the offset stays.
    """
    n = len(s)
    upto = np.tri(n)
    rate, level = k + np.cumsum(delta), k * m + np.cumsum(delta * s)
    d_rate = np.column_stack([np.ones(n), np.zeros(n), upto])
    d_level = np.column_stack([np.full(n, m), np.full(n, k), upto * s])
    safe = np.where(rate == 0, 1.0, rate)[:, None]
    at = np.append(m, level / safe[:, 0])
    d_at = np.vstack([np.eye(1, 2 + n, 1), d_level / safe - level[:, None] * d_rate / safe**2])
    last = np.maximum.accumulate(np.where(np.append(True, rate != 0), np.arange(n + 1), 0))
    return np.diff(at[last]), np.diff(d_at[last], axis=0)


class Rows:
    """Mean and Jacobian for any growth and mode, over a series' rows."""

    def __init__(self, t, y, x, s, growth: str, multiplicative: np.ndarray, cap=None) -> None:
        self.t, self.y, self.x, self.s, self.growth, self.cap = t, y, x, s, growth, cap
        self.a = (t[:, None] >= s[None, :]).astype(float)
        self.hinge = self.a * (t[:, None] - s[None, :])
        self.xm, self.xa = x * multiplicative, x * (1 - multiplicative)

    def trend(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.s)
        k, m, delta = theta[0], theta[1], theta[2 : 2 + n]
        if self.growth == "flat":
            jac = np.zeros((len(self.t), 2 + n))
            jac[:, 1] = 1
            return np.full(len(self.t), m), jac
        if self.growth == "linear":
            jac = np.column_stack([self.t, np.ones(len(self.t)), self.hinge])
            return jac @ theta[: 2 + n], jac
        # Continuity makes the argument of the curve piecewise linear, as the linear trend is.
        z = sigmoid(k * (self.t - m) + self.hinge @ delta)
        slope = self.cap * z * (1 - z)
        return self.cap * z, slope[:, None] * np.column_stack([self.t - m, np.full(len(self.t), -k), self.hinge])

    def mean(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.s)
        g, jac = self.trend(theta)
        beta = theta[2 + n :]
        lift = 1 + self.xm @ beta
        return g * lift + self.xa @ beta, np.column_stack([jac * lift[:, None], self.xm * g[:, None] + self.xa])

    def gradient(self, theta: np.ndarray, sigma: float) -> tuple[float, np.ndarray]:
        mu, jac = self.mean(theta)
        r = self.y - mu
        return float(r @ r), -(jac.T @ r) / sigma**2


#: Escapes from saddles tried, and how negative a curvature must be beside the largest one.
ESCAPES, SADDLE = 5, 1e-6


def _used(rows: Rows, p: int) -> np.ndarray:
    return np.r_[1, 2 + len(rows.s) : p] if rows.growth == "flat" else np.arange(p)


def fit_rows(rows: Rows, start: np.ndarray, scales: np.ndarray, tau: float, most: int = 400, sigma: float | None = None) -> Fit:
    """Damped proximal Gauss-Newton from ``start`` (and a noise to begin with); every step keeps exact zeros. As Gauss-Newton can't see that a point it
    stops at curves downwards, such a point is left along the curvature, to the lower side, and the descent goes on."""
    d, l1 = priors({"tau": tau}, len(rows.s), scales)
    best = _descend(rows, start, scales, tau, most, sigma)
    trace = list(best.trace)
    for _ in range(ESCAPES):
        theta = np.concatenate([[best.k, best.m], best.delta, best.beta])
        away = downwards(rows, theta, d, l1)
        if away is None:
            break
        tries = [_descend(rows, point, scales, tau, most) for point in _lower(rows, theta, away, d, l1)]
        lower = max(tries, key=lambda f: f.lp, default=best)
        if lower.lp <= best.lp + 1e-9 * (1 + abs(best.lp)):
            break
        trace += lower.trace
        best = lower
    best.trace = trace
    return _settled(rows, best, d, l1)


def _value(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray) -> tuple[float, float]:
    """The objective at the best noise, and that noise."""
    r = rows.y - rows.mean(theta)[0]
    ssr = float(r @ r)
    if not np.isfinite(ssr):
        return np.inf, 1.0
    sigma = best_sigma(ssr, len(r))
    return objective(theta, sigma, ssr, len(r), d, l1), sigma


def _slope(rows: Rows, theta: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Gradient of the objective's smooth part at its best noise."""
    ssr, g = rows.gradient(theta, 1.0)
    g[np.setdiff1d(np.arange(len(theta)), _used(rows, len(theta)))] = 0.0
    return g / best_sigma(ssr, len(rows.y)) ** 2 + d * theta


def _hessian(rows: Rows, theta: np.ndarray, d: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Second derivatives of the objective's smooth part at its best noise, by central differences of the gradient."""
    h = np.zeros((len(free), len(free)))
    for k, at in enumerate(free):
        step = np.zeros(len(theta))
        step[at] = 1e-5 * max(1.0, abs(theta[at]))
        h[k] = (_slope(rows, theta + step, d) - _slope(rows, theta - step, d))[free] / (2 * step[at])
    return (h + h.T) / 2


def _curvature(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Free entries (those not held at 0), eigenvalues and eigenvectors of the objective's second derivatives at its best noise."""
    use = _used(rows, len(theta))
    free = use[(l1[use] == 0) | (theta[use] != 0)]
    h = _hessian(rows, theta, d, free)
    return (free, *np.linalg.eigh(h)) if len(free) and np.isfinite(h).all() else None


def least_curvature(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray) -> float | None:
    """The smallest curvature, by the largest in size."""
    found = _curvature(rows, theta, d, l1)
    return None if found is None else float(found[1][0] / np.abs(found[1]).max())


def downwards(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray) -> np.ndarray | None:
    """The direction of the most negative curvature; None at a minimum."""
    found = _curvature(rows, theta, d, l1)
    if found is None or found[1][0] >= -SADDLE * np.abs(found[1]).max():
        return None
    out = np.zeros(len(theta))
    out[found[0]] = found[2][:, 0]
    return out


def _lower(rows: Rows, theta: np.ndarray, away: np.ndarray, d: np.ndarray, l1: np.ndarray) -> list[np.ndarray]:
    """On either side the lowest of a few points along a direction, if it is lower than ``theta``."""
    here, out = _value(rows, theta, d, l1)[0], []
    for side in (1.0, -1.0):
        points = [theta + side * 4.0**-k * away for k in range(-1, 8)]
        values = [_value(rows, x, d, l1)[0] for x in points]
        if min(values) < here:
            out.append(points[int(np.argmin(values))])
    return out


def _descend(rows: Rows, start: np.ndarray, scales: np.ndarray, tau: float, most: int, sigma: float | None = None) -> Fit:
    n, s = len(rows.y), len(rows.s)
    d, l1 = priors({"tau": tau}, s, scales)
    use = _used(rows, len(d))
    theta = np.zeros(len(d))
    theta[use] = start[use]
    mu, jac = rows.mean(theta)
    r = rows.y - mu
    sigma = best_sigma(float(r @ r), n) if sigma is None else sigma
    value, damping, rounds, still, trace = objective(theta, sigma, float(r @ r), n, d, l1), 1e-3, 0, 0, []
    for rounds in range(1, most + 1):
        h = jac.T @ jac / sigma**2
        g = -(jac.T @ r) / sigma**2
        for _ in range(40):
            diagonal = damping * np.maximum(np.diag(h), 1e-8)
            full = h + np.diag(d + diagonal)
            # the subproblem in the new point itself, so that its zeros are the model's
            new = theta.copy()
            new[use] = signed_quadratic(full[np.ix_(use, use)], (g - h @ theta - diagonal * theta)[use], l1[use], theta[use])
            mu2, jac2 = rows.mean(new)
            r2 = rows.y - mu2
            ssr = float(r2 @ r2)
            sigma2 = best_sigma(ssr, n) if np.isfinite(ssr) else sigma
            value2 = objective(new, sigma2, ssr, n, d, l1) if np.isfinite(ssr) else np.inf
            if value2 <= value:
                break
            damping *= 4
        else:
            break
        gain = value - value2
        theta, sigma, value, r, jac = new, sigma2, value2, r2, jac2
        trace.append(value)
        damping = max(damping / 6, 1e-12)
        still = still + 1 if gain <= 1e-13 * (1 + abs(value)) else 0
        if still >= 3:
            break
    return _judged(rows, theta, d, l1, rounds, trace)


def _residual(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray) -> tuple[float, float, float]:
    """Optimality residual and objective at the best noise, and that noise."""
    value, sigma = _value(rows, theta, d, l1)
    ssr, g = rows.gradient(theta, sigma)
    g[np.setdiff1d(np.arange(len(d)), _used(rows, len(d)))] = 0.0
    return kkt_residual(theta, sigma, g, ssr, len(rows.y), d, l1), value, sigma


def _judged(rows: Rows, theta: np.ndarray, d: np.ndarray, l1: np.ndarray, rounds: int, trace: list[float]) -> Fit:
    kkt, value, sigma = _residual(rows, theta, d, l1)
    scale = float(np.abs(rows.mean(theta)[1].T @ rows.y).max()) / sigma**2 / len(rows.y)
    return _fit(theta, sigma, len(rows.s), value, kkt, rounds, "ok" if kkt < 1e-3 * max(1.0, scale) else "not converged", trace)


#: The residual that a fit is settled at, and the Newton steps tried for it.
SETTLED, SETTLING = 1e-7, 20


def _settled(rows: Rows, fit: Fit, d: np.ndarray, l1: np.ndarray) -> Fit:
    """Newton steps with the objective's own second derivatives, each kept if it lowers the residual and doesn't raise the objective. The descent
    goes by the objective, whose rounding hides a step's gain while the gradient is still far from 0: the more so the more rows there are and the
    smaller the noise is."""
    theta = np.concatenate([[fit.k, fit.m], fit.delta, fit.beta])
    kkt, value, _ = _residual(rows, theta, d, l1)
    use, rounds = _used(rows, len(d)), 0
    while rounds < SETTLING and kkt > SETTLED:
        slope = _slope(rows, theta, d)
        free = use[(l1[use] == 0) | (theta[use] != 0) | (np.abs(slope[use]) > l1[use])]
        h = _hessian(rows, theta, d, free)
        if not np.isfinite(h).all() or np.linalg.eigvalsh(h)[0] <= 0:
            break
        goal = signed_quadratic(h, slope[free] - h @ theta[free], l1[free], theta[free])
        for k in range(8):
            new = theta.copy()
            new[free] = goal if k == 0 else theta[free] + 0.5**k * (goal - theta[free])
            found = _residual(rows, new, d, l1)
            if found[0] < kkt and found[1] <= value + 1e-12 * (1 + abs(value)):
                break
        else:
            break
        theta, kkt, value, rounds = new, found[0], found[1], rounds + 1
    return _judged(rows, theta, d, l1, fit.iterations + rounds, fit.trace) if rounds else fit


def smooth_hessian(jac: np.ndarray, sigma: float, d: np.ndarray) -> np.ndarray:
    return jac.T @ jac / sigma**2 + np.diag(d)


def curvature_spectrum(h: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(h)


def quadratic_distance(h: np.ndarray, reference: np.ndarray, point: np.ndarray) -> float:
    """Half the squared distance of two parameter vectors in the posterior's own metric."""
    step = point - reference
    return float(step @ h @ step / 2)


def quadratic_change(h: np.ndarray, reference: np.ndarray, point: np.ndarray, gradient: np.ndarray | None = None, l1: np.ndarray | None = None) -> float:
    """How much larger the objective is at ``point`` than at ``reference``, to second order: the smooth part's gradient and curvature at the reference,
    and the change of the absolute values, which is exact."""
    out = quadratic_distance(h, reference, point)
    if gradient is not None:
        out += float(gradient @ (point - reference))
    if l1 is not None:
        out += float(l1 @ (np.abs(point) - np.abs(reference)))
    return out
