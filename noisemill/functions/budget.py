"""Zero-concentrated differential privacy: conversions, calibration and how budgets are split.

Sizes here are those of a schema, not of data.
"""

from __future__ import annotations

import math
from statistics import NormalDist


def _lowest(f) -> float:
    """The least value of a function of t = log(alpha - 1): the best of a grid of orders, and then between its neighbours."""
    step = 0.25
    t = min((k * step for k in range(-120, 241)), key=f)
    for _ in range(60):
        step /= 1.5
        t = min((t - step, t, t + step), key=f)
    return f(t)


def _order(t: float) -> tuple[float, float]:
    """alpha - 1, and the bound's term alpha * log(1 - 1 / alpha) - log(alpha - 1), for t = log(alpha - 1)."""
    above = math.exp(t)
    return above, (1 + above) * (t - math.log1p(above)) - t if t < 30 else -1.0 - t


def zcdp_delta(rho: float, epsilon: float) -> float:
    """The least delta of rho-zCDP at epsilon: the bound of Canonne, Kamath and Steinke (2020) at its best order."""
    if rho == 0:
        return 0.0

    def log_delta(t: float) -> float:
        above, term = _order(t)
        return above * ((1 + above) * rho - epsilon) + term

    return math.exp(min(_lowest(log_delta), 0.0))


def zcdp_epsilon(rho: float, delta: float) -> float:
    """The least epsilon of rho-zCDP at delta: the same bound, solved for epsilon at each order."""
    if rho == 0 or delta >= 1:
        return 0.0

    def epsilon(t: float) -> float:
        above, term = _order(t)
        return (1 + above) * rho + (term - math.log(delta)) / above

    return max(0.0, _lowest(epsilon))


def zcdp_rho(epsilon: float, delta: float) -> float:
    """The greatest rho that implies (epsilon, delta): the same bound, solved for rho at each order."""
    if epsilon == 0:
        return 0.0

    def spent(t: float) -> float:
        above, term = _order(t)
        return -(epsilon - (term - math.log(delta)) / above) / (1 + above)

    return max(0.0, -_lowest(spent))


def _root(decreasing, target: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if decreasing(middle) > target else (low, middle)
    return 0.5 * (low + high)


def gaussian_delta(mu: float, epsilon: float) -> float:
    """The exact delta of the Gaussian mechanism with mu = sensitivity / sigma (Balle, Wang 2018)."""
    if mu == 0:
        return 0.0
    cdf = NormalDist().cdf
    return max(0.0, cdf(mu / 2 - epsilon / mu) - math.exp(min(epsilon, 700.0)) * cdf(-mu / 2 - epsilon / mu))


def gaussian_mu(epsilon: float, delta: float) -> float:
    """The greatest mu that implies (epsilon, delta), for jobs of Gaussian releases only."""
    return _root(lambda m: -gaussian_delta(m, epsilon), -delta, 0.0, 50.0 + epsilon)


def rho_of_sigma(sigma: float) -> float:
    return 1 / (2 * sigma * sigma)


def sigma_of_rho(rho: float) -> float:
    return math.sqrt(1 / (2 * rho)) if rho else math.inf


def rho_of_selection(epsilon: float) -> float:
    """What an exponential mechanism costs."""
    return epsilon * epsilon / 8


def selection_epsilon(rho: float) -> float:
    return math.sqrt(8 * rho)


def laplace_epsilon(std: float) -> float:
    """Epsilon of an exponential mechanism where the accountant names the deviation of Laplace noise that costs as
    much: that noise has scale 1 / epsilon, and sqrt(2) times its scale as deviation."""
    if std <= 0:
        raise ValueError(f"a deviation must be positive: {std}")
    return math.sqrt(2) / std


def split(rho: float, columns: int, first: float = 0.1) -> dict[str, float]:
    """The share of each column's first look and of the total, and what the joint tables get."""
    each = first * rho / (columns + 1)
    return {"each": each, "joint": (1 - first) * rho}


def selection_threshold(sigma: float, delta: float, per_user: int = 1, min_count: int = 1) -> float:
    """The noisy count from which a value may be shown, so that of all values that fewer than ``min_count``
    users and one more have, none passes with probability 1 - delta at least.

    A user of ``per_user`` rows may bring k values that nobody else has, with per_user - k + 1 rows
    of one: each of the k must stay below, whatever k is. ``sigma`` is the noise of one row.
    """
    tail = lambda k: NormalDist().inv_cdf((1 - delta) ** (1 / k))
    return max(per_user - k + 1 + per_user * sigma * tail(k) for k in range(1, per_user + 1)) + min_count - 1


def sips_threshold(sigma: float, delta: float, per_user: int) -> float:
    """The same for weighted counts, where a user of k values gives each 1 / sqrt(k)."""
    return max(1 / math.sqrt(k) + sigma * NormalDist().inv_cdf((1 - delta) ** (1 / k)) for k in range(1, per_user + 1))


def sips_rounds(rho: float, rounds: int, ratio: float = 0.3) -> list[float]:
    """Each round's share: the last has most."""
    weights = [ratio ** (rounds - 1 - k) for k in range(rounds)]
    return [rho * w / sum(weights) for w in weights]


def quantile_levels(rho: float, levels: int, ratio: float = 1.0) -> list[float]:
    """Epsilon of each level of halving; the medians of one level share it."""
    weights = [ratio ** (2 * (levels - 1 - k)) for k in range(levels)]
    return [selection_epsilon(rho * w / sum(weights)) for w in weights]


def allocate(candidates: dict[str, tuple[float, float, float]], budget: float) -> dict[str, float]:
    """Which marginals to measure and with what share of the budget.

    ``candidates``: name to (error, size, weight). A chosen one's gain is its weighted error, its
    cost the noise; for a fixed choice shares go as y = (weight * size * sqrt(2 / pi)) ** (2 / 3), and
    the choice that maximises sum(gain) - sum(y) ** 1.5 / sqrt(budget) is a prefix by gain / y.
    If no choice gains, the first takes all.
    """
    if not candidates or budget <= 0:
        return {}
    rows = sorted(((w * e, (w * n * math.sqrt(2 / math.pi)) ** (2 / 3), name) for name, (e, n, w) in candidates.items()), key=lambda r: (-r[0] / r[1] if r[1] else -math.inf, r[2]))
    best, gain, cost, score = 1, 0.0, 0.0, -math.inf
    for k, (g, y, _) in enumerate(rows, 1):
        gain, cost = gain + g, cost + y
        if (now := gain - cost**1.5 / math.sqrt(budget)) > score:
            best, score = k, now
    total = sum(y for _, y, _ in rows[:best])
    return {name: budget * y / total if total else budget / best for _, y, name in rows[:best]}
