"""Accounting of jobs that see a Poisson sample of users: each user is in it with probability ``share``, on their own.

Neighbours differ by one user more or less. Nobody may learn who was in the sample. Sizes here are
those of a grid of losses, not of data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from noisemill.functions.budget import _root

#: What each convolution may move from the upper tail to the infinite loss; deltas below 1e-10 are mostly this.
_TAIL = 1e-12
#: Deviations of the noise beyond which losses count as infinite, or as the least.
_FAR = 9.0


def _check(share: float) -> None:
    if not 0 < share <= 1:
        raise ValueError(f"a share must lie in (0, 1]: {share}")


def amplified(epsilon: float, delta: float, share: float) -> tuple[float, float]:
    """What a job costs all users, if it costs those of a sample (epsilon, delta) (Balle, Barthe, Gaboardi 2018)."""
    _check(share)
    return (epsilon + math.log(share) if epsilon > 700 else math.log1p(share * math.expm1(epsilon))), share * delta


def on_sample(epsilon: float, delta: float, share: float) -> tuple[float, float]:
    """The reverse: what a job on a sample may cost its users, so that all users have (epsilon, delta)."""
    _check(share)
    return (epsilon - math.log(share) if epsilon > 700 else math.log1p(math.expm1(epsilon) / share)), min(1.0, delta / share)


def sampled_rdp(share: float, sigma: float, order: int) -> float:
    """Renyi divergence, of a whole order, of one Gaussian release on a sample (Mironov, Talwar, Zhang 2019)."""
    _check(share)
    if share == 1:
        return order / (2 * sigma * sigma)
    terms = [
        math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + (order - k) * math.log1p(-share) + k * math.log(share) + (k * k - k) / (2 * sigma * sigma)
        for k in range(order + 1)
    ]
    top = max(terms)
    return (top + math.log(math.fsum(math.exp(t - top) for t in terms))) / (order - 1)


def sampled_epsilon_rdp(share: float, sigma: float, rounds: int, delta: float) -> float:
    """An upper bound of epsilon after ``rounds`` releases, each on a new sample, for any delta: by whole orders up to 256."""
    orders = range(2, 257)
    found = (rounds * sampled_rdp(share, sigma, a) + math.log1p(-1 / a) - math.log(delta * a) / (a - 1) for a in orders)
    return max(0.0, min(found))


@dataclass(frozen=True)
class Losses:
    """A privacy loss's distribution: ``mass[k]`` at (first + k) * step, and what is infinite."""

    first: int
    mass: np.ndarray
    infinite: float
    step: float

    def delta(self, epsilon: float) -> float:
        loss = (self.first + np.arange(len(self.mass))) * self.step
        return float(self.infinite + (self.mass * -np.expm1(np.minimum(epsilon - loss, 0.0))).sum())

    def then(self, other: Losses) -> Losses:
        """Of both releases together: a convolution, whose far tails are rounded up."""
        n = len(self.mass) + len(other.mass) - 1
        size = 1 << (n - 1).bit_length()
        mass = np.fft.irfft(np.fft.rfft(self.mass, size) * np.fft.rfft(other.mass, size), size)[:n].clip(0.0)
        low = int(np.searchsorted(np.cumsum(mass), _TAIL))
        above = np.cumsum(mass[::-1])
        high = n - int(np.searchsorted(above, _TAIL))
        low = min(low, high - 1)
        kept = mass[low:high].copy()
        kept[0] += mass[:low].sum()
        return Losses(self.first + other.first + low, kept, self.infinite + other.infinite + float(mass[high:].sum()), self.step)

    def times(self, rounds: int) -> Losses:
        if rounds < 1:
            raise ValueError("rounds must be at least 1")
        out, power = None, self
        while rounds:
            if rounds & 1:
                out = power if out is None else out.then(power)
            rounds >>= 1
            if rounds:
                power = power.then(power)
        return out


def _between(places: np.ndarray, mean: float, sigma: float) -> np.ndarray:
    """A normal number's chance to lie between each two neighbours, from whichever tail is the smaller."""
    z = (places - mean) / (sigma * math.sqrt(2))
    low, high = (np.array([math.erfc(v) / 2 for v in sign * z]) for sign in (-1, 1))
    return np.where(z[:-1] > 0, high[:-1] - high[1:], low[1:] - low[:-1])


def _on_grid(of: np.ndarray, under: np.ndarray, grid: np.ndarray, step: float) -> np.ndarray:
    """Masses at the grid's points: each cell's is dealt to both its ends so that either neighbour's chance of
    the cell stays. Delta is then right at the points and too large between them (Doroshenko et al. 2022)."""
    upper = ((of - under * np.exp(grid[:-1])) / -math.expm1(-step)).clip(0.0, of)
    out = np.zeros(len(grid))
    out[1:] += upper
    out[:-1] += of - upper
    return out


def sampled_losses(share: float, sigma: float, step: float = 2e-4) -> tuple[Losses, Losses]:
    """The losses of one Gaussian release of sensitivity 1 on a sample, when a user goes and when one comes."""
    _check(share)
    ends = [float(np.logaddexp(math.log1p(-share) if share < 1 else -math.inf, math.log(share) + (2 * x - 1) / (2 * sigma * sigma))) for x in (-_FAR * sigma, 1 + _FAR * sigma)]
    first, last = math.floor(ends[0] / step), math.ceil(ends[1] / step)
    grid = np.arange(first, last + 1) * step
    # the noisy value that has a loss; below log(1 - share) none has
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = (np.expm1(grid) + share) / share
        place = np.where(odds > 0, sigma * sigma * np.log(odds) + 0.5, -math.inf)
    without, with_user = _between(place, 0.0, sigma), _between(place, 1.0, sigma)
    mixed = (1 - share) * without + share * with_user
    tail = lambda x, mean: math.erfc((x - mean) / (sigma * math.sqrt(2))) / 2
    above = [tail(place[-1], 0.0), tail(place[-1], 1.0)]
    below = [tail(-place[0], 0.0), tail(-place[0], -1.0)]
    gone = _on_grid(mixed, without, grid, step)
    gone[0] += (1 - share) * below[0] + share * below[1]
    come = _on_grid(without[::-1], mixed[::-1], -grid[::-1], step)
    come[0] += above[0]
    return Losses(first, gone, (1 - share) * above[0] + share * above[1], step), Losses(-last, come, below[0], step)


def sampled_delta(share: float, sigma: float, rounds: int, epsilon: float, step: float = 2e-4) -> float:
    """Delta at epsilon after ``rounds`` Gaussian releases, each on a new sample; tight, and never too small but for rounding."""
    return max(x.times(rounds).delta(epsilon) for x in sampled_losses(share, sigma, step))


def sampled_epsilon(share: float, sigma: float, rounds: int, delta: float, step: float = 2e-4) -> float:
    """The least epsilon at delta: by loss distributions or by Renyi divergence, whichever is less."""
    renyi = sampled_epsilon_rdp(share, sigma, rounds, delta)
    both = [x.times(rounds) for x in sampled_losses(share, sigma, step)]
    worst = lambda e: max(x.delta(e) for x in both)
    if worst(0.0) <= delta:
        return 0.0
    return renyi if worst(renyi) > delta else _root(worst, delta, 0.0, renyi)


def sampled_sigma(epsilon: float, delta: float, share: float, rounds: int, step: float = 1e-3) -> float:
    """The least noise, within 0.1 %, of ``rounds`` Gaussian releases on new samples that have (epsilon, delta)."""
    enough = lambda s: sampled_epsilon(share, s, rounds, delta, step) <= epsilon
    low = high = 1.0
    while not enough(high):
        low, high = high, 2 * high
    while low == high or enough(low):
        low, high = low / 2, low
        if low < 0.05:
            break
    while high / low > 1.001:
        middle = math.sqrt(low * high)
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high
