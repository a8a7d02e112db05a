"""Student's t, tests from moments, agreement and the bootstrap. Scalars here run on aggregated rows only."""

from __future__ import annotations

import math

_MASK = (1 << 64) - 1


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * t_two_sided(t, df)
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """By bisection."""
    if p == 0.5:
        return 0.0
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def welch(mean_a, var_a, n_a, mean_b, var_b, n_b, alpha=0.05):
    """(t, df, p, low, high) of b - a, or None: fewer than two values, or a difference without any spread."""
    if min(n_a or 0, n_b or 0) < 2:
        return None
    a, b = max(var_a, 0.0) / n_a, max(var_b, 0.0) / n_b
    se, delta = math.sqrt(a + b), mean_b - mean_a
    if se == 0.0:
        return (0.0, n_a + n_b - 2.0, 1.0, 0.0, 0.0) if delta == 0.0 else None
    df = (a + b) ** 2 / (a * a / (n_a - 1) + b * b / (n_b - 1))
    half = t_quantile(1 - alpha / 2, df) * se
    return delta / se, df, t_two_sided(delta / se, df), delta - half, delta + half


def _flat(mean, low, high, largest) -> bool:
    """Whether all differences agree up to rounding."""
    return max(high - mean, mean - low) <= 1e-9 * largest


def paired(n, mean, var, low, high, largest, alpha=0.05):
    """(t, df, p, low, high) from the differences' count, mean, variance, extremes and largest size; None if untestable."""
    if (n or 0) < 2:
        return None
    if _flat(mean, low, high, largest):
        return (0.0, n - 1.0, 1.0, 0.0, 0.0) if abs(mean) <= 1e-9 * largest else None
    se = math.sqrt(var / n)
    half = t_quantile(1 - alpha / 2, n - 1.0) * se
    return mean / se, n - 1.0, t_two_sided(mean / se, n - 1.0), mean - half, mean + half


def non_inferiority(n, mean, var, low, high, largest, margin, alpha=0.05):
    """(lower, upper, p, verdict) for "b is no worse than a by more than margin", or None."""
    if (n or 0) < 2 or not math.isfinite(margin) or margin <= 0:
        return None
    if _flat(mean, low, high, largest):
        if abs(mean) > 1e-9 * largest:
            return None
        lower, upper, p = 0.0, 0.0, 0.0
    else:
        se = math.sqrt(var / n)
        half = t_quantile(1 - alpha, n - 1.0) * se
        lower, upper, p = mean - half, mean + half, 1.0 - t_cdf((mean + margin) / se, n - 1.0)
    return lower, upper, p, "non-inferior" if lower > -margin else "inferior" if upper < -margin else "inconclusive"


def kappa(both: int, only_a: int, only_b: int, neither: int) -> float | None:
    """Cohen's kappa of two raters' pass or fail."""
    n = both + only_a + only_b + neither
    if not n:
        return None
    a, b = (both + only_a) / n, (both + only_b) / n
    chance = a * b + (1 - a) * (1 - b)
    return None if abs(1 - chance) < 1e-12 else ((both + neither) / n - chance) / (1 - chance)


def kappa_words(k: float) -> str:
    words = [(0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")]
    return "worse than chance" if k < 0 else next((w for top, w in words if k <= top), "almost perfect")


def split_mix(seed: int):
    """SplitMix64: 64-bit values from a seed."""
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def resample_indices(seed: int, resample: int, n: int):
    """n places in 0..n-1 of one resample, as if all resamples were drawn one after the other."""
    start = (seed + resample * n * 0x9E3779B97F4A7C15) & _MASK
    source = split_mix(start)
    return [next(source) * n >> 64 for _ in range(n)]
