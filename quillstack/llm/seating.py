"""Seating in Chinese restaurants: how many tables serve a word, given its customers and the rest of the restaurant.

With discount d, the seatings of c customers of one word at t tables number S(c, t), a generalised Stirling
number: S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t). All c customers of a word leave and sit down again
together: t is drawn from its distribution given all other tables,

    S(c, t) * (strength + d T)(strength + d (T + 1)) ... (strength + d (T + t - 1)) * p^t,

where T are the restaurant's tables of other words and p is the parent's probability of the word. That is a
Gibbs step over the whole seating of the word. Up to EXACT customers it is drawn from the numbers themselves.
Beyond, the numbers are too many, so t makes Metropolis moves under the same distribution, with S from its
alternating sum where few tables serve many customers and from the saddle point of its generating function
elsewhere.
"""

from __future__ import annotations

import numpy as np

EXACT, MOVES = 256, 12
#: Tables over customers to the discount below which the alternating sum is taken.
FEW = 2.0
#: Cells of a weight matrix.
CELLS = 1 << 21


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x, by shifting up and Stirling's series."""
    x = np.asarray(x, float)
    shift = np.where(x < 8, 8.0, 0.0)
    steps = np.zeros_like(x)
    for i in range(8):
        steps += np.where(shift > 0, np.log(x + i), 0.0)
    y = x + shift
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def stirling_logs(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of S(c, t) at [c, t] for c and t up to `most`."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + out[c, 1:]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def stirling_large(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of S(c, t) for many customers."""
    c, t, d = np.asarray(c, float), np.asarray(t, float), discount
    out = np.zeros(len(c))
    few = t * c**-d < FEW
    if few.any():
        cf, tf = c[few], t[few]
        total, rest, top = np.zeros(len(cf)), np.ones(len(cf)), int(min(60, tf.max()))
        # Terms binom(t, k) (-1)^k Gamma(c - k d) / Gamma(-k d), over Gamma(c - d) d, the first one's size without t.
        first = log_gamma(cf - d)
        for k in range(1, top + 1):
            rest = rest * (tf - k + 1) / k
            x = k * d
            # 1 / Gamma(-x) = -sin(pi x) Gamma(1 + x) / pi
            inverse = -np.sin(np.pi * x) * np.exp(float(log_gamma(np.array([1 + x]))[0])) / np.pi
            total += np.where(rest > 0, (-1) ** k * rest * inverse * np.exp(log_gamma(np.maximum(cf - x, 0.5)) - first), 0.0)
        out[few] = first + np.log(np.maximum(total, 1e-300)) - tf * np.log(d) - log_gamma(tf + 1)
    many = ~few
    if many.any():
        cm, tm = c[many], t[many]
        # Saddle point of (1 - (1 - x)^d)^t / x^c in y = log(x / (1 - x)): the slope of the logarithm rises with y.
        low, high = np.full(len(cm), -40.0), np.full(len(cm), 40.0)
        slope = lambda x: tm * d * x * (1 - x) ** (d - 1) / (1 - (1 - x) ** d)
        for _ in range(60):
            y = (low + high) / 2
            above = slope(1 / (1 + np.exp(-y))) > cm
            low, high = np.where(above, low, y), np.where(above, y, high)
        y = (low + high) / 2
        x, gap = 1 / (1 + np.exp(-y)), 1 / (1 + np.exp(y))
        base = 1 - gap**d
        first = d * x * gap ** (d - 1) / base
        curve = tm * (first + x * (d * (1 - d) * x * gap ** (d - 2) / base - d * gap ** (d - 1) * d * x * gap ** (d - 1) / base**2))
        point = log_gamma(cm + 1) - log_gamma(tm + 1) - tm * np.log(d) + tm * np.log(base) - cm * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-300))
        pairs = np.log((1 - d) * cm * np.maximum(cm - 1, 1) / 2)  # one table of two, the others of one
        out[many] = np.where(tm >= cm, 0.0, np.where(tm == cm - 1, pairs, point))
    return out


class Seater:
    """Draws tables for words of a restaurant with this strength and discount."""

    def __init__(self, strength: float, discount: float):
        self.strength, self.discount = strength, discount
        self.logs = stirling_logs(discount)

    def _small(self, c: int, others: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """For words of c customers each."""
        t = np.arange(c)
        rising = np.cumsum(np.log(self.strength + self.discount * (others[:, None] + t)), axis=1)
        weight = self.logs[c, 1 : c + 1] + rising + np.log(share)[:, None] * (t + 1)
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        at = rng.random(len(others)) * weight[:, -1]
        return np.minimum((weight < at[:, None]).sum(axis=1), c - 1) + 1

    def weight(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The logarithm of the distribution of t up to a constant, for many customers."""
        a = self.strength / self.discount + others
        return stirling_large(c, t, self.discount) + t * np.log(self.discount) + log_gamma(a + t) - log_gamma(a) + t * np.log(share)

    def draw(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """New tables of words with c customers and t tables now; others: tables of other words; share: the parent's probability."""
        out = np.ones(len(c), np.int64)
        order = np.argsort(c, kind="stable")
        bounds = np.flatnonzero(np.diff(c[order])) + 1
        for part in np.split(order, bounds) if len(order) else ():
            n = int(c[part[0]])
            if 1 < n <= EXACT:
                for at in range(0, len(part), max(1, CELLS // n)):
                    rows = part[at : at + max(1, CELLS // n)]
                    out[rows] = self._small(n, others[rows], share[rows], rng)
        large = np.flatnonzero(c > EXACT)
        if len(large):
            out[large] = self._large(*(np.asarray(x)[large] for x in (c, t, others, share)), rng)
        return out

    def _large(self, c: np.ndarray, t: np.ndarray, others: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Metropolis moves of t, long and short in turn."""
        t = t.astype(np.int64)
        now = self.weight(c, t, others, share)
        for i in range(MOVES):
            width = np.maximum(1.0, np.sqrt(t) * (3.0, 1.0, 0.3)[i % 3])
            # The width is rounded to a power of two, and a move counts only if it would come back with the same width.
            width = 2.0 ** np.round(np.log2(width))
            move = t + np.where(rng.random(len(t)) < 0.5, -1, 1) * rng.integers(1, width.astype(np.int64) + 1)
            back = 2.0 ** np.round(np.log2(np.maximum(1.0, np.sqrt(np.maximum(move, 1)) * (3.0, 1.0, 0.3)[i % 3])))
            valid = (move >= 1) & (move <= c) & (back == width)
            tried = self.weight(c, np.where(valid, move, t), others, share)
            taken = valid & (np.log(rng.random(len(t))) < tried - now)
            t, now = np.where(taken, move, t), np.where(taken, tried, now)
        return t
