"""The law of a sum of whole numbers with random signs, from its characteristic function."""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, pi

import numpy as np

#: Frequencies whose product of cosines is below LOST are left out: together they count for less than 30 times as much.
LOST = 1e-15
#: Frequencies of a leaf; a node has FAN children; nodes that are looked at together, and cosines at least.
LEAF, FAN, NODES, COSINES = 32, 8, 1024, 1 << 17
#: Of a node so many values are tried at most before it is opened, in angles of WIDE radians to either side at most.
TRIED, WIDE = 1024, 0.4


def _times(a: np.ndarray | int, k: np.ndarray, modulus: int) -> np.ndarray:
    """a * k modulo modulus, for k below modulus and a modulus below 2**46 (a * k may not fit an integer)."""
    a = a % modulus
    if modulus < 1 << 31:
        return a * k % modulus
    out = a * (k >> 32) % modulus
    for shift in (16, 0):
        out = (out * (1 << 16) % modulus + a * (k >> shift & 0xFFFF) % modulus) % modulus
    return out


def _nodes(a: np.ndarray, counts: np.ndarray, period: int, last: int) -> Iterator[np.ndarray]:
    """First frequencies of the leaves in which the product of cosines may reach LOST.

    A node is a run of frequencies. With x the angle from the nearest peak of a value's cosine to the run, the cosine is
    exp(-x * x / 2) at most in all of the run.
    """
    top = LEAF
    while last // top > NODES:
        top *= FAN
    weight = counts.astype(float)
    stack = [(top, np.arange(0, last + 1, top, dtype=np.int64)[k : k + NODES]) for k in range(0, last // top + 1, NODES)]
    while stack:
        size, firsts = stack.pop()
        spread = pi * a * ((size - 1) / 2 / period)
        use = np.flatnonzero(spread <= WIDE)[-TRIED:]
        if weight[use].sum() > 100:
            sums = np.zeros(len(firsts))
            middle = firsts + (size - 1) / 2
            for tried, i in enumerate(use[::-1], 1):
                turn = middle * (a[i] / period)
                x = np.abs(turn - np.rint(turn))
                x *= pi
                x -= spread[i] + 1e-6
                np.maximum(x, 0, out=x)
                x *= x
                x *= weight[i] / 2
                sums += x
                if tried % 16 == 0 or tried == len(use):
                    kept = sums <= -np.log(LOST)
                    firsts, middle, sums = firsts[kept], middle[kept], sums[kept]
                    if not len(firsts):
                        break
        if size == LEAF:
            if len(firsts):
                yield firsts
            continue
        step = size // FAN
        below = (firsts[:, None] + np.arange(0, size, step)).ravel()
        below = below[below <= last]
        stack += [(step, below[k : k + NODES]) for k in range(0, len(below), NODES)]


def _products(a: np.ndarray, counts: np.ndarray, period: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, frequency): products of the values' cosines, and the first frequencies of the leaves that may reach LOST."""
    out = np.ones((len(firsts), LEAF))
    for bit in range(int(counts.max()).bit_length() - 1, -1, -1):
        out *= out
        some, lost = a[(counts >> bit) & 1 == 1], LOST ** (1 / (1 << bit))
        k = 0
        while k < len(some) and len(firsts):
            many = min(len(some) - k, max(1, COSINES // (len(firsts) * LEAF)))
            x, k = some[k : k + many], k + many
            begin = _times(x[:, None], firsts[None, :], 2 * period) * (pi / period)
            inner = x[:, None] * (np.arange(LEAF) * (pi / period))
            c, s, ci, si = np.cos(begin), np.sin(begin), np.cos(inner), np.sin(inner)
            one, two = np.empty_like(out), np.empty_like(out)
            for j in range(many):
                np.multiply(c[j][:, None], ci[j], out=one)
                np.multiply(s[j][:, None], si[j], out=two)
                one -= two
                out *= one
            kept = np.maximum(out.max(axis=1), -out.min(axis=1)) >= lost
            if not kept.all():
                out, firsts = out[kept], firsts[kept]
    return out, firsts


def share_within(a: np.ndarray, counts: np.ndarray, bound: float, reach: float) -> float:
    """P(|S| < bound) for S the sum of counts[i] times a[i] with random signs, |S| at most reach but for a lost share.

    a are different positive whole numbers. A whole bound has the parity of S; of another one the law is taken between
    the steps of S. The law of S modulo twice the period is a finite sum over frequencies of the
    product of cosines, so nothing but LOST, the share beyond reach and rounding (about 1e-12) is missing. Memory does
    not grow with the frequencies, which are read in chunks, and most of which few values exclude together.
    """
    period = int((bound + reach) // 2) + 2
    period += 1 - period % 2
    last, steps = (period - 1) // 2, bound - 1
    whole = float(steps).is_integer()
    order = np.argsort(a, kind="stable")
    a, counts = a[order], counts[order]
    parts = [steps / 2]
    for firsts in _nodes(a, counts, period, last):
        product, firsts = _products(a[::-1], counts[::-1], period, firsts)
        k = firsts[:, None] + np.arange(LEAF)
        u = k * (pi / period)
        turned = np.sin(_times(int(steps), k, 2 * period) * (pi / period)) if whole else np.sin(steps * u)
        inside = (k > 0) & (k <= last)
        parts.append(float((product * turned / np.where(inside, np.sin(u), 1.0))[inside].sum()))
    return 2 * fsum(parts) / period
