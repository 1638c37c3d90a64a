"""Iterations of a map to its fixed point, plain or accelerated by squared extrapolation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Step = Callable[[np.ndarray], tuple[np.ndarray, float]]


def plain(step: Step, x: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, float, int, bool]:
    """(point, its merit, calls, converged): step(x) gives the next point and the merit of x; ends when the
    merit changes by less than tol.  A next point that is no finite number is not taken."""
    before, calls = -np.inf, 0
    while True:
        new, merit = step(x)
        done = abs(merit - before) < tol
        if done or calls == most or not np.isfinite(new).all():
            return x, merit, calls, bool(done)
        before, x, calls = merit, new, calls + 1


def squared(step: Step, x: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, float, int, bool]:
    """As ``plain``, with extrapolation after each two steps.

    The length of an extrapolation is the ratio of the first step to the change of the second, from 1
    to a bound that grows by 4 when it binds; it is taken only if the merit does not fall, else the two
    plain steps count, and the bound shrinks by 4 if it was this length.  It ends by the merit alone; the point it
    returns is the one whose merit is known, one step before the newest."""
    bound, calls = 1.0, 0
    while True:
        one, m0 = step(x)
        if calls >= most or not np.isfinite(one).all():
            return x, m0, calls, False
        two, m1 = step(one)
        calls += 2
        if abs(m1 - m0) < tol:
            return one, m1, calls, True
        if not np.isfinite(two).all():
            return one, m1, calls, False
        r, v = one - x, two - 2 * one + x
        size = np.linalg.norm(v)
        length = min(max(np.linalg.norm(r) / size if size > 0 else 1.0, 1.0), bound)
        bound_by = length == bound
        if bound_by:
            bound *= 4
        x = two
        if abs(length - 1) > 0.01:
            with np.errstate(all="ignore"):
                try:
                    far, merit = step(one - r + 2 * length * r + length**2 * v)
                except np.linalg.LinAlgError:
                    far, merit = x, -np.inf
            calls += 1
            if np.isfinite(far).all() and merit >= m0 - 1e-6:
                x = far
            elif bound_by:
                bound = max(1.0, bound / 16)  # it has just grown
