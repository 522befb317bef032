"""L-BFGS on the driver for a loss that Spark sums up: the steps MLlib's optimizer takes, with its constants.

The vectors here are as long as a model's weights, never as long as the data.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(ArithmeticError):
    """No step along the direction meets the conditions."""


def _cubic(left, right) -> float:
    """Minimum of the cubic through two (t, value, slope), kept off both ends."""
    (lt, lf, ld), (rt, rf, rd) = left, right
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ld * rd)
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _strong_wolfe(along, start: tuple, t: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 10) -> float:
    """Step length with sufficient decrease and a small enough slope; ``along(t)`` gives (t, value, slope)."""
    _, f0, d0 = start
    if d0 > 0:
        raise SearchFailed("no direction of descent")

    def zoom(low, high):
        for _ in range(tries):
            c = along(_cubic(*((high, low) if low[0] > high[0] else (low, high))))
            if c[1] > f0 + c1 * c[0] * d0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(d0):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")

    low = start
    for i in range(tries):
        c = along(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > f0 + c1 * t * d0 or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(d0):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise SearchFailed("line search")


def _direction(grad: np.ndarray, steps: deque) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; the newest (step, gradient change) comes first."""
    d = grad.copy()
    used = []
    scale = 1.0
    if steps:
        s, y = steps[0]
        if not s @ y >= 0:
            raise SearchFailed("history")
        scale = (s @ y) / (y @ y)
    for s, y in steps:
        a = (s @ d) / (s @ y)
        if np.isnan(a):
            raise SearchFailed("history")
        used.append(a)
        d -= a * y
    d *= scale
    for (s, y), a in zip(reversed(steps), reversed(used)):
        d += (a - (y @ d) / (s @ y)) * s
    return -d


def minimise(loss: Loss, w: np.ndarray, max_iter: int, tol: float = 1e-6, memory: int = 10,
             compared: int = 20) -> np.ndarray:
    """Weights after at most ``max_iter`` steps, or when values or the gradient no longer move by ``tol``.

    A failed search drops the history and tries once more; a second failure ends.
    """
    at = {}

    def value(x):
        if "x" not in at or not np.array_equal(at["x"], x):
            at["x"], at["v"] = x, loss(x)
        return at["v"]

    f, g = value(w)
    first, values, steps = f, deque([np.inf], maxlen=compared), deque(maxlen=memory)
    i, failed = 0, False
    while i < max_iter and np.linalg.norm(g) > max(tol * f, 1e-8):
        if len(values) >= 2 and abs(f - max(values)) <= tol * first:
            break
        try:
            d = _direction(g, steps)

            def along(t):
                ft, gt = value(w + t * d)
                return t, ft, gt @ d

            t = _strong_wolfe(along, (0.0, f, g @ d), 1 / np.linalg.norm(d) if i == 0 else 1.0)
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed("step")
        except SearchFailed:
            if failed:
                break
            failed = True
            steps.clear()
            continue
        failed = False
        moved = w + t * d
        ft, gt = value(moved)
        steps.appendleft((moved - w, gt - g))
        w, f, g, i = moved, ft, gt, i + 1
        values.append(f)
    return w
