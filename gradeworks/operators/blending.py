"""Scores from moments: predicted scores, the covariance a score implies, convex blends. For labels that are visible."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def error_from_moments(sd_y: Column, mean_y: Column, sd_p: Column, mean_p: Column, cov: Column) -> Column:
    return F.sqrt(F.greatest(sd_y * sd_y + sd_p * sd_p - 2 * cov + (mean_p - mean_y) * (mean_p - mean_y), F.lit(0.0)))


def predicted(error: Column, cov: Column, sd_y: Column, sd_p: Column, a: float = 0.6, b: float = 0.4) -> Column:
    return a * error + b * (1 - cov / F.when(sd_y * sd_p > 0, sd_y * sd_p))


def implied_correlation(score: Column, sd_y: Column, mean_y: Column, sd_p: Column, mean_p: Column, steps: int = 60) -> Column:
    """The correlation that gives a score, by halving [-0.99, 0.999] a fixed number of times: the score falls as it grows."""

    def at(r: Column) -> Column:
        cov = r * sd_y * sd_p
        return predicted(error_from_moments(sd_y, mean_y, sd_p, mean_p, cov), cov, sd_y, sd_p)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(at(mid) > score, mid).otherwise(s["lo"]).alias("lo"), F.when(at(mid) > score, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(-0.99).cast("double").alias("lo"), F.lit(0.999).cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative parts that sum to 1."""
    u = np.sort(v)[::-1]
    over = np.flatnonzero(u - (np.cumsum(u) - 1) / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - (u[: over + 1].sum() - 1) / (over + 1), 0)


def convex_blend(gram: np.ndarray, shift: float = 1.0, scale: tuple[float, float] = (0.9, 1.1), rounds: int = 400) -> tuple[np.ndarray, float, float, float]:
    """(weights, a, b, composite) of ``a + b * (P w)`` with w on the simplex and bounded a and b, from sums of ``[1, p..., y]``.

    Projected gradient on w alternates with the best a and b on a grid of b;
    a removes the bias as far as its bound allows.
    """
    n, k = gram[0, 0], len(gram) - 2
    mp, my = gram[0, 1 : k + 1] / n, gram[0, -1] / n
    cov_p, cov_y = gram[1 : k + 1, 1 : k + 1] / n - np.outer(mp, mp), gram[1 : k + 1, -1] / n - mp * my
    sd_y = np.sqrt(max(gram[-1, -1] / n - my * my, 0))

    def value(w: np.ndarray, b: float) -> tuple[float, float]:
        a = float(np.clip(my - b * mp @ w, -shift, shift))
        vp, c = b * b * (w @ cov_p @ w), b * (cov_y @ w)
        error = np.sqrt(max(vp + sd_y**2 - 2 * c + (a + b * mp @ w - my) ** 2, 0))
        return 0.6 * error + 0.4 * (1 - (c / (sd_y * np.sqrt(vp)) if vp > 0 and sd_y > 0 else 0.0)), a

    w, grid, step = np.full(k, 1 / k), np.linspace(*scale, 21), 0.25
    b = 1.0
    best = value(w, b)
    for _ in range(rounds):
        slope = np.array([(value(w + 1e-5 * e, b)[0] - value(w - 1e-5 * e, b)[0]) / 2e-5 for e in np.eye(k)])
        trial = simplex(w - step * slope / max(np.abs(slope).max(), 1e-12))
        tb = min(grid, key=lambda x: value(trial, x)[0])
        got = value(trial, tb)
        if got[0] < best[0] - 1e-12:
            w, b, best = trial, float(tb), got
        else:
            step /= 2
            if step < 1e-6:
                break
    return w, best[1], b, best[0]


def identify(observed: np.ndarray, var_p: float) -> list[tuple[str, float]]:
    """(formula, largest misfit) of candidate score formulas against five scores of shifted and shrunk predictions.

    Three unknowns (label deviation, correlation, bias) are fitted by
    Gauss-Newton steps from several starts.
    """
    forms = {
        "0.5 rmse + 0.5 (1 - r)": lambda e, r: 0.5 * e + 0.5 * (1 - r),
        "0.6 rmse + 0.4 (1 - r)": lambda e, r: 0.6 * e + 0.4 * (1 - r),
        "2/3 rmse + 1/3 (1 - r)": lambda e, r: 2 / 3 * e + (1 - r) / 3,
        "rmse (1 - r)": lambda e, r: e * (1 - r),
        "rmse": lambda e, r: e,
    }

    def errors(t: np.ndarray) -> np.ndarray:
        sd, r, b = t
        cov = r * sd * np.sqrt(var_p)
        base = sd * sd + var_p - 2 * cov + b * b
        return np.sqrt(np.maximum([base, base - b + 0.25, base - 2 * b + 1, base - 3 * b + 2.25, base - 0.75 * var_p + cov], 1e-9))

    out = []
    for name, f in forms.items():
        best = np.inf
        for start in ((1.0, 0.8, 0.0), (0.8, 0.6, 0.1), (1.2, 0.9, -0.1)):
            t, damp = np.array(start), 1e-3
            miss = f(errors(t), t[1]) - observed
            for _ in range(300):
                jac = np.column_stack([(f(errors(t + d), (t + d)[1]) - observed - miss) / 1e-6 for d in 1e-6 * np.eye(3)])
                new = np.clip(t - np.linalg.solve(jac.T @ jac + damp * np.eye(3), jac.T @ miss), [0.05, -0.99, -2], [3, 0.999, 2])
                after = f(errors(new), new[1]) - observed
                if after @ after < miss @ miss:
                    t, miss, damp = new, after, damp / 3
                else:
                    damp *= 4
            best = min(best, float(np.abs(miss).max()))
        out.append((name, best))
    return sorted(out, key=lambda x: x[1])
