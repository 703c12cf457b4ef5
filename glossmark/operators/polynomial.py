"""Elastic net on the full polynomial expansion, searched over a grid, from one pass of second moments.

A monomial of scaled columns is a sum of monomials of the unscaled ones of at most the same degree. So the
second moments of all monomials up to the largest degree, summed once per cell of rows, hold everything: every run
scales them by a triangular matrix made of its own means and deviations, and every fold, degree, penalty and test part
is solved from the scaled moments.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.operators import linear, search
from glossmark.operators.transforms import PASS_THROUGH
from glossmark.session import stage


def elastic_net(rows: DataFrame, alpha: float, l1_ratio: float, vector: str) -> object:
    """Elastic net with penalties meant on the label's own scale.

    MLlib divides the squared part of the penalty by the label's deviation, so that part
    is multiplied by it first.
    """
    deviation = rows.agg(F.stddev_samp("label")).first()[0] or 1.0
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * deviation
    total = l1 + l2
    return LinearRegression(
        featuresCol=vector, labelCol="label", standardization=False, maxIter=1000, tol=1e-10,
        regParam=total, elasticNetParam=l1 / total if total else 0.0,
    ).fit(rows)


def monomials(n: int, degree: int) -> list[tuple[int, ...]]:
    """Products of up to ``degree`` columns as sorted tuples of their numbers; the empty product first."""
    return [m for d in range(degree + 1) for m in combinations_with_replacement(range(n), d)]


def products(values: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    """(1, columns, label) of every row -> (1, monomials of the columns, label)."""
    out = np.empty((len(values), len(terms) + 1))
    out[:, -1] = values[:, -1]
    place = {t: i for i, t in enumerate(terms)}
    for i, t in enumerate(terms):
        out[:, i] = out[:, place[t[:-1]]] * values[:, 1 + t[-1]] if t else 1.0
    return out


def scaling(terms: list[tuple[int, ...]], mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """``A`` with (monomials of the scaled columns) = A @ (monomials of the columns)."""
    place = {t: i for i, t in enumerate(terms)}
    a = np.zeros((len(terms), len(terms)))
    for t, i in place.items():
        if not t:
            a[i, 0] = 1.0
            continue
        rest, last = a[place[t[:-1]]], t[-1]
        for j in np.flatnonzero(rest):
            grown = place[tuple(sorted((*terms[j], last)))]
            a[i, grown] += rest[j] / deviation[last]
            a[i, j] -= rest[j] * mean[last] / deviation[last]
    return a


def weights_of(m: np.ndarray, chosen: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept; without a penalty the least squares solution of least size."""
    if alpha > 0:
        return linear.fit(m, chosen, alpha, l1_ratio, start)
    mean = m[0] / m[0, 0]
    cov = m - m[0, 0] * np.outer(mean, mean)
    weights = np.linalg.lstsq(cov[np.ix_(chosen, chosen)], cov[chosen, -1], rcond=1e-12)[0]
    return weights, mean[-1] - mean[chosen] @ weights


RESULT = "run string, combo int, part string, n long, cv_rmse double, rmse double, extra map<string,double>"


def fit_runs(rows: DataFrame, columns: list[str], label: str, uses: DataFrame, combos: list[list[str]], space: dict[str, list]) -> DataFrame:
    """Results of all runs from rows with a ``cells`` array; reads the rows once. ``extra`` holds the chosen setting.

    The first of equally good settings wins. The columns of ``PASS_THROUGH`` are not scaled.
    """
    options = search.grid({"degree": space["poly_degree"], "alpha": space["alpha"], "l1_ratio": space["l1_ratio"]})
    terms = monomials(len(columns), max(space["poly_degree"]))
    passed = [i for i, c in enumerate(columns) if c in PASS_THROUGH]
    place = {t: i for i, t in enumerate(terms)}
    allowed = [{columns.index(c) for c in combo} for combo in combos]
    chosen = {
        (k, d): np.array([i for t, i in place.items() if t and len(t) <= d and set(t) <= mine], dtype=int)
        for k, mine in enumerate(allowed) for d in set(space["poly_degree"])
    }
    sums = stage(linear.moments(linear.centred(rows, columns, label), expand=lambda v: products(v, terms)), "moments")
    parts = linear.run_parts(sums, uses)

    def scaled(m: np.ndarray, whole: np.ndarray) -> np.ndarray:
        n, first = whole[0, 0], np.array([place[(i,)] for i in range(len(columns))], dtype=int)
        mean = whole[0, first] / n
        variance = np.maximum(whole[first, first] / n - mean**2, 0.0)
        deviation = np.where(variance <= 1e-18, 1.0, np.sqrt(variance))
        mean[passed], deviation[passed] = 0.0, 1.0
        a = np.eye(len(terms) + 1)
        a[:-1, :-1] = scaling(terms, mean, deviation)
        return a @ m @ a.T

    def solve_run(frame: pd.DataFrame) -> pd.DataFrame:
        got = {p: linear._whole(m, len(terms) + 1) for p, m in zip(frame["part"], frame["m"])}
        folds = [m for p, m in got.items() if p.startswith("fold") and m[0, 0] > 0.5]
        tests = {p: m for p, m in got.items() if not p.startswith("fold") and m[0, 0] > 0.5}
        out = []
        if folds:
            train = sum(folds)
            folds = [scaled(m, train) for m in folds]
            tests = {p: scaled(m, train) for p, m in tests.items()}
            whole = sum(folds)
            for number in range(len(combos)):
                models, errors = [], []
                for o in options:
                    mine = chosen[number, o["degree"]]
                    models.append(weights_of(whole, mine, o["alpha"], o["l1_ratio"]))
                    held = folds if len(folds) > 1 else []
                    errors.append([linear.squared_error(h, mine, *weights_of(whole - h, mine, o["alpha"], o["l1_ratio"], models[-1][0])) for h in held])
                at, score = search.best_of(errors)
                mine, setting = chosen[number, options[at]["degree"]], {k: float(v) for k, v in options[at].items()}
                for part, m in tests.items():
                    error = float(np.sqrt(linear.squared_error(m, mine, *models[at])))
                    out.append((frame["run"].iloc[0], number, part, round(float(whole[0, 0])), score, error, setting))
        return pd.DataFrame(out, columns=["run", "combo", "part", "n", "cv_rmse", "rmse", "extra"])

    return parts.groupBy("run").applyInPandas(solve_run, RESULT)
