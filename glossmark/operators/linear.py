"""Elastic net for many runs at once, from one pass of second moments.

Scaling, cross-validation, fitting and testing of a linear model need only sums of
products of the columns. One scan sums them per cell (a group of rows that always moves
together between training, validation and test parts). Every run - a seed, a held-out
language, a portion, a choice of features - is then a signed sum of cells, so the data is
read once whatever the number of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.operators.transforms import PASS_THROUGH
from glossmark.session import stage

# Fixed setting of the basic pipeline.
ALPHA, L1_RATIO = 0.1, 0.9
_MAX_OPEN_CELLS = 512


def centred(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Columns as one array ``v`` = (1, features, label), shifted and brought to unit size.

    This keeps the sums of products well conditioned. Errors do not depend on a shift;
    the label and the columns that models take unscaled keep their size.
    """
    names = [*columns, label]
    stats = df.selectExpr(
        *[f"avg(`{c}`) AS m{i}" for i, c in enumerate(names)],
        *[f"stddev_pop(`{c}`) AS s{i}" for i, c in enumerate(names)],
    )

    def unit(i: int, c: str) -> str:
        shifted = f"cast(`{c}` AS double) - m{i}"
        if c == label or c in PASS_THROUGH:
            return shifted
        return f"({shifted}) / if(s{i} <= abs(m{i}) * 1e-12, 1.0D, s{i})"

    values = ", ".join(unit(i, c) for i, c in enumerate(names))
    others = [f"`{c}`" for c in df.columns if c not in names]
    return df.crossJoin(F.broadcast(stats)).selectExpr(*others, f"array(1.0D, {values}) AS v")


def moments(
    df: DataFrame, cells: str = "cells", vector: str = "v", expand: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """``(cell, pos, x)``: summed outer products of ``v`` over the rows of each cell.

    ``cells`` is an array of the cells a row belongs to. Each task adds up its own rows
    per cell with numpy; only these fixed-size partial sums are shuffled, and of the
    symmetric matrix only the upper triangle. ``expand`` makes wider rows of a block of vectors.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            upper = [m[np.triu_indices(len(m))] for m in sums.values()]
            out = pd.DataFrame({"cell": list(sums), "m": upper})
            sums.clear()
            return out

        for batch in batches:
            if batch.empty:
                continue
            values = np.vstack(batch[vector].to_numpy())
            values = values if expand is None else expand(values)
            lists = batch[cells].to_numpy()
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            names, codes = np.unique(np.concatenate(lists).astype(str), return_inverse=True)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                rows = values[owner[order[bounds[i] : bounds[i + 1]]]]
                product = rows.T @ rows
                sums[name] = sums[name] + product if name in sums else product
            if len(sums) > _MAX_OPEN_CELLS:
                yield flush()
        if sums:
            yield flush()

    schema = T.StructType(
        [T.StructField("cell", T.StringType()), T.StructField("m", T.ArrayType(T.DoubleType()))]
    )
    parts = df.select(cells, vector).mapInPandas(partial, schema)
    return parts.select("cell", F.posexplode("m").alias("pos", "x")).groupBy("cell", "pos").agg(F.sum("x").alias("x"))


def run_parts(cells: DataFrame, uses: DataFrame) -> DataFrame:
    """Moments of each part of each run: ``(run, part, m)``.

    ``uses`` has ``(run, part, cell, sign)``. A matrix has a fixed size, so the list
    collected per run and part is bounded by the number of columns.
    """
    return (
        uses.join(cells, "cell")
        .groupBy("run", "part", "pos")
        .agg(F.sum(F.col("x") * F.col("sign")).alias("x"))
        .groupBy("run", "part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("m"))
    )


def _settled(
    gram: np.ndarray, target: np.ndarray, lasso: float, ridge: float, weights: np.ndarray
) -> np.ndarray | None:
    """The exact solution with the signs of ``weights``, if it meets the optimality conditions."""
    active = np.flatnonzero(weights)
    signs = np.sign(weights[active])
    exact = np.zeros_like(weights)
    if len(active):
        system = gram[np.ix_(active, active)] + ridge * np.eye(len(active))
        try:
            exact[active] = np.linalg.solve(system, target[active] - lasso * signs)
        except np.linalg.LinAlgError:
            return None
        if np.any(np.sign(exact[active]) != signs):
            return None
    gap = np.abs(target - gram @ exact)
    gap[active] = 0.0
    return exact if np.all(gap <= lasso * (1 + 1e-9) + 1e-9) else None


def descend(
    gram: np.ndarray, target: np.ndarray, n: float, alpha: float, l1_ratio: float, start: np.ndarray | None = None
) -> np.ndarray:
    """Minimise ``|y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)``.

    Coordinate sweeps find which weights are zero; a linear solve then gives the rest.
    """
    lasso, ridge = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    weights = np.zeros(len(target)) if start is None else start.copy()
    diagonal = np.diag(gram)
    live = np.flatnonzero(diagonal > 1e-12 * n)
    weights[diagonal <= 1e-12 * n] = 0.0
    gap = target - gram @ weights  # X'(y - Xw)
    for sweep in range(20_000):
        change = 0.0
        for j in live:
            pull = gap[j] + diagonal[j] * weights[j]
            new = np.sign(pull) * max(abs(pull) - lasso, 0.0) / (diagonal[j] + ridge)
            if new != weights[j]:
                gap -= gram[:, j] * (new - weights[j])
                change = max(change, abs(new - weights[j]))
                weights[j] = new
        if change <= 1e-10 * max(1.0, np.abs(weights).max(initial=0.0)):
            break
        if sweep % 5 == 4:
            exact = _settled(gram, target, lasso, ridge, weights)
            if exact is not None:
                return exact
    return weights


def fit(
    m: np.ndarray, chosen: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and intercept from the moments of (1, features, label)."""
    n, mean, last = m[0, 0], m[0] / m[0, 0], m.shape[0] - 1
    cov = m - n * np.outer(mean, mean)
    weights = descend(cov[np.ix_(chosen, chosen)], cov[chosen, last], n, alpha, l1_ratio, start)
    return weights, mean[last] - mean[chosen] @ weights


def squared_error(m: np.ndarray, chosen: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """Mean squared error over the rows behind the moments."""
    coef = np.zeros(m.shape[0])
    coef[0], coef[chosen], coef[-1] = -intercept, -weights, 1.0
    return max(coef @ m @ coef, 0.0) / m[0, 0]


def standardised(m: np.ndarray, train: np.ndarray, passed: list[int]) -> np.ndarray:
    """Moments of the columns scaled by the training mean and population deviation."""
    n = train[0, 0]
    mean, size = train[0] / n, train.shape[0]
    variance = np.maximum(np.diag(train) / n - mean**2, 0.0)
    shift, factor = mean.copy(), np.where(variance <= 1e-18, 1.0, 1 / np.sqrt(np.where(variance > 0, variance, 1)))
    for fixed in [0, size - 1, *passed]:
        shift[fixed], factor[fixed] = 0.0, 1.0
    change = np.diag(factor)
    change[0, :] -= shift * factor
    change[0, 0] = 1.0
    return change.T @ m @ change


def _whole(upper, size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = upper
    return m + m.T - np.diag(np.diag(m))


RESULT = "run string, combo int, part string, n long, cv_rmse double, rmse double, alpha double, l1_ratio double"


def solve(
    parts: DataFrame,
    columns: list[str],
    combos: list[list[str]],
    grid: list[tuple[float, float]] = ((ALPHA, L1_RATIO),),
) -> DataFrame:
    """Cross-validate, fit and test every run.

    Parts named ``fold<i>`` are training folds, others are tests. Scaling is fitted on
    all training folds. The cross-validation error is the root of the mean of the folds'
    squared errors; the first of equally good settings wins.
    """
    size = len(columns) + 2
    passed = [1 + i for i, c in enumerate(columns) if c in PASS_THROUGH]
    choices = [np.array([1 + columns.index(c) for c in combo], dtype=int) for combo in combos]

    def solve_run(rows: pd.DataFrame) -> pd.DataFrame:
        got = {p: _whole(m, size) for p, m in zip(rows["part"], rows["m"])}
        folds = [m for p, m in got.items() if p.startswith("fold") and m[0, 0] > 0.5]
        tests = {p: m for p, m in got.items() if not p.startswith("fold") and m[0, 0] > 0.5}
        out = []
        if folds:
            train = sum(folds)
            folds = [standardised(m, train, passed) for m in folds]
            tests = {p: standardised(m, train, passed) for p, m in tests.items()}
            whole = sum(folds)
            for number, chosen in enumerate(choices):
                best = None
                for alpha, l1_ratio in grid:
                    model, errors = fit(whole, chosen, alpha, l1_ratio), []
                    if len(folds) > 1:
                        for held in folds:
                            other = fit(whole - held, chosen, alpha, l1_ratio, start=model[0])
                            errors.append(squared_error(held, chosen, *other))
                    score = float(np.sqrt(np.mean(errors))) if errors else np.nan
                    if best is None or score < best[0]:
                        best = (score, alpha, l1_ratio, model)
                score, alpha, l1_ratio, model = best
                for part, m in tests.items():
                    error = float(np.sqrt(squared_error(m, chosen, *model)))
                    n = round(float(whole[0, 0]))
                    out.append((rows["run"].iloc[0], number, part, n, score, error, alpha, l1_ratio))
        return pd.DataFrame(out, columns=["run", "combo", "part", "n", "cv_rmse", "rmse", "alpha", "l1_ratio"])

    return parts.groupBy("run").applyInPandas(solve_run, RESULT)


def fit_runs(
    rows: DataFrame,
    columns: list[str],
    label: str,
    uses: DataFrame,
    combos: list[list[str]],
    grid: list[tuple[float, float]] = ((ALPHA, L1_RATIO),),
) -> DataFrame:
    """Results of all runs from rows with a ``cells`` array; reads the rows once."""
    sums = stage(moments(centred(rows, columns, label)), "moments")
    return solve(run_parts(sums, uses), columns, combos, list(grid))
