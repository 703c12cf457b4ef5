"""Hyper-parameter candidates and cross-validated choice."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from itertools import product
from multiprocessing.pool import ThreadPool

PARALLEL_FITS = 4


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations, the last parameter varying fastest."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def sample(space: dict[str, dict], n: int, seed: int) -> list[dict]:
    """``n`` seeded draws from ranges of type Integer, Real or Categorical."""
    draw = random.Random(seed)

    def one(info: dict):
        low, high = info["low"], info["high"]
        logarithmic = info.get("prior", "uniform") == "log-uniform"
        if info["type"] == "Categorical":
            return draw.choice(range(low, high + 1, info.get("step", 1)))
        if info["type"] not in ("Integer", "Real"):
            raise ValueError(f"unsupported parameter type: {info['type']}")
        value = math.exp(draw.uniform(math.log(low), math.log(high))) if logarithmic else draw.uniform(low, high)
        return min(high, max(low, round(value))) if info["type"] == "Integer" else value

    return [{name: one(info) for name, info in space.items()} for _ in range(n)]


def candidates(config: dict, seed: int) -> list[dict]:
    """Settings to try, fixed parameters included and overridden by searched ones."""
    mode = config.get("hpm_search_mode", "grid_search")
    if mode == "grid_search":
        found = grid(config["param_space"])
    elif mode == "bayes_search":
        found = sample(config["param_space"], config["n_iter"], seed)
    else:
        raise ValueError(f"unsupported search mode: {mode}")
    return [{**config.get("fixed_param", {}), **c} for c in found]


def best_of(errors: list[list[float]]) -> tuple[int, float]:
    """The first list with the lowest root of its mean, and that root; a list without errors counts as infinite."""
    scores = [math.sqrt(sum(e) / len(e)) if e else math.inf for e in errors]
    at = min(range(len(scores)), key=lambda i: (scores[i], i))
    return at, scores[at]


def choose(options: list[dict], folds: int, fold_error: Callable[[dict, int], float]) -> tuple[dict, float]:
    """The first option with the lowest root of the mean squared error over folds."""
    work = [(i, f) for i in range(len(options)) for f in range(folds)]
    with ThreadPool(PARALLEL_FITS) as pool:
        errors = pool.starmap(lambda i, f: fold_error(options[i], f), work)
    at, error = best_of([[e for (j, _), e in zip(work, errors) if j == i and e is not None] for i in range(len(options))])
    return options[at], error
