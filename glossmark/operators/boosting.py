"""Second-order gradient boosting of trees, many fits at once, on histograms of binned columns.

A fit is a list of trees; a tree is grown by asking for the best splits of some of its nodes and
expanding nodes until nothing is left to ask (``grow``). Depth-wise growth expands every node that
gains down to a depth. Leaf-wise growth takes the leaf of largest gain first, up to a number of
leaves; because a node's gain depends on nothing but its own rows, all leaves that the queue may
still reach are asked for together, so a tree takes about as many questions as it has levels.

The answers come from sums per (node, column, bin) of the gradient and the number of rows, in one
of two ways with equal results:

* ``fit_local``: the binned table, whose size was checked, lies in the worker. Sums are built for the
  smaller of two siblings, those of the other follow by subtraction. For columns of many bins (up to one for
  every value), running sums over the rows sorted by value, dealt on from node to node, take the place of
  sums per bin.
* ``fit_scanned``: rows stay in Spark. One scan answers the questions of all open fits; sums are added
  up per node in tasks, and only best splits reach the driver.

Candidates that differ in nothing but the number of rounds are prefixes of one fit.
"""

from __future__ import annotations

import heapq
from collections.abc import Generator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.session import stage

#: A split must gain more than this.
LEAST_GAIN = 1e-6
#: Gains that differ by less than this share count as equal.
TIE = 1e-9
NONE = (-np.inf, -1, -1, 0.0, 0.0)
#: A column has few bins if a fit has this many rows for each.
FEW = 8


@dataclass(frozen=True)
class Policy:
    """How trees are grown. ``leaves`` is 0 for depth-wise growth, ``depth`` 0 for no limit."""

    rounds: int
    step: float
    depth: int
    leaves: int
    l1: float
    l2: float
    min_gain: float
    min_hessian: float
    min_rows: int
    rows: float
    columns: float
    bins: int

    def __post_init__(self):
        if not self.leaves and not self.depth:
            raise ValueError("depth-wise growth needs a depth")


def shrunk(total, l1: float):
    """The gradient sum pulled towards zero by the L1 penalty."""
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def strength(total: np.ndarray, hessian: np.ndarray, policy: Policy) -> np.ndarray:
    """What a leaf takes off the loss, twice."""
    out = np.abs(total)
    if policy.l1:
        out -= policy.l1
        np.maximum(out, 0.0, out=out)
    out *= out
    out /= hessian + policy.l2
    return out


@dataclass
class Tree:
    """Nodes as parallel lists; the right child follows the left one. ``chosen`` holds the nodes that are split in the end."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-np.inf])
    total: list[float] = field(default_factory=lambda: [0.0])
    size: list[float] = field(default_factory=lambda: [0.0])
    best: dict = field(default_factory=dict)
    chosen: set = field(default_factory=set)

    def expand(self, node: int) -> list[int]:
        """Both children of a node, split as its best split says."""
        gain, feature, cut, total, size = self.best[node]
        first = len(self.parent)
        self.left[node], self.feature[node], self.bin[node], self.gain[node] = first, feature, cut, gain
        for t, n in ((total, size), (self.total[node] - total, self.size[node] - size)):
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.left.append(-1)
            self.feature.append(-1)
            self.bin.append(-1)
            self.gain.append(-np.inf)
            self.total.append(t)
            self.size.append(n)
        return [first, first + 1]

    def outputs(self, policy: Policy) -> np.ndarray:
        """Each node's value: its own if it is a leaf in the end, else that of the leaf it was split off from."""
        total, size = np.array(self.total), np.array(self.size)
        weight = size + policy.l2
        out = np.divide(-shrunk(total, policy.l1), weight, out=np.zeros(len(total)), where=weight > 0) * policy.step
        if 2 * len(self.chosen) + 1 < len(out):
            alive = [True] * len(out)
            for node, parent in enumerate(self.parent[1:], 1):
                alive[node] = alive[parent] and parent in self.chosen
                if not alive[node]:
                    out[node] = out[parent]
        return out


def grow(tree: Tree, policy: Policy) -> Generator[list[int], list[tuple], None]:
    """Ask for best splits of nodes: each question is a list of nodes, its answer a list of
    (gain, column, bin, left sum, left rows), for the root with its own (sum, rows) behind."""

    def able(node: int) -> bool:
        return tree.best.get(node, NONE)[0] > LEAST_GAIN and tree.best[node][0] >= policy.min_gain

    (root,) = yield [0]
    tree.best[0], (tree.total[0], tree.size[0]) = root[:5], root[5:]
    if not policy.leaves:
        level = [0]
        while level:
            level = [c for node in level if able(node) for c in (tree.chosen.add(node) or tree.expand(node))]
            level = [c for c in level if tree.depth[c] < policy.depth]
            if level:
                tree.best.update(zip(level, (yield level)))
        return
    while True:
        queue, todo, chosen = [(-tree.best[0][0], 0)] if able(0) else [], [], set()
        while queue and len(chosen) < policy.leaves - 1:
            _, node = heapq.heappop(queue)
            chosen.add(node)
            first = tree.left[node]
            if first < 0:
                todo.append(node)
            else:
                for child in (first, first + 1):
                    if able(child):
                        heapq.heappush(queue, (-tree.best[child][0], child))
        if not todo:
            tree.chosen = chosen
            return
        asked = [c for node in todo for c in tree.expand(node) if not policy.depth or tree.depth[c] < policy.depth]
        if asked:
            tree.best.update(zip(asked, (yield asked)))


# --- sums and splits ------------------------------------------------------------------------


class Layout:
    """Where the bins of each column lie among all bins."""

    def __init__(self, sizes: list[int]) -> None:
        self.start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.bins = int(self.start[-1])
        self.column = np.repeat(np.arange(len(sizes)), sizes)
        self.first = self.start[:-1][self.column]
        self.last = np.zeros(self.bins, bool)
        self.last[self.start[1:] - 1] = True

    def best(self, sums: np.ndarray, counts: np.ndarray, policy: Policy, allowed: np.ndarray) -> list[tuple]:
        """The best split of each node from its (bins) sums and counts; the first of those that are equal but for rounding."""
        total, size = self.totals(sums, counts)
        left, n = (np.cumsum(x, axis=1) for x in (sums, counts))
        left -= (left - sums)[:, self.first]
        n -= (n - counts)[:, self.first]
        right, m = total[:, None] - left, size[:, None] - n
        least = max(policy.min_hessian, policy.min_rows, 1)
        bad = (np.minimum(n, m) < least) | (self.last | ~allowed[self.column])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = strength(left, n, policy)
            gain += strength(right, m, policy)
            gain -= strength(total, size, policy)[:, None]
        gain[bad] = -np.inf
        at = (gain >= gain.max(1, keepdims=True) * (1 - TIE)).argmax(1)
        return [
            (float(gain[i, k]), int(self.column[k]), int(k), float(left[i, k]), float(n[i, k])) if not bad[i, k] else NONE
            for i, k in enumerate(at.tolist())
        ]

    def totals(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = self.start[1]
        return sums[:, :stop].sum(1), counts[:, :stop].sum(1)


def sampled(row: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows take part in a round, from a hash of seed, round and row."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


@lru_cache(1 << 16)
def columns_of(n: int, seed: int, turn: int, share: float) -> np.ndarray:
    """Which columns a tree may use; the same array for all fits that ask, not to be written to."""
    allowed = np.ones(n, bool)
    if share < 1:
        allowed[:] = False
        allowed[np.random.default_rng([seed, turn]).choice(n, max(1, int(share * n)), replace=False)] = True
    return allowed


class Gains:
    """Uses and gains of the columns of a fit."""

    def __init__(self, n: int) -> None:
        self.uses, self.gain = np.zeros(n), np.zeros(n)

    def add(self, tree: Tree) -> None:
        for node in tree.chosen:
            self.uses[tree.feature[node]] += 1
            self.gain[tree.feature[node]] += tree.gain[node]

    def importances(self, counts: bool) -> np.ndarray:
        """Numbers of splits, or each column's mean gain as a share of all columns'."""
        if counts:
            return self.uses
        mean = np.divide(self.gain, self.uses, out=np.zeros_like(self.gain), where=self.uses > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


# --- one fit on a table in memory -----------------------------------------------------------


class _Local:
    """One fit's rows. Columns of few bins are summed up per bin, those of many are kept in the order of their values.

    A tree sees the rows of its bag only: ``codes`` has a line per column it may use, columns of few bins first, their
    bins renumbered without those of other columns; ``node`` has each row's node.
    """

    def __init__(self, codes: np.ndarray, layout: Layout, policy: Policy, n: int) -> None:
        self.policy, self.n = policy, n
        self.least = max(policy.min_hessian, policy.min_rows, 1)
        self.start, self.size = layout.start, np.diff(layout.start)
        self.by_row, self.by_column = np.ascontiguousarray(codes), np.ascontiguousarray(codes[:n].T)
        self.wide = self.size * FEW > n
        self.order = {j: np.argsort(self.by_column[j], kind="stable") for j in np.flatnonzero(self.wide)}

    def begin(self, tree: Tree, bag: np.ndarray, gradient: np.ndarray, allowed: np.ndarray) -> None:
        self.tree, self.bag, self.gradient = tree, bag, gradient[bag]
        usable = allowed & (self.size > 1)
        self.few, self.many = np.flatnonzero(usable & ~self.wide), np.flatnonzero(usable & self.wide)
        used = np.concatenate([self.few, self.many])
        self.line, self.shift = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        self.line[used] = np.arange(len(used))
        self.ends = np.cumsum(self.size[self.few])
        self.bins = int(self.ends[-1]) if len(self.few) else 0
        self.shift[self.few] = self.ends - self.size[self.few] - self.start[self.few]
        self.owner = np.repeat(np.arange(len(self.few)), self.size[self.few])
        whole = len(bag) == self.n
        self.codes = self.by_column[used] if whole else self.by_column[used].take(bag, axis=1)
        self.codes += self.shift[used, None]
        self.node, self.here, self.moved = np.zeros(len(bag), np.int64), np.arange(len(bag)), 1
        self.sums: dict[int, tuple] = {}
        self.sorted: dict[int, np.ndarray] = {}
        if len(self.many):
            order = np.stack([self.order[j] for j in self.many])
            if not whole:
                place = np.full(self.n, -1)
                place[bag] = self.here
                order = place[order]
                order = order[order >= 0].reshape(len(self.many), -1)
            self.sorted[0] = order
            self.offset = (np.arange(len(self.many)) + len(self.few))[:, None] * len(bag)

    def advance(self) -> None:
        """Rows of nodes expanded since the last time go to the children."""
        tree = self.tree
        if len(tree.left) == self.moved:
            return
        left, feature = np.array(tree.left), np.array(tree.feature)
        fresh = left >= self.moved
        following = np.where(fresh, left, np.arange(len(left)))
        cut = np.where(fresh, np.array(tree.bin) + self.shift[feature], np.iinfo(np.int64).max)
        line = np.where(fresh, self.line[feature] * len(self.node), 0)
        code = self.codes.ravel().take(line.take(self.node) + self.here)
        right = code > cut.take(self.node)
        self.node = following.take(self.node) + right
        self.moved = len(left)
        for parent in np.flatnonzero(fresh).tolist() if len(self.many) else ():
            rows = self.sorted.pop(parent)
            first = tree.left[parent]
            if max(tree.size[first], tree.size[first + 1]) < 2 * self.least:
                continue
            high = right.take(rows)
            self.sorted[first], self.sorted[first + 1] = rows[~high].reshape(len(rows), -1), rows[high].reshape(len(rows), -1)

    def answer(self, nodes: list[int]) -> list[tuple]:
        tree, found = self.tree, {}
        if nodes == [0]:
            tree.total[0], tree.size[0] = float(self.gradient.sum()), float(len(self.bag))
        else:
            self.advance()
        open_nodes = [x for x in nodes if tree.size[x] >= 2 * self.least]
        if open_nodes and len(self.codes):
            found = self.best(open_nodes)
        answers = [found.get(x, NONE) for x in nodes]
        return [(*answers[0], tree.total[0], tree.size[0])] if nodes == [0] else answers

    def best(self, nodes: list[int]) -> dict[int, tuple]:
        """The best split of each node and its sibling; the first of those that are equal but for rounding."""
        tree = self.tree
        if nodes != [0]:
            first = [tree.left[p] for p in dict.fromkeys([tree.parent[x] for x in nodes])]
            small = [x + (tree.size[x + 1] < tree.size[x]) for x in first]
            nodes = small + [2 * x + 1 - y for x, y in zip(first, small)]
        total, size = np.array([tree.total[x] for x in nodes]), np.array([tree.size[x] for x in nodes])
        base = strength(total, size, self.policy)
        few = self.from_sums(nodes, size) if self.bins else None
        many = self.from_order(nodes, size) if len(self.many) else None
        most = np.full(len(nodes), -np.inf)
        if few:
            np.maximum(most, few[0].max(1), out=most)
        if many:
            np.maximum(most, many[1].max(0), out=most)
        enough = most - np.abs(most - base) * TIE
        none = len(self.size)
        columns = np.full((2, len(nodes)), none)
        if few:
            at = (few[0] >= enough[:, None]).argmax(1)
            hit = few[0][np.arange(len(nodes)), at] >= enough
            columns[0] = np.where(hit, self.few[self.owner[at]], none)
        if many:
            top = (many[1] >= enough).argmax(0)
            columns[1] = np.where(many[1][top, np.arange(len(nodes))] >= enough, self.many[top], none)
        found = {}
        for i in np.flatnonzero((columns[1] < columns[0]) & (most > -np.inf)).tolist():
            gain, _, left, n, code, stops = many
            f, a = int(top[i]), int(stops[i] - size[i])
            k = a + int((gain[f, a : stops[i]] >= enough[i]).argmax())
            found[nodes[i]] = (float(gain[f, k] - base[i]), int(columns[1, i]), int(code[f, k]), float(left[f, k]), float(n[k]))
        mine = np.flatnonzero((columns[0] < columns[1]) & (most > -np.inf))
        if len(mine):
            gain, left, n = few
            cut, column = at[mine], columns[0, mine]
            splits = (gain[mine, cut] - base[mine], column, cut - self.shift[column], left[mine, cut], n[mine, cut])
            found.update(zip([nodes[i] for i in mine.tolist()], zip(*[x.tolist() for x in splits])))
        return found

    def score(self, left: np.ndarray, n: np.ndarray, total: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What both sides of every split take off the loss."""
        gain = strength(left, n, self.policy)
        gain += strength(total - left, m, self.policy)
        return gain

    def from_order(self, nodes: list[int], size: np.ndarray) -> tuple:
        """Splits from running sums over the rows in the order of each column."""
        rows = np.concatenate([self.sorted[x] for x in nodes], axis=1) if len(nodes) > 1 else self.sorted[nodes[0]]
        counts = size.astype(np.int64)
        stops = np.cumsum(counts)
        starts = stops - counts
        left = self.gradient.take(rows)
        np.cumsum(left, axis=1, out=left)
        if len(nodes) > 1:
            before = left[:, starts - 1]
            before[:, 0] = 0.0
            left -= np.repeat(before, counts, axis=1)
        n = (np.arange(rows.shape[1]) - np.repeat(starts, counts) + 1).astype(np.float64)
        m = np.repeat(size, counts) - n
        gain = self.score(left, n, np.repeat(left[:, stops - 1], counts, axis=1), m)
        code = self.codes.ravel().take(rows + self.offset)
        bad = np.zeros(rows.shape, bool)
        np.equal(code[:, 1:], code[:, :-1], out=bad[:, :-1])
        bad |= np.minimum(n, m) < self.least
        np.copyto(gain, -np.inf, where=bad)
        return gain, np.maximum.reduceat(gain, starts, axis=1), left, n, code, stops

    def from_sums(self, nodes: list[int], size: np.ndarray) -> tuple:
        """Splits from sums per bin, built for the smaller of two siblings, which come first; those of the others follow by subtraction."""
        tree, bins, few = self.tree, self.bins, len(self.few)
        if nodes == [0]:
            sums, counts = self.binned(self.codes[:few].ravel(), self.gradient, 1)
            self.sums[0] = (sums[0], counts[0])
        else:
            small = nodes[: len(nodes) // 2]
            parents = [tree.parent[x] for x in small]
            slot = np.full(len(tree.parent), -1)
            slot[small] = np.arange(len(small)) * bins
            mine = slot.take(self.node)
            rows = np.flatnonzero(mine >= 0)
            key = self.codes[:few].take(rows, axis=1)
            key += mine.take(rows)
            built = self.binned(key.ravel(), self.gradient.take(rows), len(small))
            whole = zip(*[self.sums.pop(p) for p in parents])
            sums, counts = (np.concatenate([b, np.array(w) - b]) for b, w in zip(built, whole))
            self.sums.update(zip(nodes, zip(sums, counts)))
        left, n = np.cumsum(sums, axis=1), np.cumsum(counts, axis=1)
        total = left[:, self.ends[0] - 1].copy()
        # running sums start anew at the first bin of each column
        before = np.zeros((2, len(nodes), few))
        before[0, :, 1:] = left[:, self.ends[:-1] - 1]
        before[1] = size[:, None] * np.arange(few)
        left -= np.repeat(before[0], self.size[self.few], axis=1)
        n = n - np.repeat(before[1], self.size[self.few], axis=1)
        m = size[:, None] - n
        gain = self.score(left, n, total[:, None], m)
        np.copyto(gain, -np.inf, where=np.minimum(n, m) < self.least)
        return gain, left, n

    def binned(self, key: np.ndarray, gradient: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the gradient and numbers of rows per bin of ``n`` nodes."""
        weights = np.tile(gradient, len(self.few))
        sums, counts = np.bincount(key, weights, n * self.bins), np.bincount(key, minlength=n * self.bins)
        return sums.reshape(n, -1), counts.reshape(n, -1)

    def walk(self, rows: np.ndarray) -> np.ndarray:
        """The deepest node that rows outside the bag reach."""
        tree = self.tree
        left, feature = np.array(tree.left), np.array(tree.feature)
        leaf = left < 0
        following, column = np.where(leaf, np.arange(len(left)), left), np.where(leaf, 0, feature)
        cut = np.where(leaf, np.iinfo(np.int64).max, np.array(tree.bin))
        codes, place, node = self.by_row.ravel(), rows * self.by_row.shape[1], np.zeros(len(rows), np.int64)
        for _ in range(max(tree.depth)):
            node = following.take(node) + (codes.take(place + column.take(node)) > cut.take(node))
        return node


def fit_local(
    codes: np.ndarray, label: np.ndarray, number: np.ndarray, layout: Layout, train: np.ndarray, tests: dict[str, np.ndarray],
    policy: Policy, rounds: list[int], seed: int,
) -> tuple[dict[str, dict[int, float]], Gains]:
    """Mean squared errors of each test part after each of the ``rounds``, and the columns' gains after the last.

    ``codes`` holds the place of each row's value among all bins; ``train`` and ``tests`` are positions of rows.
    """
    every = np.concatenate([train, *tests.values()]).astype(np.int64)
    codes, target, n = codes[every].astype(np.int64), label[every], len(train)
    bounds = np.cumsum([n, *map(len, tests.values())])
    guess = np.full(len(every), label[train].mean())
    local, gains = _Local(codes, layout, policy, n), Gains(codes.shape[1])
    wanted, errors = set(rounds), {part: {} for part in tests}
    drawn, bag, others = np.zeros(len(every), bool), np.arange(n), np.arange(n, len(every))
    for turn in range(1, max(rounds, default=0) + 1):
        if policy.rows < 1:
            drawn[:n] = sampled(number[train], seed, turn, policy.rows)
            bag, others = np.flatnonzero(drawn), np.flatnonzero(~drawn)
        tree = Tree()
        local.begin(tree, bag, guess[:n] - target[:n], columns_of(codes.shape[1], seed, turn, policy.columns))
        steps = grow(tree, policy)
        with np.errstate(divide="ignore", invalid="ignore"):
            try:
                question = next(steps)
                while True:
                    question = steps.send(local.answer(question))
            except StopIteration:
                local.advance()
        values = tree.outputs(policy)
        guess[bag] += values.take(local.node)
        guess[others] += values.take(local.walk(others))
        gains.add(tree)
        if turn in wanted:
            wrong = (guess - target) ** 2
            for (part, _), a, b in zip(tests.items(), bounds, bounds[1:]):
                if b > a:
                    errors[part][turn] = float(wrong[a:b].mean())
    return errors, gains


# --- all fits by scans over a table in Spark --------------------------------------------------


@dataclass
class Fit:
    """One open fit of ``fit_scanned``: trained on the rows of ``run`` that are not in ``fold``."""

    run: int
    fold: int
    policy: Policy
    rounds: list[int]
    seed: int


def _codes(column) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.int64)


def _walk(codes: np.ndarray, left: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The deepest node of a tree that each row reaches."""
    node = np.zeros(len(codes), np.int64)
    while True:
        first = left[node]
        rows = np.flatnonzero(first >= 0)
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = first[rows] + (codes[rows, feature[at]] > cut[at])


def _arrays(tree: Tree) -> tuple[np.ndarray, ...]:
    return np.array(tree.left), np.array(tree.feature), np.array(tree.bin)


def fit_scanned(
    rows: DataFrame, layout: Layout, fits: list[Fit], tests: dict[int, list[str]], sums_bytes: int = 256 << 20,
) -> list[tuple[dict[str, dict[int, float]], Gains]]:
    """The results of ``fit_local`` for every fit, from scans over ``rows``.

    ``rows`` has ``row`` (long), ``codes`` (array), ``label``, ``folds`` (per run the row's training fold or -1) and ``parts``
    (``run|part`` of the tests it belongs to; a fold counts as a part of fits that leave it out). Every round writes the rows
    with their new predictions; each scan serves as many fits as their sums fit into ``sums_bytes``.
    """
    n_fits, width = len(fits), len(layout.start) - 1

    def trains(folds: np.ndarray, fit: Fit) -> np.ndarray:
        return (folds[:, fit.run] >= 0) & (folds[:, fit.run] != fit.fold)

    def means(batches):
        total = np.zeros((n_fits, 2))
        for b in batches:
            folds, label = _codes(b["folds"]), b["label"].to_numpy()
            for i, fit in enumerate(fits):
                mine = trains(folds, fit)
                total[i] += label[mine].sum(), mine.sum()
        yield pd.DataFrame({"fit": np.arange(n_fits), "total": total[:, 0], "n": total[:, 1]})

    found = rows.mapInPandas(means, "fit int, total double, n double").groupBy("fit").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    base = np.zeros(n_fits)
    for fit, total, n in found.collect():
        base[fit] = total / n if n else 0.0
    state = stage(rows.withColumn("guess", F.array(*[F.lit(float(x)) for x in base])), "boosting")
    gains, errors = [Gains(width) for _ in fits], [{p: {} for p in tests[i]} for i in range(n_fits)]

    def answers(turn: int, trees: dict[int, Tree], asked: dict[int, list[int]], allowed: dict[int, np.ndarray]) -> dict[int, list[tuple]]:
        shapes = {i: _arrays(trees[i]) for i in asked}

        def partial(batches):
            sums = {i: np.zeros((2, len(nodes), layout.bins)) for i, nodes in asked.items()}
            for b in batches:
                codes, label, folds, guess = _codes(b["codes"]), b["label"].to_numpy(), _codes(b["folds"]), np.vstack(b["guess"].to_numpy())
                number = b["row"].to_numpy()
                for i, nodes in asked.items():
                    fit = fits[i]
                    mine = trains(folds, fit)
                    if fit.policy.rows < 1:
                        mine &= sampled(number, fit.seed, turn, fit.policy.rows)
                    slot = np.full(len(shapes[i][0]), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[_walk(codes, *shapes[i])]
                    mine = np.flatnonzero(mine & (at >= 0))
                    key = (at[mine, None] * layout.bins + codes[mine]).ravel()
                    gradient = np.repeat(guess[mine, i] - label[mine], width)
                    size = len(nodes) * layout.bins
                    sums[i][0] += np.bincount(key, gradient, size).reshape(-1, layout.bins)
                    sums[i][1] += np.bincount(key, minlength=size).reshape(-1, layout.bins)
            for i, nodes in asked.items():
                yield pd.DataFrame({"fit": i, "node": nodes, "sums": list(sums[i][0]), "counts": list(sums[i][1])})

        def best(frame: pd.DataFrame) -> pd.DataFrame:
            i, node = int(frame["fit"].iloc[0]), int(frame["node"].iloc[0])
            whole = [np.vstack(frame[c].to_numpy()).sum(0)[None] for c in ("sums", "counts")]
            (split,) = layout.best(*whole, fits[i].policy, allowed[i])
            total, size = layout.totals(*whole)
            return pd.DataFrame([(i, node, *split, float(total[0]), float(size[0]))], columns=["fit", "node", "gain", "feature", "bin", "left", "n", "total", "size"])

        parts = state.mapInPandas(partial, "fit int, node int, sums array<double>, counts array<double>")
        got = parts.groupBy("fit", "node").applyInPandas(
            best, "fit int, node int, gain double, feature int, bin int, left double, n double, total double, size double"
        )
        table = {(r.fit, r.node): tuple(r)[2:] for r in got.collect()}
        return {i: [table[i, node][: 7 if node == 0 else 5] for node in nodes] for i, nodes in asked.items()}

    for turn in range(1, max((max(f.rounds) for f in fits), default=0) + 1):
        open_fits = [i for i, f in enumerate(fits) if turn <= max(f.rounds)]
        trees = {i: Tree() for i in open_fits}
        allowed = {i: columns_of(width, fits[i].seed, turn, fits[i].policy.columns) for i in open_fits}
        growing = {i: grow(trees[i], fits[i].policy) for i in open_fits}
        asked = {i: next(g) for i, g in growing.items()}
        while asked:
            replies, block, held = {}, {}, 0
            for i, nodes in asked.items():
                need = len(nodes) * layout.bins * 16
                if block and held + need > sums_bytes:
                    replies.update(answers(turn, trees, block, allowed))
                    block, held = {}, 0
                block[i], held = nodes, held + need
            replies.update(answers(turn, trees, block, allowed))
            following = {}
            for i, reply in replies.items():
                try:
                    following[i] = growing[i].send(reply)
                except StopIteration:
                    gains[i].add(trees[i])
            asked = following

        outputs = {i: (_arrays(trees[i]), trees[i].outputs(fits[i].policy)) for i in open_fits}
        scored = [i for i in open_fits if turn in fits[i].rounds]

        def update(batches, outputs=outputs):
            for b in batches:
                codes, guess = _codes(b["codes"]), np.vstack(b["guess"].to_numpy()).copy()
                for i, (shape, values) in outputs.items():
                    guess[:, i] += values[_walk(codes, *shape)]
                b["guess"] = list(guess)
                yield b

        state = stage(state.mapInPandas(update, state.schema), "boosting")
        if scored:

            def wrong(batches, scored=scored):
                total: dict[tuple[int, str], np.ndarray] = {}
                for b in batches:
                    folds, label, guess = _codes(b["folds"]), b["label"].to_numpy(), np.vstack(b["guess"].to_numpy())
                    lists = [set(p) for p in b["parts"]]
                    for i in scored:
                        fit, e = fits[i], (guess[:, i] - label) ** 2
                        for part in tests[i]:
                            mine = folds[:, fit.run] == fit.fold if fit.fold >= 0 else np.array([f"{fit.run}|{part}" in x for x in lists], bool)
                            total.setdefault((i, part), np.zeros(2))
                            total[i, part] += e[mine].sum(), mine.sum()
                yield pd.DataFrame([(i, p, *t) for (i, p), t in total.items()], columns=["fit", "part", "total", "n"])

            sums = state.mapInPandas(wrong, "fit int, part string, total double, n double").groupBy("fit", "part")
            for i, part, total, n in sums.agg(F.sum("total"), F.sum("n")).collect():
                if n:
                    errors[i][part][turn] = total / n
    return list(zip(errors, gains))
