"""Tree ensembles on distributed histograms.

Columns are cut into at most 255 bins once, and rows with equal bins and label
become one cell that carries, for every model of a run (the final one and one per
fold), its number of rows and the sum of their targets.  All models of a run are
then grown from the same cells, whose number is bounded by the bins and not by the
rows where columns have few values.

A tree grows by histograms only: for the nodes that may be split, sums of gradients
and Hessians per column and bin, added up over all blocks of cells.  Growth is a
generator that asks for the histograms of nodes, so the same code runs in two ways:

* cells that fit a task (checked by their number): every model is a task of its own;
* more cells: a Spark job per step adds up the histograms of all models at once;
  forests finish the nodes that have become small enough as groups of their cells.

Boosting is of second order with softmax trees for three and more classes; leaves
are opened in the order of their gain up to a number of leaves, or by depth.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import materialise

MAX_BINS = 255
TASK_BYTES = 64 << 20  # cells of a run that are sent to every task
KEPT_ROUNDS = 10  # rounds after which the margins of the blocks are computed anew
HISTOGRAM_CELLS = 4_000_000
POINTS = 10_000  # values of a column that stand for BUFFER rows when cuts are found
BUFFER = 1 << 20
TINY = 1e-9


# ---------------------------------------------------------------- cells


@dataclass
class Bins:
    """Ascending cut values per column; a value's bin is the number of cuts below it."""

    cuts: list[np.ndarray]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts], dtype=np.int64)

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, dtype=np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, rows[:, j], side="left")
        return out


def fit_bins(df: DataFrame, features: str, numeric: int, size: int, max_bins: int = MAX_BINS) -> Bins:
    """Cuts at approximate quantiles of the first `numeric` positions; the others are zero or not.

    Bins only say which thresholds are tried; one pass.
    """
    x = vector_to_array(features)
    return bins_of(df, [F.get(x, F.lit(j)) for j in range(numeric)], size, max_bins)


def bins_of(df: DataFrame, numbers: Sequence[Column], size: int, max_bins: int = MAX_BINS, rows: str | None = None) -> Bins:
    """The bins of `size` positions, of which the first are the given numbers; `rows` says how many rows each stands for.

    A task keeps at most 2 * POINTS values of BUFFER rows and their numbers of rows, so a rank
    is wrong by less than a POINTS-th of all rows; up to POINTS distinct values are exact.
    """
    cuts, numeric = [np.zeros(1)] * size, len(numbers)
    if not numeric:
        return Bins(cuts)
    picked = df.select(*[c.cast("double").alias(f"x{j}") for j, c in enumerate(numbers)], (F.col(rows) if rows else F.lit(1)).cast("double").alias("n"))

    def points(held: list[pa.RecordBatch]) -> Generator:
        n = np.concatenate([b.column("n").to_numpy() for b in held])
        for j in range(numeric):
            x, w = _thinned(np.concatenate([b.column(f"x{j}").to_numpy(zero_copy_only=False) for b in held]), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, dtype=np.int32)), pa.array(x), pa.array(w)], ["c", "v", "n"])

    def summed(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER:
                yield from points(held)
                held, size = [], 0
        if size:
            yield from points(held)

    counted = picked.mapInArrow(summed, "c int, v double, n double").groupBy("c", "v").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("c")
    ranked = counted.select("c", "v", "n", F.sum("n").over(every).alias("all"), F.sum("n").over(every.orderBy("v")).alias("upto"))
    # how many of the shares 0, 1 / max_bins, ... are reached with this value, and before it
    reached = lambda rank: F.least(F.floor(rank * max_bins / F.col("all")), F.lit(max_bins - 1))
    before = F.col("upto") - F.col("n")
    found = ranked.where((before == 0) | (reached(F.col("upto")) > reached(before))).select("c", "v").collect()
    for j in range(numeric):
        cuts[j] = np.unique(np.array([r["v"] for r in found if r["c"] == j] or [0.0], dtype=np.float64))[:max_bins]
    return Bins(cuts)


def _thinned(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values that stand for themselves and smaller ones, and for how many rows each stands."""
    known = ~np.isnan(x)
    values, place = np.unique(x[known], return_inverse=True)
    own = np.bincount(place, n[known], minlength=len(values))
    upto = np.cumsum(own)
    if len(values) > POINTS:
        share = upto[-1] / POINTS
        step = np.floor(upto / share)
        kept = np.flatnonzero(np.append(step[1:] != step[:-1], True) | (own >= share))
        values, upto = values[kept], upto[kept]
    return values, np.diff(upto, prepend=0.0)


@dataclass
class Block:
    """Cells: bins, rows and sums of targets per model, the class, and a number that samples are drawn by."""

    x: np.ndarray
    rows: np.ndarray
    sums: np.ndarray
    label: np.ndarray
    ident: np.ndarray


def cells_of(df: DataFrame, features: str, label: str, classes: int, uses: Sequence[Any], bins: Bins, rows: str | None = None) -> DataFrame:
    """Stored (x, label, rows, sums): one row per distinct bins (and class); `uses` are the row filters of the models,
    `rows` says how many rows each stands for."""
    kinds = "x binary, label int, y double, n double, " + ", ".join(f"u{m} boolean" for m in range(len(uses)))
    picked = df.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(rows) if rows else F.lit(1)).cast("double").alias("n"),
        *[F.coalesce(u, F.lit(False)).alias(f"u{m}") for m, u in enumerate(uses)],
    )
    width, names = len(bins.cuts), ["x", "label", "y", "n", *[f"u{m}" for m in range(len(uses))]]

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                binned = bins.of(batch.column("x").flatten().to_numpy().reshape(-1, width))
                y = batch.column("y")
                known = y.cast(pa.int32()) if classes else pa.array(np.zeros(len(binned), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in binned], pa.binary()), known, y, *batch.columns[2:]],
                    names,
                )

    counted = picked.mapInArrow(cut, kinds).groupBy("x", "label").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col(f"u{m}"), F.col("n"))), F.lit(0.0)) for m in range(len(uses))]).alias("rows"),
        F.array(*[F.coalesce(F.sum(F.when(F.col(f"u{m}"), F.col("y") * F.col("n"))), F.lit(0.0)) for m in range(len(uses))]).alias("sums"),
    )
    return materialise(counted, "cells")


def as_block(rows: pd.DataFrame | Sequence[Any], width: int) -> Block:
    rows = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame([tuple(r) for r in rows], columns=["x", "label", "rows", "sums"])
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), dtype=np.uint8).reshape(-1, width)
    label = rows["label"].to_numpy(dtype=np.int64)
    ident = np.full(len(x), 0x9E3779B97F4A7C15, dtype=np.uint64) + label.astype(np.uint64)
    for j in range(width):
        ident = _mixed(ident ^ x[:, j].astype(np.uint64))
    # the same order wherever the cells come from
    order = np.lexsort((label, ident))
    stack = lambda name: np.array(rows[name].tolist(), dtype=np.float64).reshape(len(x), -1)[order]
    return Block(x[order], stack("rows"), stack("sums"), label[order], ident[order])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(ident: np.ndarray, seed: int) -> np.ndarray:
    return (_mixed(ident + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) / float(1 << 53)


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes as arrays; column -1 is a leaf."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[Any] = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def compact(self) -> Tree:
        """The same as small arrays; such a tree grows no more."""
        kinds = (np.int32, np.uint8, np.int32, np.int32, np.float64, np.float32)
        return Tree(*[np.array(v, dtype=k) for v, k in zip((self.column, self.cut, self.left, self.right, self.value, self.gain), kinds)])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, dtype=np.int64) for v in (self.column, self.cut, self.left, self.right))

    def places(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of bins."""
        column, cut, left, _ = self.arrays()
        at = np.zeros(len(x), dtype=np.int64) if at is None else at
        flat, inner = x.reshape(-1), column >= 0
        open_rows = np.flatnonzero(inner.take(at))
        node, start = at[open_rows], open_rows * x.shape[1]
        while len(open_rows):
            # the right child comes after the left one
            node = left.take(node) + (flat.take(start + column.take(node)) > cut.take(node))
            going = inner.take(node)
            if not going.all():
                ended = ~going
                at[open_rows[ended]] = node[ended]
                open_rows, node, start = open_rows[going], node[going], start[going]
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value, dtype=np.float64)[self.places(x)]

    def split(self, node: int, column: int, cut: int, gain: float) -> tuple[int, int]:
        first = len(self.column)
        for _ in range(2):
            self.column.append(-1), self.cut.append(0), self.left.append(0), self.right.append(0), self.value.append(None), self.gain.append(0.0)
        self.column[node], self.cut[node], self.left[node], self.right[node], self.gain[node] = column, cut, first, first + 1, gain
        return first, first + 1

    def graft(self, node: int, other: Tree) -> None:
        """Puts another tree in the place of a leaf."""
        base = len(self.column) - 1
        move = lambda k: node if k == 0 else base + k
        for k in range(len(other.column)):
            cells = (other.column[k], other.cut[k], move(other.left[k]), move(other.right[k]), other.value[k], other.gain[k])
            for name, cell in zip(("column", "cut", "left", "right", "value", "gain"), cells):
                if k:
                    getattr(self, name).append(cell)
                else:
                    getattr(self, name)[node] = cell


@dataclass(frozen=True)
class Growth:
    """How a tree grows; `columns` is the share of columns per tree, `per_node` the number drawn for each node."""

    depth: int = 6
    leaves: int = 1 << 30
    penalty: float = 1.0
    least_hessian: float = 1.0
    least_rows: float = 0.0
    columns: float = 1.0
    per_node: int = 0


Histogram = tuple[np.ndarray, np.ndarray, np.ndarray]  # per node: gradients (outputs), Hessians, rows, by column and bin


def _best_splits(found: Histogram, offsets: np.ndarray, growth: Growth, allowed: np.ndarray, keys: list[int]) -> list[tuple | None]:
    """Per node (gain, column, cut, sums of the left side, sums of the right side) of the best split, or nothing."""
    g, h, n = found  # (nodes, outputs, bins), (nodes, bins), (nodes, bins)
    nodes, outputs, total = g.shape
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def sides(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.cumsum(a, axis=-1)
        before = np.concatenate([np.zeros((*a.shape[:-1], 1)), run], axis=-1)[..., offsets[:-1]]
        left = run - before[..., owner]
        whole = (run[..., offsets[1:] - 1] - before)[..., owner]
        return left, whole - left

    gl, gr = sides(g)
    hl, hr = sides(h)
    nl, nr = sides(n)
    lam = growth.penalty
    score = lambda a, b: (a * a).sum(axis=1) / np.maximum(b + lam, TINY)
    gain = score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)
    fits = (np.minimum(hl, hr) >= max(growth.least_hessian, TINY)) & (np.minimum(nl, nr) >= max(growth.least_rows, 0.5))
    fits[:, offsets[1:] - 1] = False  # nothing lies above the last bin
    size = np.abs(score(gl + gr, hl + hr)) + 1.0
    gain = np.where(fits & (gain > 1e-10 * size), gain, -np.inf)
    everything = gain
    if not allowed.all():
        gain = np.where(allowed[owner], gain, -np.inf)
    if growth.per_node:
        width = len(offsets) - 1
        ident = np.array(keys, dtype=np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
        drawn = np.argsort(np.argsort(_uniform(ident, 77), axis=1), axis=1) < growth.per_node
        chosen = np.where(drawn[:, owner], gain, -np.inf)
        # a node without a split on the drawn columns tries the others
        gain = np.where(np.isfinite(chosen.max(axis=1))[:, None], chosen, everything)
    # of splits that are as good the first counts, whatever the order in which sums were added
    most = np.maximum(gain.max(axis=1, keepdims=True), TINY)
    at = np.round(np.where(np.isfinite(gain), gain / most, -1.0), 9).argmax(axis=1)
    out: list[tuple | None] = []
    for k, b in enumerate(at):
        if not np.isfinite(gain[k, b]):
            out.append(None)
            continue
        c = int(owner[b])
        out.append((float(gain[k, b]), c, int(b - offsets[c]), (gl[k, :, b], hl[k, b], nl[k, b]), (gr[k, :, b], hr[k, b], nr[k, b])))
    return out


def grow(offsets: np.ndarray, growth: Growth, leaf: Callable, seed: int, closed: Callable | None = None) -> Generator:
    """Grows one tree: yields (tree, nodes), is sent their histograms, returns the tree.

    Splits are chosen by gain among the open leaves until `leaves` are reached; what
    lies below a chosen node is looked at in the next step.  `closed` names nodes, by
    their number of cells, that somebody else finishes.
    """
    tree = Tree()
    width = len(offsets) - 1
    allowed = np.ones(width, dtype=bool)
    if growth.columns < 1:
        allowed = np.argsort(np.argsort(_uniform(np.arange(width, dtype=np.uint64), seed))) < max(1, round(growth.columns * width))
    level, sums, best = {0: 0}, {}, {}
    wanted = [0]
    made: dict[int, tuple[int, int]] = {}
    left_over: list[int] = []
    while wanted:
        found, found_nodes = (yield tree, wanted), wanted
        for k, node in enumerate(wanted):
            if node not in sums:  # the root
                one = slice(offsets[0], offsets[1])
                sums[node] = (found[0][k][:, one].sum(axis=1), found[1][k][one].sum(), found[2][k][one].sum())
        for node, split in zip(wanted, _best_splits(found[:3], offsets, growth, allowed, [seed * 1_000_003 + n + 1 for n in wanted])):
            best[node] = split
        if closed is not None:
            small = [n for n, cells in zip(wanted, found[3]) if best[n] is not None and closed(cells)]
            left_over += small
            for n in small:
                best[n] = None
        if growth.leaves >= 1 << 30:  # every split is made
            wanted = []
            for node in (n for n in found_nodes if best[n] is not None):
                gain, column, cut, low, high = best[node]
                for child, part in zip(tree.split(node, column, cut, gain), (low, high)):
                    sums[child], level[child] = part, level[node] + 1
                    if level[child] < growth.depth:
                        wanted.append(child)
            continue
        # the order of opening, as far as it is known
        queue, count, wanted = [0], 1, []
        while queue and count < growth.leaves:
            ready = [n for n in queue if best.get(n) is not None]
            if not ready:
                break
            node = max(ready, key=lambda n: (best[n][0], -n))
            queue.remove(node)
            count += 1
            if node not in made:
                gain, column, cut, low, high = best[node]
                made[node] = tree.split(node, column, cut, gain)
                for child, part in zip(made[node], (low, high)):
                    sums[child], level[child] = part, level[node] + 1
                    if level[child] >= growth.depth:
                        best[child] = None
            for child in made[node]:
                if child not in best:
                    wanted.append(child)
                queue.append(child)
    # keep what the order of opening chose
    queue, count, kept = [0] if growth.leaves < 1 << 30 else [], 1, set()
    while queue and count < growth.leaves:
        ready = [n for n in queue if best.get(n) is not None]
        if not ready:
            break
        node = max(ready, key=lambda n: (best[n][0], -n))
        queue.remove(node)
        kept.add(node)
        queue += made[node]
        count += 1
    for node in made:
        if node not in kept:
            tree.column[node], tree.gain[node] = -1, 0.0
    for node in range(len(tree.column)):
        tree.value[node] = leaf(*sums[node])
    return tree, left_over


def run_together(growths: list[Generator], ask: Callable[[list[tuple]], list]) -> list:
    """Runs growths in step: one call of `ask` answers all that are open."""
    results: list[Any] = [None] * len(growths)
    asked = {k: next(g) for k, g in enumerate(growths)}
    while asked:
        answers = ask([(k, *asked[k]) for k in asked])
        following = {}
        for k, answer in zip(list(asked), answers):
            try:
                following[k] = growths[k].send(answer)
            except StopIteration as done:
                results[k] = done.value
        asked = following
    return results


def node_histograms(block: Block, at: np.ndarray, nodes: list[int], offsets: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple:
    """Sums per node, column and bin of the cells that lie at the nodes, and the cells per node."""
    place = np.full(int(max(at.max(initial=0), max(nodes))) + 1, -1, dtype=np.int64)
    place[nodes] = np.arange(len(nodes))
    slot = place[at]
    held = np.flatnonzero((slot >= 0) & (n > 0))
    slot, total = slot[held], int(offsets[-1])
    shape = (len(nodes), total)
    out_g, out_h, out_n = np.zeros((len(nodes), g.shape[1], total)), np.zeros(shape), np.zeros(shape)
    for j in range(len(offsets) - 1):
        size = int(offsets[j + 1] - offsets[j])
        key = slot * size + block.x[held, j]
        columns = slice(int(offsets[j]), int(offsets[j + 1]))
        summed = lambda w: np.bincount(key, w, minlength=len(nodes) * size).reshape(len(nodes), size)
        out_h[:, columns], out_n[:, columns] = summed(h[held]), summed(n[held])
        for k in range(g.shape[1]):
            out_g[:, k, columns] = summed(g[held, k])
    return out_g, out_h, out_n, np.bincount(slot, minlength=len(nodes))


# ---------------------------------------------------------------- boosting


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    growth: Growth
    row_share: float = 1.0
    by_rows: bool = False  # splits by rows and residuals, only leaves by Hessians
    balanced: bool = False
    seed: int = 42


@dataclass
class Boosted:
    """Margins are base + rate * the sum of the trees' values, one list of trees per round."""

    base: np.ndarray
    rate: float
    rounds: list[list[Tree]]

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.tile(self.base if not first else np.zeros_like(self.base), (len(x), 1))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.values(x)
        return out


def _outputs(classes: int) -> int:
    return classes if classes > 2 else 1


def _class_weights(counts: np.ndarray, balanced: bool) -> np.ndarray:
    if not balanced:
        return np.ones(len(counts))
    return np.where(counts > 0, counts.sum() / (max(1, (counts > 0).sum()) * np.maximum(counts, 1)), 1.0)


def _base(totals: dict, classes: int, balanced: bool) -> np.ndarray:
    """The constant that fits best: log odds, log shares or the mean."""
    if not classes:
        return np.array([totals["sum"] / max(totals["rows"], 1.0)])
    counts = totals["classes"] * _class_weights(totals["classes"], balanced)
    share = np.clip(counts / max(counts.sum(), 1.0), 1e-6, 1 - 1e-6)
    return np.log(share) if classes > 2 else np.array([np.log(share[1] / share[0])]) if classes == 2 else np.zeros(1)


def _slopes(block: Block, model: int, margins: np.ndarray, classes: int, weights: np.ndarray, setting: Boosting, turn: int) -> tuple:
    """Negative gradients, Hessians and rows of each cell, of the rows drawn this round."""
    rows = block.rows[:, model]
    drawn = rows if setting.row_share >= 1 else np.floor(rows * setting.row_share + _uniform(block.ident, setting.seed * 7919 + turn))
    if not classes:
        mean = block.sums[:, model] / np.maximum(rows, 1.0)
        return drawn[:, None] * (mean[:, None] - margins), drawn[:, None].repeat(1, axis=1), drawn
    weighted = drawn * weights[block.label]
    if classes <= 2:
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -40, 40)))
        return (weighted * ((block.label == 1) - p))[:, None], (weighted * p * (1 - p))[:, None], drawn
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    truth = block.label[:, None] == np.arange(classes)[None, :]
    return weighted[:, None] * (truth - p), weighted[:, None] * np.maximum(p * (1 - p), 1e-16) * classes / (classes - 1), drawn


def _totals(block: Block, model: int, classes: int) -> dict:
    rows = block.rows[:, model]
    return {
        "rows": rows.sum(), "sum": block.sums[:, model].sum(), "cells": len(rows),
        "classes": np.bincount(block.label, rows, minlength=max(classes, 1)) if classes else np.zeros(1),
    }


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def _leaf_of(penalty: float) -> Callable:
    return lambda g, h, n: float(g[0] / max(h + penalty, TINY))


def boost(block: Block, model: int, classes: int, offsets: np.ndarray, setting: Boosting) -> Boosted:
    """One model from cells that fit a task."""
    totals = _totals(block, model, classes)
    weights = _class_weights(totals["classes"], setting.balanced)
    out = Boosted(_base(totals, classes, setting.balanced), setting.rate, [])
    margins = out.margins(block.x)
    for turn in range(setting.rounds):
        g, h, n = _slopes(block, model, margins, classes, weights, setting, turn)
        at = [np.zeros(len(block.x), dtype=np.int64) for _ in range(_outputs(classes))]
        growths = [grow(offsets, setting.growth, _leaf_of(setting.growth.penalty), setting.seed * 131 + turn * 17 + k) for k in range(_outputs(classes))]

        def ask(asked: list) -> list:
            found = []
            for k, tree, nodes in asked:
                at[k] = tree.places(block.x, at[k])
                found.append(node_histograms(block, at[k], nodes, offsets, g[:, k : k + 1], n if setting.by_rows else h[:, k], n))
            return found

        trees = [t for t, _ in run_together(growths, ask)]
        if setting.by_rows:
            for k, tree in enumerate(trees):
                place = tree.places(block.x)
                sums = [np.bincount(place, w, minlength=len(tree.column)) for w in (g[:, k], h[:, k])]
                tree.value = (sums[0] / np.maximum(sums[1], TINY)).tolist()
        out.rounds.append(trees)
        for k, tree in enumerate(trees):
            margins[:, k] += setting.rate * tree.values(block.x)
    return out


def boost_by_jobs(cells: DataFrame, models: int, classes: int, offsets: np.ndarray, setting: Boosting) -> list[Boosted]:
    """All models in step; each step of growth is one Spark job over blocks of cells.

    What reaches the driver is one histogram per open node, not a cell.  The margins
    of a block follow from the trees alone, so a lost block is computed anew; every
    KEPT_ROUNDS rounds they are kept, so that a job walks through few trees.
    """
    width = len(offsets) - 1
    blocks = cells.rdd.mapPartitions(lambda rows: _blocks(rows, width)).persist(StorageLevel.MEMORY_AND_DISK)
    outputs = _outputs(classes)
    try:
        totals = blocks.map(lambda b: [_totals(b, m, classes) for m in range(models)]).treeReduce(lambda a, b: [_added(x, y) for x, y in zip(a, b)])
        weights = [_class_weights(t["classes"], setting.balanced) for t in totals]
        fitted = [Boosted(_base(t, classes, setting.balanced), setting.rate, []) for t in totals]
        kept, kept_rounds = None, 0
        for turn in range(setting.rounds):
            if turn % KEPT_ROUNDS == 0:
                state = pickle.loads(pickle.dumps(fitted))
                following = blocks.map(lambda b, s=state: (b, [f.margins(b.x) for f in s])).persist(StorageLevel.MEMORY_AND_DISK)
                following.count()
                if kept is not None:
                    kept.unpersist()
                kept, kept_rounds = following, turn
            recent = [Boosted(f.base, f.rate, f.rounds[kept_rounds:]) for f in fitted]
            keys = [(m, k) for m in range(models) for k in range(outputs)]

            def slopes(held: tuple, wanted: set, recent=recent, turn=turn) -> dict:
                block, margins = held
                out = {}
                for m in wanted:
                    now = margins[m] + Boosted(np.zeros(outputs), recent[m].rate, recent[m].rounds).margins(block.x)
                    out[m] = _slopes(block, m, now, classes, weights[m], setting, turn)
                return out

            def ask(asked: list, slopes=slopes, keys=keys) -> list:
                # trees travel as they are now
                asked = pickle.loads(pickle.dumps(asked))

                def one(held: tuple) -> list:
                    found, by_model = [], slopes(held, {keys[k][0] for k, _, _ in asked})
                    for k, tree, nodes in asked:
                        m, out = keys[k]
                        g, h, n = by_model[m]
                        found.append(node_histograms(held[0], tree.places(held[0].x), nodes, offsets, g[:, out : out + 1], n if setting.by_rows else h[:, out], n))
                    return found

                return kept.map(one).treeReduce(lambda a, b: [tuple(x + y for x, y in zip(p, q)) for p, q in zip(a, b)])

            growths = [grow(offsets, setting.growth, _leaf_of(setting.growth.penalty), setting.seed * 131 + turn * 17 + k) for _, k in keys]
            trees = [t for t, _ in run_together(growths, ask)]
            if setting.by_rows:
                def leaves(held: tuple, trees=pickle.loads(pickle.dumps(trees)), slopes=slopes, keys=keys) -> list:
                    by_model = slopes(held, set(range(models)))
                    out = []
                    for (m, k), tree in zip(keys, trees):
                        place = tree.places(held[0].x)
                        out.append(np.stack([np.bincount(place, w, minlength=len(tree.column)) for w in (by_model[m][0][:, k], by_model[m][1][:, k])]))
                    return out

                for tree, sums in zip(trees, kept.map(leaves).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])):
                    tree.value = (sums[0] / np.maximum(sums[1], TINY)).tolist()
            for m in range(models):
                fitted[m].rounds.append(trees[m * outputs : (m + 1) * outputs])
        if kept is not None:
            kept.unpersist()
        return fitted
    finally:
        blocks.unpersist()


def _blocks(rows, width: int):
    held = list(rows)
    if held:
        yield as_block(held, width)


# ---------------------------------------------------------------- forests


@dataclass(frozen=True)
class Forest:
    trees: int
    depth: int = 1 << 30
    balanced: bool = False
    per_node: int = 0
    seed: int = 42


def _drawn(block: Block, model: int, seed: int) -> np.ndarray:
    """Bootstrap: each row counts as often as a Poisson draw of mean 1 says; a cell draws for all of its rows."""
    rows = block.rows[:, model]
    u = _uniform(block.ident, seed)
    few = rows <= 30
    out = np.maximum(0.0, np.floor(rows + np.sqrt(rows) * _normal(u) + 0.5))
    # the Poisson distribution of a small mean, by inversion
    mean, at = rows[few], u[few]
    term = np.exp(-mean)
    upto, k, found = term.copy(), np.zeros(len(mean)), np.full(len(mean), -1.0)
    for step in range(120):
        hit = (found < 0) & (at < upto)
        found[hit] = step
        term = term * mean / (step + 1)
        upto += term
        if (found >= 0).all():
            break
    out[few] = np.maximum(found, 0)
    return out


def _normal(u: np.ndarray) -> np.ndarray:
    """A number with about normal distribution for each uniform one (logistic approximation)."""
    u = np.clip(u, 1e-12, 1 - 1e-12)
    return np.log(u / (1 - u)) * 0.5513


def _forest_sums(block: Block, model: int, classes: int, weights: np.ndarray, drawn: np.ndarray) -> tuple:
    if classes:
        h = drawn * weights[block.label]
        return h[:, None] * (block.label[:, None] == np.arange(classes)[None, :]), h, drawn
    mean = block.sums[:, model] / np.maximum(block.rows[:, model], 1.0)
    return (drawn * mean)[:, None], drawn, drawn


def _share(g: np.ndarray, h: float, n: float) -> list[float]:
    return (g / max(h, TINY)).tolist()


def _forest_growth(setting: Forest, depth: int | None = None) -> Growth:
    return Growth(depth=setting.depth if depth is None else depth, penalty=0.0, least_hessian=0.0, per_node=setting.per_node)


def _finished(block: Block, g: np.ndarray, h: np.ndarray, n: np.ndarray, offsets: np.ndarray, growth: Growth, seed: int) -> Tree:
    """A tree to its end, level by level, in pieces of bounded histograms."""
    at = np.zeros(len(block.x), dtype=np.int64)
    step = max(1, HISTOGRAM_CELLS // (int(offsets[-1]) * (g.shape[1] + 2)))
    growing = grow(offsets, growth, _share, seed)
    tree, nodes = next(growing)
    while True:
        at = tree.places(block.x, at)
        parts = [node_histograms(block, at, nodes[k : k + step], offsets, g, h, n) for k in range(0, len(nodes), step)]
        try:
            tree, nodes = growing.send(tuple(np.concatenate(p) for p in zip(*parts)))
        except StopIteration as done:
            return done.value[0]


def forest_tree(block: Block, model: int, classes: int, offsets: np.ndarray, setting: Forest, number: int) -> Tree:
    """One tree from cells that fit a task."""
    weights = _class_weights(_totals(block, model, classes)["classes"], setting.balanced)
    sums = _forest_sums(block, model, classes, weights, _drawn(block, model, setting.seed + number))
    held = np.flatnonzero(sums[2] > 0)
    part = Block(block.x[held], block.rows[held], block.sums[held], block.label[held], block.ident[held])
    return _finished(part, *[s[held] for s in sums], offsets, _forest_growth(setting), setting.seed + number)


def forests_by_jobs(cells: DataFrame, models: int, classes: int, offsets: np.ndarray, setting: Forest, in_task: int, at_once: int = 50) -> list[list[Tree]]:
    """All trees of all models, `at_once` of them in step; nodes of at most `in_task` cells are finished as groups of their cells."""
    spark, width = cells.sparkSession, len(offsets) - 1
    blocks = cells.rdd.mapPartitions(lambda rows: _blocks(rows, width)).persist(StorageLevel.MEMORY_AND_DISK)
    out: list[list[Tree]] = [[] for _ in range(models)]
    try:
        totals = blocks.map(lambda b: [_totals(b, m, classes) for m in range(models)]).treeReduce(lambda a, b: [_added(x, y) for x, y in zip(a, b)])
        weights = [_class_weights(t["classes"], setting.balanced) for t in totals]
        every = [(m, number) for m in range(models) for number in range(setting.trees)]
        for first in range(0, len(every), at_once):
            keys = every[first : first + at_once]

            def sums(block: Block, k: int, keys=keys) -> tuple:
                m, number = keys[k]
                return _forest_sums(block, m, classes, weights[m], _drawn(block, m, setting.seed + number))

            def ask(asked: list, sums=sums) -> list:
                asked = pickle.loads(pickle.dumps(asked))
                one = lambda block: [node_histograms(block, tree.places(block.x), nodes, offsets, *sums(block, k)) for k, tree, nodes in asked]
                return blocks.map(one).treeReduce(lambda a, b: [tuple(x + y for x, y in zip(p, q)) for p, q in zip(a, b)])

            growths = [grow(offsets, _forest_growth(setting), _share, setting.seed + number, lambda n: n <= in_task) for _, number in keys]
            grown = run_together(growths, ask)
            shared = spark.sparkContext.broadcast(pickle.dumps(grown))

            def dealt(block: Block, sums=sums, shared=shared):
                for k, (tree, small) in enumerate(pickle.loads(shared.value)):
                    if small:
                        g, h, n = sums(block, k)
                        at = tree.places(block.x)
                        for c in np.flatnonzero(np.isin(at, small) & (n > 0)):
                            yield k, int(at[c]), bytearray(block.x[c].tobytes()), g[c].tolist(), float(h[c]), float(n[c]), int(block.ident[c].view(np.int64))

            def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values("ident")
                x = np.frombuffer(b"".join(map(bytes, rows["x"])), dtype=np.uint8).reshape(-1, width)
                block = Block(x, x[:, :0], x[:, :0], x[:, 0], x[:, 0])
                g, h, n = np.array(rows["g"].tolist(), dtype=np.float64), rows["h"].to_numpy(), rows["n"].to_numpy()
                below = _finished(block, g, h, n, offsets, _forest_growth(setting), setting.seed + keys[key[0]][1] * 31 + key[1])
                return pd.DataFrame({"k": [key[0]], "node": [key[1]], "tree": [pickle.dumps(below)]})

            rows = spark.createDataFrame(blocks.flatMap(dealt), "k int, node int, x binary, g array<double>, h double, n double, ident long")
            for r in rows.groupBy("k", "node").applyInPandas(finish, "k int, node int, tree binary").collect():
                grown[r["k"]][0].graft(r["node"], pickle.loads(bytes(r["tree"])))
            for (m, _), (tree, _) in zip(keys, grown):
                out[m].append(tree.compact())
        return out
    finally:
        blocks.unpersist()


# ---------------------------------------------------------------- fitted models


@dataclass
class BoostedTrees:
    bins: Bins
    classes: int
    fitted: Boosted

    @property
    def trees(self) -> list[Tree]:
        return [t for trees in self.fitted.rounds for t in trees]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or numbers in one column."""
        margins = self.fitted.margins(self.bins.of(rows))
        if not self.classes:
            return margins
        if self.classes > 2:
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        if self.classes == 1:
            return np.ones((len(rows), 1))
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -40, 40)))
        return np.stack([1 - p, p], axis=1)


@dataclass
class RandomForestTrees:
    bins: Bins
    classes: int
    trees: list[Tree]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = self.bins.of(rows)
        total = sum(t.values(x) for t in self.trees)
        return total / len(self.trees)


def importances(trees: Sequence[Tree], size: int) -> np.ndarray:
    """The share of the gains that each column brought."""
    out = np.zeros(size)
    for t in trees:
        column, gain = np.asarray(t.column), np.asarray(t.gain, dtype=np.float64)
        inner = column >= 0
        if inner.any():
            found = np.bincount(column[inner], gain[inner], minlength=size)
            out += found / max(found.sum(), TINY)
    return out / max(out.sum(), TINY) if out.any() else out


def scored(df: DataFrame, features: str, model: Any, name: str) -> DataFrame:
    """Append class probabilities (array) or the predicted number."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.scores(np.stack(rows.to_numpy())))) if len(rows) else pd.Series([], dtype=object)

    found = score(vector_to_array(features))
    return df.withColumn(name, found if model.classes else F.get(found, F.lit(0)))


def fit_all(
    df: DataFrame, features: str, label: str, numeric: int, size: int, classes: int, uses: Sequence[Any], setting: Boosting | Forest,
    task_bytes: int | None = None, bins: Bins | None = None, rows: str | None = None,
) -> list[BoostedTrees | RandomForestTrees]:
    """One model per row filter in `uses`, all from the same cells.

    Cells of at most `task_bytes` together are sent to every task, which then fits a
    model (or a tree of a forest) of its own; else the steps are Spark jobs.
    """
    spark = df.sparkSession
    bins = fit_bins(df.where(uses[0]), features, numeric, size) if bins is None else bins
    cells = cells_of(df, features, label, classes, uses, bins, rows)
    offsets = np.concatenate([[0], np.cumsum(bins.sizes)])
    per_cell = size + 16 * len(uses) + 24
    task_bytes = TASK_BYTES if task_bytes is None else task_bytes
    small = cells.limit(task_bytes // per_cell + 1).count() * per_cell <= task_bytes
    models = len(uses)
    if not small:
        if isinstance(setting, Boosting):
            return [BoostedTrees(bins, classes, f) for f in boost_by_jobs(cells, models, classes, offsets, setting)]
        in_task = max(1, task_bytes // per_cell)
        return [RandomForestTrees(bins, classes, t) for t in forests_by_jobs(cells, models, classes, offsets, setting, in_task)]
    shared = spark.sparkContext.broadcast(as_block(cells.toPandas(), size))
    trees = 1 if isinstance(setting, Boosting) else setting.trees
    work = spark.createDataFrame([(m, t) for t in range(trees) for m in range(models)], "model int, tree int")
    tasks = min(models * trees, 4 * spark.sparkContext.defaultParallelism)

    def fit(batches):
        for batch in batches:
            found = []
            for model, tree in zip(batch["model"], batch["tree"]):
                if isinstance(setting, Boosting):
                    one = boost(shared.value, int(model), classes, offsets, setting)
                    one.rounds = [[t.compact() for t in r] for r in one.rounds]
                else:
                    one = forest_tree(shared.value, int(model), classes, offsets, setting, int(tree)).compact()
                found.append(pickle.dumps(one))
            yield pd.DataFrame({"model": batch["model"], "tree": batch["tree"], "fitted": found})

    grown = work.repartition(tasks, "model", "tree").mapInPandas(fit, "model int, tree int, fitted binary").collect()
    by_model: list[list] = [[] for _ in range(models)]
    for r in sorted(grown, key=lambda r: (r["model"], r["tree"])):
        by_model[r["model"]].append(pickle.loads(bytes(r["fitted"])))
    if isinstance(setting, Boosting):
        return [BoostedTrees(bins, classes, found[0]) for found in by_model]
    return [RandomForestTrees(bins, classes, found) for found in by_model]
