"""Regression trees, forests and boosted trees, grown level by level on Spark.

A row of a tree table has an id, its features as an array, its label and whether it trains the
trees. Rows numbered below 0 get no prediction. Rows that do not train take part with weight 0: they walk down with the others, so a table is
predicted while the trees grow, and trees of any size never pass through the driver.

Labels are whole multiples of `unit`, so sums do not depend on the order of rows, and the same table gives the same
trees in every run. A split is exact: all values of all features are tried, by running sums over sorted
values. Ties go to the first feature, then to the smallest value; the threshold lies midway to the next value.

Nodes with more than `local_rows` rows are split by Spark, all nodes of all trees at once. Their rows stay where they are, in
blocks that are written once for all trees, and walk down the splits found so far. A level adds up one histogram of coarse cells
a node and feature; values are only compared in cells that may hold the best cut, so what moves is a small part of the rows and
no task has to sort a whole feature. Smaller nodes are bounded: their rows move once, to one task each, which finishes them in numpy.
A table that is small itself is sent once to each group of trees.

A forest draws its rows by weights from a hash of (row, tree), Poisson with mean 1.
Boosting is of second order for squared error: with gradient sums G and hessian sums H (the number of rows) a leaf
weighs G / (H + lambda), a split gains the difference of G^2 / (H + lambda), and must gain more than gamma.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areastats.sources import discard, materialise

#: Rows that one task may grow a tree on.
LOCAL_ROWS = 65536
#: Coarse cells of a feature's values in the histograms of large nodes.
CELLS = 256
#: Rows of a block.
BLOCK = 16384
#: Label sums are kept as multiples of 2^SHIFT and a rest.
SHIFT = 20
#: Rounds of boosting after which predictions are written.
KEPT_ROUNDS = 10
#: Depth of boosted trees that the driver holds.
HELD_DEPTH = 10
#: Bytes of histograms that the driver adds up itself.
COLLECTED = 2**24
#: Groups of trees that a small table is sent to.
GROUPS = 32
#: Rows of small nodes that are finished at once; what moved for them is removed before the next ones.
WAVE = 2**24
#: Rows with neighbouring numbers whose predictions are added up together.
SPAN = 2**16
# Distribution function of the Poisson distribution with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


@dataclass(frozen=True)
class Growth:
    """How trees grow. Without `max_depth` until leaves are pure; `gamma` None splits whatever can be split."""

    trees: int = 1
    bootstrap: bool = False
    max_depth: int | None = None
    reg_lambda: float = 0.0
    gamma: float | None = None
    min_child: float = 1.0
    #: Rounds and step of boosting; 0 rounds: trees are averaged.
    rounds: int = 0
    step: float = 0.3
    #: Cut points that boosting tries for each feature.
    bins: int = 256
    unit: float = 1e-6
    local_rows: int = LOCAL_ROWS


# -- one node's rows, in one task ---------------------------------------------


@dataclass
class Codes:
    """Features as numbers of their values, which ascend."""

    codes: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        found = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
        return cls(np.array([code for _, code in found], np.int32).reshape(x.shape[1], len(x)), [values for values, _ in found])


@dataclass
class Segments:
    """The rows that train, node by node; every feature's order has the same segments."""

    first: np.ndarray
    count: np.ndarray
    #: Weight and label sum of the nodes, and both with the number of the node for every place.
    n: np.ndarray
    total: np.ndarray
    node: np.ndarray
    n_all: np.ndarray
    s_all: np.ndarray
    n_before: np.ndarray

    @classmethod
    def of(cls, count: np.ndarray, n: np.ndarray, total: np.ndarray) -> Segments:
        node, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
        return cls(first, count, n, total, node, n[node], total[node], (np.cumsum(n) - n)[node])


def gain_of(n_left, s_left, n_all, s_all, growth: Growth) -> np.ndarray:
    n_right, s_right = n_all - n_left, s_all - s_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s_left * s_left / (n_left + growth.reg_lambda) + s_right * s_right / (n_right + growth.reg_lambda)
    return np.where((n_left >= growth.min_child) & (n_right >= max(growth.min_child, 1)), gain, -np.inf)


def best_sorted_cuts(code, both, at: Segments, growth: Growth):
    """For nodes that can be cut by one feature, the best cut: nodes, gains, code on the left, next code.

    Rows are in order of (node, code); `both` is their weight, and their weighted label as imaginary part: one sum for the two.
    """
    run = np.cumsum(both)
    s_run = run.imag.copy()
    s_left = s_run - np.repeat(np.append(0.0, s_run).take(at.first), at.count)
    n_left = run.real - at.n_before
    n_right, s_right = at.n_all - n_left, at.s_all - s_left
    # A cut lies between two values of a node.
    cut = np.empty(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=cut[:-1])
    cut[at.first + at.count - 1] = False
    if growth.min_child > 1:
        cut &= (n_left >= growth.min_child) & (n_right >= growth.min_child)
    s_left *= s_left
    s_right *= s_right
    if growth.reg_lambda:
        n_left += growth.reg_lambda
        n_right += growth.reg_lambda
    with np.errstate(divide="ignore", invalid="ignore"):
        s_left /= n_left
        s_right /= n_right
    s_left += s_right
    gain = np.where(cut, s_left, -np.inf)
    most = np.maximum.reduceat(gain, at.first)
    most[most == -np.inf] = np.nan
    pick = np.flatnonzero(gain == np.repeat(most, at.count))
    where = at.node.take(pick)
    one = np.append(True, where[1:] != where[:-1])[: len(where)]
    pick, where = pick[one], where[one]
    return where, gain[pick], code[pick], code[pick + 1]


def best_counted_cuts(code, n_codes: int, w, ws, at: Segments, growth: Growth):
    """The same for a feature of few values, from sums by (node, code)."""
    key, shape = at.node * n_codes + code, (len(at.count), n_codes)
    n = np.bincount(key, w, len(at.count) * n_codes).reshape(shape)
    s = np.bincount(key, ws, len(at.count) * n_codes).reshape(shape)
    gain = gain_of(np.cumsum(n, 1), np.cumsum(s, 1), at.n[:, None], at.total[:, None], growth)
    gain[n == 0] = -np.inf
    pick = np.argmax(gain, 1)
    where = np.flatnonzero(gain[np.arange(len(pick)), pick] > -np.inf)
    pick = pick[where]
    after = (n[where] > 0) & (np.arange(n_codes) > pick[:, None])
    return where, gain[where, pick], pick, np.argmax(after, 1)


def grow_here(coded: Codes, w: np.ndarray, s: np.ndarray, growth: Growth, depth: int = 0):
    """One tree on the given rows. Returns each row's leaf, leaf sums (n, s), and features and gains of the splits.

    Rows that train are kept sorted by each feature of many values: a split deals out the order of its node, it is not sorted again.
    """
    codes, sizes = coded.codes, [len(v) for v in coded.values]
    leaf = np.zeros(codes.shape[1], np.int64)
    rows, here = np.flatnonzero(w > 0), np.flatnonzero(w <= 0)
    if not len(rows):
        return leaf, np.zeros(1), np.zeros(1), (np.zeros(0, np.int64), np.zeros(0))
    # The rows that train by their number among these; the others only walk down.
    of, weight = [c.take(rows) for c in codes], w[rows].astype(float)
    label = s[rows]
    weighted = weight * label
    both = weight + 1j * weighted
    order: dict[int, np.ndarray] = {}
    own, count, node = np.arange(len(rows)), np.array([len(rows)]), np.zeros(len(here), np.int64)
    sums_n, sums_s, split_by, won, done = [], [], [], [], 0
    while True:
        first = np.cumsum(count) - count
        w_own, ws_own = weight.take(own), weighted.take(own)
        n, total = np.add.reduceat(w_own, first), np.add.reduceat(ws_own, first)
        open_ = np.ones(len(count), bool)
        if growth.gamma is None:
            y = label.take(own)
            open_ = np.maximum.reduceat(y, first) > np.minimum.reduceat(y, first)
        if growth.max_depth is not None and depth >= growth.max_depth:
            open_[:] = False
        best = np.full(len(count), -np.inf)
        feature, left, right = (np.zeros(len(count), np.int64) for _ in range(3))
        if open_.any():
            # Only nodes that are searched stay in order.
            searched, stay = np.flatnonzero(open_), np.repeat(open_, count)
            at, mine, w_mine, ws_mine = Segments.of(count[open_], n[open_], total[open_]), own[stay], w_own[stay], ws_own[stay]
            if len(mine) < len(own):
                order = {f: o[stay] for f, o in order.items()}
            for f, size in enumerate(sizes):
                if size < 2:
                    continue
                if f not in order and size * len(searched) <= len(mine):
                    found = best_counted_cuts(of[f].take(mine), size, w_mine, ws_mine, at, growth)
                else:
                    if f not in order:
                        order[f] = mine.take(np.argsort(at.node * size + of[f].take(mine), kind="stable"))
                    found = best_sorted_cuts(of[f].take(order[f]), both.take(order[f]), at, growth)
                where, gain, low, high = found
                where = searched[where]
                better = gain > best[where]
                where = where[better]
                best[where], feature[where], left[where], right[where] = gain[better], f, low[better], high[better]
        with np.errstate(divide="ignore", invalid="ignore"):
            win = best - total * total / (n + growth.reg_lambda)
        split = (best > -np.inf) & (True if growth.gamma is None else win > growth.gamma / growth.unit**2)
        split_by.append(feature[split])
        won.append(win[split])
        number = np.cumsum(~split) - 1 + done
        stay = np.repeat(split, count)
        leaf[rows[own[~stay]]] = np.repeat(number, count)[~stay]
        closed = ~split[node]
        leaf[here[closed]] = number[node[closed]]
        sums_n.append(n[~split])
        sums_s.append(total[~split])
        done += int((~split).sum())
        if not split.any():
            return leaf, np.concatenate(sums_n), np.concatenate(sums_s), (np.concatenate(split_by), np.concatenate(won))
        # The threshold lies midway to the next value that trains; rows that do not train may lie between.
        cut = np.zeros(len(count), np.int64)
        for f in np.unique(feature[split]).tolist():
            m, v = np.flatnonzero(split & (feature == f)), coded.values[f]
            cut[m] = np.minimum(np.searchsorted(v, (v[left[m]] + v[right[m]]) / 2, side="right"), right[m]) - 1
        child = 2 * (np.cumsum(split) - 1)
        here, node = here[~closed], node[~closed]
        node = child[node] + (codes[feature[node], here] > cut[node])
        own, to_right = own[stay], np.zeros(len(rows), bool)
        at_node = np.repeat(np.flatnonzero(split), count[split])
        to_right[own] = codes[feature.take(at_node), rows.take(own)] > cut.take(at_node)
        starts = np.cumsum(count[split]) - count[split]
        n_right = np.add.reduceat(to_right[own].astype(np.int64), starts)
        if open_.sum() > split.sum():
            kept = np.repeat(split[open_], count[open_])
            order = {f: o[kept] for f, o in order.items()}
        count = np.stack([count[split] - n_right, n_right], 1).reshape(-1)
        places = np.repeat(np.arange(len(count)) % 2 == 1, count)
        lefts, rights = np.flatnonzero(~places), np.flatnonzero(places)

        def dealt(o: np.ndarray) -> np.ndarray:
            goes, out = to_right.take(o), np.empty_like(o)  # noqa: B023
            out[rights] = o.compress(goes)  # noqa: B023
            out[lefts] = o.compress(~goes)  # noqa: B023
            return out

        own, order = dealt(own), {f: dealt(o) for f, o in order.items()}
        depth += 1


def weights_here(keys: Sequence[str], trains: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    if not growth.bootstrap:
        return trains.astype(np.int64)
    end, out = f"|{tree}".encode(), np.zeros(len(trains), np.int64)
    digests = b"".join([hashlib.md5(f"{k}".encode() + end).digest()[:4] for k, t in zip(keys, trains) if t])
    out[trains.astype(bool)] = np.searchsorted(POISSON, np.frombuffer(digests, ">u4") / 2**32, side="right")
    return out


def weight(key: Column, tree: Column, trains: Column, growth: Growth) -> Column:
    """The same weights as a column."""
    if not growth.bootstrap:
        return trains.cast("long")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", key, tree.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return F.when(trains, sum((draw >= p).cast("long") for p in POISSON)).otherwise(F.lit(0).cast("long"))


def boost_here(coded: Codes, trains: np.ndarray, y: np.ndarray, growth: Growth):
    """All rounds of boosting. Returns the predictions and the splits' features and gains."""
    w = trains.astype(np.int64)
    whole = np.rint(y / growth.unit)
    out = np.full(len(y), (whole * w).sum() / max(w.sum(), 1) * growth.unit)
    gains = [(np.zeros(0, np.int64), np.zeros(0))]
    for _ in range(growth.rounds):
        leaf, n, s, won = grow_here(coded, w, np.rint((y - out) / growth.unit), growth)
        out = out + growth.step * (s * growth.unit / (n + growth.reg_lambda))[leaf]
        gains.append(won)
    return out, tuple(map(np.concatenate, zip(*gains)))


# -- all large nodes of a level, where their rows lie -------------------------

#: A row's value is the sum over `n` trees; a feature's gain that of `n` splits of a tree.
OUT = "row long, tree int, value double, feature int, gain double, n long"
BLOCKS = "row binary, x binary, cells binary, s binary, y binary, out binary, w binary"
FINISHED = "span long, place binary, value binary, n binary, tree int, gain binary, splits binary"


@dataclass
class Top:
    """The nodes of one tree that have been split or closed so far; the children of a node lie side by side."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    #: Of closed nodes; the others have NaN and are not in `closed`.
    value: np.ndarray
    closed: np.ndarray

    @classmethod
    def root(cls) -> Top:
        return cls(np.zeros(1, np.int64), np.zeros(1), np.full(1, -1), np.full(1, np.nan), np.zeros(1, bool))

    def split(self, node: int, feature: int, threshold: float) -> int:
        """Two new nodes; returns the number of the left one."""
        left = len(self.child)
        self.feature[node], self.threshold[node], self.child[node] = feature, threshold, left
        fresh = Top.root()
        for name in ("feature", "threshold", "child", "value", "closed"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(fresh, name), getattr(fresh, name)]))
        return left

    def close(self, node: int, value: float) -> None:
        self.value[node], self.closed[node] = value, True

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        flat, first = x.reshape(-1), np.arange(len(x)) * x.shape[1]
        node, here, at = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
        while True:
            child = self.child.take(at)
            inner = child >= 0
            if not inner.all():
                node[here] = at
                here, first, at, child = here[inner], first[inner], at[inner], child[inner]
            if not len(here):
                return node
            at = child + (flat.take(first + self.feature.take(at)) > self.threshold.take(at))


@dataclass(frozen=True)
class Block:
    """Some rows of a tree table as arrays: values, numbers of their cells, labels, and weights by tree."""

    row: np.ndarray
    x: np.ndarray
    cells: np.ndarray
    s: np.ndarray
    y: np.ndarray
    out: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, r, cuts: Sequence[Sequence[float]]) -> Block:
        """From all columns or those that were selected."""
        flat = lambda name, kind: np.frombuffer(r[name] if name in r else b"", kind)
        s, y = flat("s", np.int64), flat("y", float)
        table = lambda name, kind: flat(name, kind).reshape(max(len(s), len(y)), -1)
        return cls(flat("row", np.int64), table("x", float), table("cells", cell_type(cuts)), s, y, flat("out", float), table("w", np.uint8))

    def taken(self, at: np.ndarray) -> Block:
        """Some of the rows; all of them need no copy."""
        if len(at) == len(self.w):
            return self
        return replace(self, **{name: v[at] for name, v in vars(self).items() if len(v) == len(self.w)})

    def packed(self) -> pd.DataFrame:
        return pd.DataFrame({name: [getattr(self, name).tobytes()] for name in ("row", "x", "cells", "s", "y", "out", "w")})


def cell_type(cuts: Sequence[Sequence[float]]) -> type:
    return np.uint16 if max(map(len, cuts), default=0) < 2**16 else np.int32


def cell_starts(cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Where each feature's cells begin in a node's histogram, and the end."""
    return np.cumsum([0, *[len(c) + 1 for c in cuts]])


def blocks_of(rows: DataFrame, growth: Growth, cuts: Sequence[Sequence[float]], base: float = 0.0) -> DataFrame:
    """The table in blocks of about BLOCK rows, written once. Boosting keeps cells, labels and predictions, trees values and weights."""
    ends = [np.array(c) for c in cuts]
    none = np.zeros(0)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[[f"x{f}" for f in range(len(ends))]].to_numpy(float)
        cells = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(ends)], 1).astype(cell_type(cuts))
        row, trains = frame["row"].to_numpy(np.int64), frame["trains"].to_numpy(bool)
        if growth.rounds:
            y = frame["y"].to_numpy(float)
            return Block(row, none, cells, none, y, np.full(len(y), base), trains.astype(np.uint8)).packed()
        w = np.stack([weights_here(frame["key"] if growth.bootstrap else (), trains, t, growth).astype(np.uint8) for t in range(growth.trees)], 1)
        return Block(row, x, cells, frame["s"].to_numpy(np.int64), none, none, w).packed()

    def run(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= BLOCK:
                yield pack(pd.concat(held, ignore_index=True))
                held = []
        if sum(map(len, held)):
            yield pack(pd.concat(held, ignore_index=True))

    wanted = ["row", "trains", *(["y"] if growth.rounds else ["s", *(["key"] if growth.bootstrap else [])])]
    flat = rows.select(*wanted, *[F.get("x", F.lit(f)).alias(f"x{f}") for f in range(len(ends))])
    return materialise(flat.mapInPandas(run, BLOCKS), "tree-blocks")


def total_label(v: np.ndarray) -> np.ndarray:
    """Sums of labels, kept as high and low parts that stay whole numbers however many rows there are."""
    return v[..., 1] * 2.0**SHIFT + v[..., 2]


def cut_gains(left: np.ndarray, total: np.ndarray, growth: Growth) -> np.ndarray:
    """Gains of cuts with the given sums (weight, high and low part) on the left; impossible ones: minus infinity."""
    right = total - left
    s, r = total_label(left), total_label(right)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / (left[:, 0] + growth.reg_lambda) + r * r / (right[:, 0] + growth.reg_lambda)
    return np.where((left[:, 0] >= growth.min_child) & (right[:, 0] >= max(growth.min_child, 1)), gain, -np.inf)


def histograms(slot, n_slots: int, cells, starts, w, s, centre=None) -> np.ndarray:
    """Sums of weights and labels by slot and cell; with a `centre` by slot also what labels lie above it."""
    # Whole numbers below 2^53 add up without a rest.
    exact = len(s) > 0 and max(int(s.max()), -int(s.min())) * int(w.sum()) < 2**53
    kinds = {0: None if (w == 1).all() else w, 2: w * s} if exact else {0: w, 1: w * (s >> SHIFT), 2: w * (s & (2**SHIFT - 1))}
    if centre is not None:
        kinds[3] = w * np.maximum(s - centre[slot], 0)
    kinds = {i: v if v is None else v.astype(float) for i, v in kinds.items()}
    out = np.zeros((n_slots, int(starts[-1]), 3 if centre is None else 4))
    by_feature = np.ascontiguousarray(cells.T)
    for f in range(len(starts) - 1):
        k = int(starts[f + 1] - starts[f])
        key = slot * k + by_feature[f]
        for i, v in kinds.items():
            out[:, starts[f] : starts[f + 1], i] = np.bincount(key, v, n_slots * k).reshape(n_slots, k)
    if exact:
        out[..., 1] = np.floor(out[..., 2] / 2.0**SHIFT)
        out[..., 2] -= out[..., 1] * 2.0**SHIFT
    return out


def best_cell_cut(sums: np.ndarray, starts: np.ndarray, growth: Growth):
    """Where each cell is one value: (total, best cut as (-gain, feature, cell, next cell, sums on the left) or None)."""
    total = sums[: starts[1], :3].sum(0)
    feature = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = np.cumsum(sums[:, :3], 0) - np.outer(feature, total)
    gain = np.where(sums[:, 0] > 0, cut_gains(left, total, growth), -np.inf)
    i = int(np.argmax(gain))
    if gain[i] == -np.inf:
        return total.tolist(), None
    f = int(feature[i])
    following = i + 1 + int(np.flatnonzero(sums[i + 1 : starts[f + 1], 0])[0])
    return total.tolist(), (-float(gain[i]), f, float(i - starts[f]), float(following - starts[f]), *left[i].tolist())


def cells_to_search(sums: np.ndarray, centre: float, starts: np.ndarray, growth: Growth, lone: np.ndarray | None = None):
    """(total, cells that may hold the best cut: (feature, cell, next cell or -1, sums before it)).

    A gain is convex in the weight and the label sum on the left. Within a cell these lie in a parallelogram: the weight grows by
    at most the cell's, the label sum departs from the centre's share by at most what lies above or below the centre. So
    no cut within it beats the gains at the four corners, and a cell whose corners stay below a cut between two cells is out.
    A cell of one value (`lone` is not NaN) can only be cut at its end.
    """
    total = sums[: starts[1], :3].sum(0)
    n_all, s_all = total[0], float(total_label(total))
    floor, seen = -np.inf, []
    for f in range(len(starts) - 1):
        part = sums[starts[f] : starts[f + 1]]
        found = np.flatnonzero(part[:, 0])
        if not len(found):
            continue
        part = part[found]
        run = np.cumsum(part[:, :3], 0)
        before = run - part[:, :3]
        ends = np.append(cut_gains(run[:-1], total, growth), -np.inf)
        floor = max(floor, ends.max())
        n0, s0, n, above = before[:, 0], total_label(before), part[:, 0], part[:, 3]
        below = np.maximum(above - (total_label(part) - centre * n), 0)
        bound = np.full(len(found), -np.inf)
        for a in (np.zeros(len(n)), n):
            for d in (-below, above):
                s = s0 + centre * a + d
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s * s / (n0 + a + growth.reg_lambda) + (s_all - s) ** 2 / (n_all - n0 - a + growth.reg_lambda)
                bound = np.maximum(bound, np.where(np.isnan(gain), np.inf, gain))
        if lone is not None:
            bound = np.where(np.isnan(lone[starts[f] + found]), bound, ends)
        seen.append((f, found, np.append(found[1:], -1), before, bound))
    out = []
    for f, found, following, before, bound in seen:
        # What rounding may take from a bound is far below this share of it.
        keep = np.flatnonzero((bound * (1 + 1e-12) >= floor) & (bound > -np.inf)) if floor > -np.inf else np.flatnonzero(bound > -np.inf)
        out += [(f, int(found[i]), int(following[i]), *before[i].tolist()) for i in keep]
    return total.tolist(), out


def lone_values(data, starts: np.ndarray, cuts) -> tuple[np.ndarray, list[int]]:
    """The value of each cell that holds a single one in all rows, NaN for the others, and the features of which all cells do so.

    Features of many values are not looked at.
    """
    few = [f for f in range(len(starts) - 1) if starts[f + 1] - starts[f] < CELLS]
    out = np.full(int(starts[-1]), np.nan)
    if not few:
        return out, []

    def run(part):
        least, most = np.full(len(out), np.inf), np.full(len(out), -np.inf)
        for r in part:
            block = Block.of(r, cuts)
            for f in few:
                at, v = starts[f] + block.cells[:, f], np.ascontiguousarray(block.x[:, f])
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
        yield 0, (least, most)

    found = data.mapPartitions(run).reduceByKey(lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1])), 1).collect()
    whole = np.ones(len(out), bool)
    for _, (least, most) in found:
        out[least == most] = least[least == most]
        whole = least >= most
    return out, [f for f in few if starts[f + 1] - starts[f] <= 256 and whole[starts[f] : starts[f + 1]].all()]


def distinct_sums(number, v, sums):
    """Sums by (number, value), in order."""
    order = np.lexsort((v, number))
    number, v, sums = number[order], v[order], sums[order]
    at = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (v[1:] != v[:-1])))
    return number[at], v[at], np.add.reduceat(sums, at, axis=0)


def best_value_cut(f: int, before: Sequence[float], total: Sequence[float], found, growth: Growth):
    """The best cut after a value of one cell. Values without weight are the first ones of the next cell."""
    entries = np.concatenate(list(found))
    _, v, sums = distinct_sums(np.zeros(len(entries), np.int64), entries[:, 0], entries[:, 1:])
    own = np.flatnonzero(sums[:-1, 0] > 0)
    if not len(own):
        return None
    left = np.cumsum(sums, 0)[own] + np.array(before)
    gain = cut_gains(left, np.array(total), growth)
    i = int(np.argmax(gain))
    return (-float(gain[i]), f, float(v[own[i]]), float(v[own[i] + 1]), *left[i].tolist()) if gain[i] > -np.inf else None


def tasks_for(spark, keys: int, bytes_each: int) -> int:
    """Tasks that add up so many keys: one for each few megabytes of a map task's share, as small tasks cost more than they save."""
    return max(1, min(keys, -(-keys * bytes_each // 2**21), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def split_values(data, spark, tops: Sequence[Top], large: dict, cuts, lone: np.ndarray, growth: Growth) -> dict:
    """(rows, total, best cut or None) of every node, from all values of all features; small ones get no cut.

    `large`: the mean label by (tree, node). One pass gives histograms over cells; values are looked at where these leave it open. A cut
    also says how many rows may go to either side at most, whether they train or not.
    """
    starts, places = cell_starts(cuts), {}
    for tree, node in large:
        places.setdefault(tree, []).append(node)

    def at_work(part):
        for r in part:
            block = Block.of(r, cuts)
            for tree, nodes in places.items():
                to = np.full(len(tops[tree].child), -1)
                to[nodes] = range(len(nodes))
                slot = to[tops[tree].walk(block.x)]
                keep = np.flatnonzero((slot >= 0) & (block.w[:, tree] > 0))
                yield tree, nodes, block, slot, keep, slot[keep], block.w[keep, tree].astype(np.int64), block.s[keep]

    def coarse(part):
        for tree, nodes, block, every, keep, slot, w, s in at_work(part):
            here = np.flatnonzero(every >= 0)
            if not len(here):
                continue
            centre = np.array([large[tree, n] for n in nodes], np.int64)
            sums = histograms(slot, len(nodes), block.cells[keep], starts, w, s, centre)
            if len(keep) == len(here) and (w == 1).all():
                n_rows = sums[..., 0]
            else:
                n_rows = histograms(every[here], len(nodes), block.cells[here], starts, np.ones(len(here), np.int64), np.zeros(len(here), np.int64))[..., 0]
            least, most = np.full(len(nodes), 2**63 - 1), np.full(len(nodes), -(2**63))
            np.minimum.at(least, slot, s)
            np.maximum.at(most, slot, s)
            for i in np.unique(every[here]):
                yield (tree, nodes[i]), (np.c_[sums[i], n_rows[i]], int(least[i]), int(most[i]))

    def judged(item):
        key, (sums, least, most) = item
        n, total = int(sums[: starts[1], 4].sum()), sums[: starts[1], :3].sum(0).tolist()
        if n <= growth.local_rows or not total[0] or (growth.gamma is None and least == most):
            return key, (n, total, [], [])
        known, open_ = [], []
        for f, cell, following, *before in cells_to_search(sums[:, :4], large[key], starts, growth, lone)[1]:
            own = sums[starts[f] : starts[f + 1]]
            most_left = own[: following + 1, 4].sum() if following >= 0 else float(n)
            sides = (float(most_left), float(own[cell:, 4].sum()))
            v, after = lone[starts[f] + cell], lone[starts[f] + following]
            if following < 0 or np.isnan(v) or np.isnan(after):
                open_.append((f, cell, following, sides, *before))
                continue
            left = np.array(before) + own[cell, :3]
            known.append((-float(cut_gains(left[None], np.array(total), growth)[0]), f, float(v), float(after), *left.tolist(), *sides))
        return key, (n, total, [min(known)] if known else [], open_)

    add = lambda a, b: (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]))
    tasks = tasks_for(spark, len(large), 40 * int(starts[-1]))
    seen = dict(data.mapPartitions(coarse).reduceByKey(add, tasks).map(judged).collect())
    searched = [(key, *c) for key, (_, _, _, open_) in seen.items() for c in open_]
    out = {key: (n, total, known[0] if known else None) for key, (n, total, known, _) in seen.items()}
    if not searched:
        return out
    marks = {t: (np.full((len(nodes), int(starts[-1])), -1, np.int32), np.full((len(nodes), int(starts[-1])), -1, np.int32)) for t, nodes in places.items()}
    opened: dict[int, set[int]] = {}
    for number, ((tree, node), f, cell, following, *_) in enumerate(searched):
        own, after = marks[tree]
        opened.setdefault(tree, set()).add(f)
        own[places[tree].index(node), starts[f] + cell] = number
        if following >= 0:
            after[places[tree].index(node), starts[f] + following] = number

    def fine(part):
        either = {tree: ((own >= 0) | (after >= 0)).reshape(-1) for tree, (own, after) in marks.items()}
        for tree, _, block, _, keep, slot, w, s in at_work(part):
            own, after = marks[tree]
            numbers, values, weights = [], [], []
            cells, begin = np.ascontiguousarray(block.cells[keep].T), slot * int(starts[-1])
            for f in opened.get(tree, ()):
                at = begin + (starts[f] + cells[f])
                some = np.flatnonzero(either[tree].take(at))
                at, v = at[some], block.x[keep[some], f]
                number, following = own.reshape(-1)[at], after.reshape(-1)[at]
                weighs, labels = w[some], s[some]
                sums = np.stack([weighs, weighs * (labels >> SHIFT), weighs * (labels & (2**SHIFT - 1))], 1).astype(float)
                m, first = number >= 0, np.flatnonzero(following >= 0)
                first = first[np.lexsort((v[first], following[first]))]
                first = first[np.unique(following[first], return_index=True)[1]]
                numbers += [number[m], following[first]]
                values += [v[m], v[first]]
                weights += [sums[m], np.zeros((len(first), 3))]
            number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            if len(number):
                number, v, sums = distinct_sums(number, np.concatenate(values), np.concatenate(weights))
                entries, at = np.c_[v, sums], np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                for n, e in zip(number[at].tolist(), np.split(entries, at[1:])):
                    yield n, e

    def best(item):
        number, found = item
        key, f, _, _, sides, *before = searched[number]
        cut = best_value_cut(f, before, seen_totals[key], found, growth)
        return [] if cut is None else [(key, (*cut, *sides))]

    seen_totals = {key: total for key, (_, total, _, open_) in seen.items() if open_}
    cuts_found = data.mapPartitions(fine).groupByKey(tasks_for(spark, len(searched), 2**17)).flatMap(best).reduceByKey(min, tasks)
    for key, cut in cuts_found.collect():
        n, total, known = out[key]
        out[key] = (n, total, cut if known is None else min(cut, known))
    return out


def mean_label(sums: Sequence[float]) -> int:
    s = int(sums[1]) * 2**SHIFT + int(sums[2])
    return round(s / sums[0]) if sums[0] else 0


def leaf_value(sums: Sequence[float], growth: Growth) -> float:
    n = sums[0] + growth.reg_lambda
    return float(total_label(np.array(sums))) * growth.unit / n if n else float("nan")


def won_by(best, total, growth: Growth) -> float | None:
    """What a split gains, None if the node stays whole."""
    if best is None:
        return None
    s = float(total_label(np.array(total)))
    won = -best[0] - s * s / (total[0] + growth.reg_lambda)
    return won if growth.gamma is None or won > growth.gamma / growth.unit**2 else None


def waves(small: dict) -> list[list[list[tuple[int, int]]]]:
    """Nodes by wave and task: a task gets LOCAL_ROWS rows or one node, a wave WAVE rows."""
    out: list[list[list[tuple[int, int]]]] = []
    in_wave = in_task = 0
    for key, (_, most) in sorted(small.items()):
        if not out or in_wave + most > WAVE:
            out.append([[]])
            in_wave = in_task = 0
        elif in_task + most > LOCAL_ROWS:
            out[-1].append([])
            in_task = 0
        out[-1][-1].append(key)
        in_wave, in_task = in_wave + most, in_task + most
    return out


def finish(blocks: DataFrame, tops: Sequence[Top], small: dict, cuts, lone: np.ndarray, coded: Sequence[int], growth: Growth) -> DataFrame:
    """Finish nodes of bounded size, each in one task: predictions of rows, added up over the trees, and gains of features.

    `small`: depth and rows at most by (tree, node). Nodes are finished in waves: what moves is a wave's rows, which are removed after it, and
    the sums so far. Features that have one value in each cell (`coded`) move as cells.
    """
    spark, starts, n_features = blocks.sparkSession, cell_starts(cuts), len(cuts)
    wide = [f for f in range(n_features) if f not in coded]
    data = blocks.select("row", "x", "cells", "s", "w").rdd
    sums, parts = None, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gather(tasks: Sequence[Sequence[tuple[int, int]]]):
        to: dict[int, np.ndarray] = {}
        for task, nodes in enumerate(tasks):
            for tree, node in nodes:
                to.setdefault(tree, np.full(len(tops[tree].child), -1, np.int32))[node] = task

        def run(part):
            for r in part:
                block = Block.of(r, cuts)
                x, cells = np.ascontiguousarray(block.x[:, wide]), np.ascontiguousarray(block.cells[:, coded].astype(np.uint8))
                for tree, tasks_of in to.items():
                    at = tops[tree].walk(block.x)
                    here = np.flatnonzero(tasks_of[at] >= 0)
                    if not len(here):
                        continue
                    here = here[np.argsort(at[here].astype(np.uint16) if len(tasks_of) < 2**16 else at[here], kind="stable")]
                    node = at[here]
                    ends = np.flatnonzero(np.append(node[1:] != node[:-1], True)) + 1
                    arrays = block.row[here], x[here], cells[here], block.s[here], block.w[here, tree]
                    for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                        row, values, places, s, w = (v[lo:hi] for v in arrays)
                        yield int(tasks_of[node[lo]]), (tree, int(node[lo]), row, values, np.ascontiguousarray(places.T), s, w)

        return run

    def grown(part):
        pieces: dict[tuple[int, int], list] = {}
        for _, (tree, node, *piece) in part:
            pieces.setdefault((tree, node), []).append(piece)
        for key in list(pieces):
            row, x, places, s, w = zip(*pieces.pop(key))
            row, x, s, w = (np.concatenate(v) for v in (row, x, s, w))
            values, codes = [None] * n_features, np.zeros((n_features, len(row)), np.int32)
            own = Codes.of(x)
            for f, code, v in zip(wide, own.codes, own.values):
                codes[f], values[f] = code, v
            for f, code in zip(coded, np.concatenate(places, 1)):
                codes[f], values[f] = code, lone[starts[f] : starts[f + 1]]
            leaf, n, total, (feature, gain) = grow_here(Codes(codes, values), w.astype(np.int64), s.astype(float), growth, small[key][0])
            with np.errstate(divide="ignore", invalid="ignore"):
                value = (total * growth.unit / (n + growth.reg_lambda))[leaf]
            if len(gain):
                yield key[0] % parts, (-1, key[0], np.bincount(feature, gain, n_features), np.bincount(feature, minlength=n_features))
            said = np.flatnonzero((row >= 0) & ~np.isnan(value))
            said = said[np.argsort(row[said], kind="stable")]
            row, value = row[said], value[said]
            span = row // SPAN
            at = np.flatnonzero(np.append(True, span[1:] != span[:-1])) if len(row) else []
            for i, where, v in zip(span[at].tolist(), np.split(row % SPAN, at[1:]), np.split(value, at[1:])):
                yield mixed(i), (i, where.astype(np.uint16), v, 1)

    def mixed(span: int) -> int:
        return (span * 0x9E3779B97F4A7C15 % 2**64 >> 32) % parts

    def kept(part):
        """The sums so far, as what `grown` gives."""
        for r in part:
            if r.span >= 0:
                yield mixed(r.span), (r.span, np.frombuffer(r.place, np.uint16), np.frombuffer(r.value), np.frombuffer(r.n, np.int32))
            else:
                yield r.tree % parts, (-1, r.tree, np.frombuffer(r.gain), np.frombuffer(r.splits, np.int64))

    def added(part):
        values, gains = {}, {}
        for _, (span, *piece) in part:
            if span < 0:
                tree, gain, splits = piece
                before = gains.get(tree, (0.0, 0))
                gains[tree] = before[0] + gain, before[1] + splits
                continue
            place, v, n = piece
            value, trees = values.get(span, (np.zeros(0), np.zeros(0, np.int32)))
            if (size := int(place.max()) + 1) > len(value):
                value, trees = (np.append(a, np.zeros(size - len(a), a.dtype)) for a in (value, trees))
                values[span] = value, trees
            value[place] += v
            trees[place] += np.int32(n) if np.ndim(n) == 0 else n
        for span, (value, trees) in values.items():
            place = np.flatnonzero(trees)
            yield span, place.astype(np.uint16).tobytes(), value[place].tobytes(), trees[place].tobytes(), -1, b"", b""
        for tree, (gain, splits) in gains.items():
            yield -1, b"", b"", b"", tree, gain.tobytes(), splits.astype(np.int64).tobytes()

    for tasks in waves(small):
        found = data.mapPartitions(gather(tasks)).partitionBy(len(tasks), int).mapPartitions(grown)
        if sums is not None:
            found = found.union(sums.rdd.mapPartitions(kept))
        moved = found.partitionBy(parts, int)
        before, sums = sums, materialise(spark.createDataFrame(moved.mapPartitions(added), FINISHED, verifySchema=False), "tree-sums")
        # Else they stay until the driver happens to collect its garbage.
        moved._jrdd.rdd().cleanShuffleDependencies(True)
        if before is not None:
            discard(before)

    def rows(frames):
        for frame in frames:
            for r in frame.itertuples():
                if r.span >= 0:
                    row = r.span * SPAN + np.frombuffer(r.place, np.uint16).astype(np.int64)
                    yield pd.DataFrame({"row": row, "tree": -1, "value": np.frombuffer(r.value), "feature": -1, "gain": 0.0, "n": np.frombuffer(r.n, np.int32)})
                else:
                    yield gains_of(r.tree, np.frombuffer(r.gain), np.frombuffer(r.splits, np.int64))

    return sums.mapInPandas(rows, OUT)


def gains_of(tree: int, gain: np.ndarray, splits: np.ndarray) -> pd.DataFrame:
    """A row for each feature that was split by."""
    f = np.flatnonzero(splits)
    return pd.DataFrame({"row": -1, "tree": tree, "value": 0.0, "feature": f, "gain": gain[f], "n": splits[f]})


def emitted(row, value, n, gains: Sequence[tuple[int, np.ndarray, np.ndarray]] = ()) -> pd.DataFrame:
    """Sums of the values of `n` trees for rows to predict, and the gains of trees by (tree, features, gains)."""
    wanted = (row >= 0) & (n > 0)
    out = [pd.DataFrame({"row": row[wanted], "tree": -1, "value": value[wanted], "feature": -1, "gain": 0.0, "n": n[wanted]})]
    return pd.concat(out + [gains_of(tree, np.bincount(f, gain), np.bincount(f)) for tree, f, gain in gains if len(f)], ignore_index=True)


def gain_rows(spark, gains: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Splits of large nodes (tree, feature, gain), as OUT."""
    return spark.createDataFrame([(-1, t, 0.0, f, g, 1) for t, f, g in gains], OUT)


def grow_on_spark(rows: DataFrame, growth: Growth, n: int | None = None) -> DataFrame:
    """Trees on a table of any size (row, key, x, s, trains), of `n` rows: as OUT.

    The driver holds the splits of large nodes, of which there are at most trees * rows / local_rows a level. A level is one pass,
    and a second one where features have more values than cells.
    """
    spark = rows.sparkSession
    n = rows.count() if n is None else n
    cuts = cut_points(rows, CELLS, 10 * CELLS)
    blocks = blocks_of(rows, growth, cuts)
    data = blocks.select("x", "cells", "s", "w").rdd
    lone, coded = lone_values(data, cell_starts(cuts), cuts)
    tops = [Top.root() for _ in range(growth.trees)]
    whole = label_sums(rows)
    # Sums of labels (of forests not those of the drawn rows: replaced when they are seen) and rows at most.
    known = {(t, 0): (whole, n) for t in range(growth.trees)}
    small, gains, depth = {}, [], 0
    while known:
        last = growth.max_depth is not None and depth >= growth.max_depth and depth > 0
        if last:
            found = {key: (n, sums, None) for key, (sums, _) in known.items()}
        else:
            # Most small nodes are known by the rows that they hold at most; the pass that would split the others counts them.
            small |= {key: (depth, int(most)) for key, (_, most) in known.items() if most <= growth.local_rows}
            known = {key: v for key, v in known.items() if key not in small}
            found = split_values(data, spark, tops, {k: mean_label(sums) for k, (sums, _) in known.items()}, cuts, lone, growth) if known else {}
        children = {}
        for (tree, node), (size, total, best) in found.items():
            if not last and size <= growth.local_rows:
                small[tree, node] = depth, size
                continue
            won = won_by(best, total, growth) if growth.max_depth is None or depth < growth.max_depth else None
            if won is None:
                tops[tree].close(node, leaf_value(total, growth))
                continue
            _, f, v, following, *left = best
            left, (most_left, most_right) = left[:3], left[3:]
            child = tops[tree].split(node, f, (v + following) / 2)
            children[tree, child], children[tree, child + 1] = (left, most_left), ([a - b for a, b in zip(total, left)], most_right)
            gains.append((tree, f, won))
        known, depth = children, depth + 1
    closed = [t for t, top in enumerate(tops) if top.closed.any()]

    def leaves(frames):
        for frame in frames:
            for _, r in frame.iterrows():
                block = Block.of(r, cuts)
                value, trees = np.zeros(len(block.row)), np.zeros(len(block.row), np.int64)
                for tree in closed:
                    v = tops[tree].value[tops[tree].walk(block.x)]
                    value, trees = np.where(np.isnan(v), value, value + v), trees + ~np.isnan(v)
                yield emitted(block.row, value, trees)

    out = gain_rows(spark, gains)
    if closed:
        out = out.unionByName(materialise(blocks.mapInPandas(leaves, OUT), "tree-leaves"))
    if small:
        out = out.unionByName(finish(blocks, tops, small, cuts, lone, coded, growth))
    discard(blocks)
    return out


def label_sums(rows: DataFrame) -> list[float]:
    """Weight and label sums of the training rows."""
    low = F.col("s").bitwiseAND(F.lit(2**SHIFT - 1))
    found = rows.where("trains").agg(F.count("*"), F.sum(F.shiftright("s", SHIFT)), F.sum(low)).first()
    return [float(v or 0) for v in found]


def grow_in_groups(rows: DataFrame, growth: Growth) -> DataFrame:
    """The same on a small table: each group of trees gets the rows once."""
    groups = 1 if growth.rounds else min(growth.trees, GROUPS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        x, trains = np.stack(frame["x"].to_numpy()), frame["trains"].to_numpy()
        coded, row = Codes.of(x), frame["row"].to_numpy()
        if growth.rounds:
            value, gains = boost_here(coded, trains, frame["y"].to_numpy(), growth)
            return emitted(row, value, np.ones(len(row), np.int64), [(0, *gains)])
        value, said, won = np.zeros(len(row)), np.zeros(len(row), np.int64), []
        for tree in range(int(frame["part"].iloc[0]), growth.trees, groups):
            w = weights_here(frame["key"], trains, tree, growth)
            leaf, n, s, gains = grow_here(coded, w, frame["s"].to_numpy().astype(float), growth)
            with np.errstate(divide="ignore", invalid="ignore"):
                v = (s * growth.unit / (n + growth.reg_lambda))[leaf]
            value, said = np.where(np.isnan(v), value, value + v), said + ~np.isnan(v)
            won.append((tree, *gains))
        return emitted(row, value, said, won)

    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return each.repartition(groups, "part").groupBy("part").applyInPandas(run, OUT)


def boost_on_spark(rows: DataFrame, growth: Growth, cuts: Sequence[Sequence[float]], n: int) -> DataFrame:
    """Rounds of boosting on a table of any size: as OUT.

    Rows stay where they are. A level is one histogram of all its nodes by bins, of which the driver gets the best cuts; it holds one
    tree, of at most 2^max_depth leaves. Predictions are written every KEPT_ROUNDS rounds, between them rows walk down
    the trees since.
    """
    spark, starts = rows.sparkSession, cell_starts(cuts)
    whole = label_sums(rows)
    base = float(total_label(np.array(whole))) / whole[0] * growth.unit if whole[0] else 0.0
    blocks = blocks_of(rows, growth, cuts, base)

    def in_place(blocks: DataFrame):
        """Read by one task for each `local_rows` rows at most: a level is short beside the start of a task."""
        data = blocks.select("cells", "y", "out", "w").rdd
        return data.coalesce(min(data.getNumPartitions(), -(-n // growth.local_rows)))

    data, since, gains = in_place(blocks), [], []

    def predicted(block: Block, tops: Sequence[Top]) -> np.ndarray:
        out = block.out
        for top in tops:
            out = out + growth.step * top.value[top.walk(block.cells)]
        return out

    def kept(tops: Sequence[Top]):
        def run(frames):
            for frame in frames:
                for _, r in frame.iterrows():
                    block = Block.of(r, cuts)
                    yield replace(block, out=predicted(block, tops)).packed()

        return run

    def level(tops: Sequence[Top], top: Top, nodes: Sequence[int]):
        to = np.full(len(top.child), -1)
        to[nodes] = range(len(nodes))

        def run(part):
            summed = 0.0
            for r in part:
                block = Block.of(r, cuts)
                block = block.taken(np.flatnonzero(block.w[:, 0] > 0))
                slot = to[top.walk(block.cells)]
                block, slot = block.taken(np.flatnonzero(slot >= 0)), slot[slot >= 0]
                if len(slot):
                    s = np.rint((block.y - predicted(block, tops)) / growth.unit).astype(np.int64)
                    summed = summed + histograms(slot, len(nodes), block.cells, starts, np.ones(len(slot), np.int64), s)
            if np.ndim(summed):
                yield from ((nodes[i], summed[i]) for i in np.flatnonzero(summed[:, : starts[1], 0].any(1)).tolist())

        return run

    def cuts_of(tops: Sequence[Top], top: Top, nodes: Sequence[int]) -> dict:
        """(total, best cut or None) of the nodes: few histograms are added up by the driver, which spares a second stage."""
        each = data.mapPartitions(level(tops, top, nodes))
        size = len(nodes) * 24 * int(starts[-1])
        if data.getNumPartitions() * size > COLLECTED:
            summed = each.reduceByKey(lambda a, b: a + b, tasks_for(spark, len(nodes), 24 * int(starts[-1])))
            return dict(summed.mapValues(lambda v: best_cell_cut(v, starts, growth)).collect())
        sums: dict[int, np.ndarray] = {}
        for node, v in each.collect():
            sums[node] = sums[node] + v if node in sums else v
        return {node: best_cell_cut(v, starts, growth) for node, v in sums.items()}

    for round_ in range(growth.rounds):
        top, nodes, depth = Top.root(), [0], 0
        known: dict[int, Sequence[float]] = {}
        while nodes and depth < max(growth.max_depth, 1):
            found = cuts_of(since, top, nodes)
            nodes = []
            for node, (total, best) in sorted(found.items()):
                known[node] = total
                won = won_by(best, total, growth) if depth < growth.max_depth else None
                if won is None:
                    continue
                _, f, v, following, *left = best
                child = top.split(node, f, (v + following) / 2)
                known[child], known[child + 1] = left, [a - b for a, b in zip(total, left)]
                nodes += [child, child + 1]
                gains.append((0, f, won))
            depth += 1
        for node in np.flatnonzero(top.child < 0).tolist():
            top.close(node, leaf_value(known[node], growth))
        since.append(top)
        if len(since) == KEPT_ROUNDS and round_ + 1 < growth.rounds:
            before, blocks = blocks, materialise(blocks.mapInPandas(kept(since), BLOCKS), "boosted-blocks")
            discard(before)
            data, since = in_place(blocks), []

    def final(frames):
        for frame in frames:
            for _, r in frame.iterrows():
                block = Block.of(r, cuts)
                yield emitted(block.row, predicted(block, since), np.ones(len(block.row), np.int64))

    out = materialise(blocks.mapInPandas(final, OUT), "boosted-values")
    discard(blocks)
    return out.unionByName(gain_rows(spark, gains))


def boost_tree_by_tree(rows: DataFrame, growth: Growth) -> DataFrame:
    """The same for trees of no stated depth: the driver never holds one of them whole."""
    # Every row needs its prediction for the next round.
    every = F.when(F.col("row") < 0, -2 * F.col("row") - 1).otherwise(2 * F.col("row"))
    rows = rows.withColumn("given", F.col("row")).withColumn("row", every)
    one = replace(growth, rounds=0, trees=1)
    whole = label_sums(rows)
    base = float(total_label(np.array(whole))) / whole[0] * growth.unit if whole[0] else 0.0
    state = rows.withColumn("out", F.lit(base))
    gains = None
    for _ in range(growth.rounds):
        state = state.withColumn("s", F.rint((F.col("y") - F.col("out")) / growth.unit).cast("long"))
        grown = materialise(grow_on_spark(state, one), "boosted-tree")
        step = grown.where("feature < 0").select("row", "value")
        state = materialise(state.join(step, "row").withColumn("out", F.col("out") + growth.step * F.col("value")).drop("value"), "boosted-rows")
        won = grown.where("feature >= 0")
        gains = won if gains is None else gains.unionByName(won)
    none = [F.lit(0).alias("tree"), F.col("out").alias("value"), F.lit(-1).alias("feature"), F.lit(0.0).alias("gain"), F.lit(1).cast("long").alias("n")]
    out = state.where("given >= 0").select(F.col("given").alias("row"), *none)
    return out if gains is None else out.unionByName(gains)


def cut_points(rows: DataFrame, bins: int, accuracy: int | None = None) -> list[list[float]]:
    """Values that cut each feature into equal shares of the training rows.

    These are the weighted quantiles of boosting: the hessian of squared error is 1 a row.
    """
    shares = [i / bins for i in range(1, bins)]
    each = rows.where("trains").select(F.posexplode("x").alias("f", "v"))
    found = each.groupBy("f").agg(F.percentile_approx("v", shares, accuracy or 100 * bins).alias("cuts"))
    return [sorted(set(r.cuts)) for r in found.orderBy("f").collect()]


def binned(rows: DataFrame, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Each feature's values as numbers of their bins."""
    ends = [np.array(c) for c in cuts]

    @F.pandas_udf("array<double>")
    def numbers(x: pd.Series) -> pd.Series:
        table = np.stack(x.to_numpy())
        return pd.Series(list(np.stack([np.searchsorted(c, table[:, f], side="left") for f, c in enumerate(ends)], 1).astype(float)))

    return rows.withColumn("x", numbers("x"))


def grow(rows: DataFrame, growth: Growth, n: int | None = None, cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Grow on a tree table (row, key, x, y, trains) of `n` rows and predict those numbered from 0.

    `cuts`, for boosting, where they are known already.

    Returns (row, value, n): sums of the values of n trees, with feature -1, at least one of every row, and (tree, feature, gain, n): the gain
    of n splits, with row -1. Boosted trees count as one, with their sum.
    """
    n = rows.count() if n is None else n
    if not n or rows.where("trains").isEmpty():
        return rows.sparkSession.createDataFrame([], OUT)
    if growth.rounds:
        cuts = cut_points(rows, growth.bins) if cuts is None else cuts
    rows = rows.withColumn("s", F.when(F.col("trains"), F.rint(F.col("y") / growth.unit).cast("long")).otherwise(0))
    if growth.rounds and n > growth.local_rows and growth.max_depth is not None and growth.max_depth <= HELD_DEPTH:
        return boost_on_spark(rows, growth, cuts, n)
    if growth.rounds:
        rows = binned(rows, cuts)
    if n <= growth.local_rows:
        return grow_in_groups(rows, growth)
    return boost_tree_by_tree(rows, growth) if growth.rounds else grow_on_spark(rows, growth, n)


def predictions(grown: DataFrame) -> DataFrame:
    """(row, prediction): the mean over the trees. A tree without a drawn row has no say."""
    values = grown.where("feature < 0 AND n > 0 AND NOT isnan(value)")
    return values.groupBy("row").agg((F.sum("value") / F.sum("n")).alias("prediction"))


def feature_importances(grown: DataFrame, growth: Growth, names: Sequence[str]) -> DataFrame:
    """(feature, importance), 0 for features without a split.

    Trees: each feature's share of its tree's gain, averaged over the trees. Boosting: mean gain of a feature's splits,
    as a share of all.
    """
    won = grown.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"), F.sum("n").alias("splits"))
    if growth.rounds:
        won = won.withColumn("gain", F.col("gain") / F.col("splits"))
    share = won.withColumn("share", F.try_divide("gain", F.sum("gain").over(Window.partitionBy("tree"))))
    mean = share.groupBy("feature").agg(F.sum("share").alias("share"))
    # Trees that are a single leaf have no shares and do not count.
    trees = F.greatest(F.lit(1), grown.where("feature >= 0").agg(F.count_distinct("tree").alias("n")).scalar())
    names_ = grown.sparkSession.createDataFrame(list(enumerate(names)), "f int, name string")
    return names_.join(mean, F.col("f") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("share") / trees, F.lit(0.0)).alias("importance")
    )
