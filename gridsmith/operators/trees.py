"""Tree ensembles without a depth limit: grown by levels over all rows while a node is
large, finished in one task each once its rows fit there.

A large node is split from grouped aggregates: for the best cut, counts and extremes per quantile
bin of its candidate features, then the values of the bins in which a better cut can lie than the
best one between bins; for a random cut, first the range of each feature in the node, then
the counts on both sides of a point drawn in it. Nodes of at most ``CELLS`` cells are dealt
to tasks with their rows and grown to the end there, level by level over sorted columns. Both
forms find the same cuts, so no tree depends on the size of the table. If all
trees start that small and the table is measured as small, it is sent to the tasks once
instead of being dealt once a tree; the trees are the same.

Whatever is random (the weight of a row in a tree, the order in which a node tries features,
a cut) is a hash of the seed, the tree, the way to the node, and the row's key or the feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributed import quantiles
from ..session import LIMITS, materialize, spread

#: Cells (rows times features and classes) of a node that one task finishes.
CELLS = 16_000_000
#: The same for random cuts, which are the same ones in either form, so memory alone decides.
RANDOM_CELLS = 4_000_000
#: Bins of a feature in a large node, and cells of one grouped aggregate.
BINS, PASS_CELLS = 64, 500_000
#: Bytes of packed trees that one pass of a prediction broadcasts; if one tree has more, its
#: parts stay with tasks and rows are dealt to them, at most so many to a task.
MODEL_BYTES, DEALT_ROWS = 64_000_000, 200_000

_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Shares of the Poisson law with mean 1 up to 0, 1, 2, ...
_POISSON = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 15.0))]))


def mixed(a, b) -> np.ndarray:
    """64-bit hash of two numbers or arrays."""
    with np.errstate(over="ignore"):
        z = (np.asarray(a, np.uint64) ^ (np.asarray(b, np.uint64) * _B)) + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _A
        z = (z ^ (z >> np.uint64(27))) * _B
        return z ^ (z >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


@dataclass(frozen=True)
class Spec:
    """What a tree is: ``classes`` 0 means a numeric label; ``tried`` features a node."""

    classes: int
    width: int
    tried: int
    trees: int
    depth: int
    bootstrap: bool
    random_cuts: bool
    seed: int
    keep: bool = True

    @property
    def stats(self) -> int:
        return self.classes or 3

    def root(self, tree: int) -> np.uint64:
        return np.uint64(mixed(self.seed, tree + 1))

    def weights(self, tree: int, keys: np.ndarray) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(keys))
        return np.searchsorted(_POISSON, uniform(mixed(self.root(tree), keys.view(np.uint64))), side="right").astype(np.float64)

    def table(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(stats, rows): weight by class, or weight, sum and sum of squares."""
        if not self.classes:
            return np.stack([w, w * y, w * y * y])
        out = np.zeros((self.classes, len(y)))
        out[y.astype(np.int64), np.arange(len(y))] = w
        return out

    def score(self, s: np.ndarray) -> np.ndarray:
        """What splitting raises: (stats, n) -> n; the sum over children minus the parent's is
        the weighted loss of Gini impurity or of squared error."""
        if self.classes:
            total = s.sum(axis=0)
            return np.divide((s * s).sum(axis=0), total, out=np.zeros_like(total), where=total > 0)
        return np.divide(s[1] * s[1], s[0], out=np.zeros_like(s[0]), where=s[0] > 0)

    def loss(self, s: np.ndarray) -> np.ndarray:
        return (s.sum(axis=0) if self.classes else s[2]) - self.score(s)

    def impure(self, s: np.ndarray) -> np.ndarray:
        return self.loss(s) > 1e-9 * np.maximum(1.0, s.sum(axis=0) if self.classes else s[2])

    def order(self, seeds: np.ndarray) -> np.ndarray:
        """The order in which each node tries the features."""
        return np.argsort(mixed(seeds[:, None], np.arange(self.width, dtype=np.uint64)[None] + np.uint64(10)), axis=1, kind="stable")

    def draw(self, seeds: np.ndarray, feature: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A cut in [low, high)."""
        cut = low + uniform(mixed(seeds, feature + 1_000_003)) * (high - low)
        return np.where(cut < high, cut, low)


def children(seeds: np.ndarray) -> np.ndarray:
    """Seeds of left and right children, alternating."""
    return np.stack([mixed(seeds, 1), mixed(seeds, 2)], axis=1).ravel()


class _Rows:
    """Labels and weights of the rows of a node, summed in any order of the rows."""

    def __init__(self, spec: Spec, y: np.ndarray, w: np.ndarray):
        self.spec, self.unit = spec, bool((w == 1).all())
        if spec.classes:
            self.y, self.w = y.astype(np.uint8 if spec.classes <= 256 else np.int32), w.astype(np.int32)
            self.sum = np.int32 if w.sum() < 2**31 else np.int64
        else:
            self.columns = spec.table(y, w)

    def totals(self, o: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
        """(stats, m) over the rows ``o`` of nodes ``of``."""
        k = self.spec.stats
        if self.spec.classes:
            cells = of * k + self.y[o]
            return np.bincount(cells, None if self.unit else self.w[o], m * k).astype(np.float64).reshape(m, k).T
        return np.stack([np.bincount(of, c[o], m) for c in self.columns])

    def own(self, o: np.ndarray) -> list[np.ndarray]:
        """What ``sides`` needs of the rows ``o``."""
        if self.spec.classes:
            return [self.y[o]] if self.unit else [self.y[o], self.w[o]]
        return [self.columns[1][o]] if self.unit else [c[o] for c in self.columns[:2]]

    def sides(self, own: list[np.ndarray], of: np.ndarray, who: np.ndarray, begin: np.ndarray, m: int, left: np.ndarray) -> np.ndarray:
        """What ``score`` needs, summed over the left rows of nodes ``of``: ``who``, from ``begin`` on."""
        k = self.spec.stats
        if self.spec.classes:
            cells = of[left] * k + own[0][left]
            return np.bincount(cells, None if self.unit else own[1][left], m * k).astype(np.float64).reshape(m, k).T
        out = np.zeros((2, m))
        if self.unit:
            out[0, who] = np.add.reduceat(left, begin, dtype=np.int64)
        else:
            out[0] = np.bincount(of, own[0] * left, m)
        out[1] = np.bincount(of, own[-1] * left, m)
        return out

    def before(self, o: np.ndarray, of: np.ndarray, begin: np.ndarray, who: np.ndarray, m: int, spots: np.ndarray) -> list[np.ndarray]:
        """What ``score`` needs, summed from the begin of the node up to each spot."""
        out, at = [], of[spots]
        if self.spec.classes:
            y = self.y[o]
            w = None if self.unit else self.w[o]
            cells = ((y == c) if w is None else (y == c) * w for c in range(self.spec.classes))
        else:
            cells = (c[o] for c in self.columns[:2])
        for own in cells:
            run = np.cumsum(own, dtype=self.sum if self.spec.classes else np.float64)
            base = np.zeros(m, run.dtype)
            base[who] = run[begin] - own[begin]
            out.append((run[spots] - base[at]).astype(np.float64))
        return out


def grow(spec: Spec, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: np.uint64, depth: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All nodes below one, exactly, and the gain of each feature. ``x`` is (features, rows);
    the result does not depend on the order of the rows, but for rounding of numeric labels."""
    n = x.shape[1]
    rows, ranks = _Rows(spec, y, w), np.empty((0 if spec.random_cuts else spec.width, n), np.int32)
    # random cuts: the rank of each row among the values; exact cuts: its place in the sorted
    # column, and by place the row and its rank
    codes, values, by_place = [], [], []
    for f, column in enumerate(x):
        o = np.argsort(column, kind="stable").astype(np.int32)
        v = column[o]
        rank = np.cumsum(np.concatenate([[0], v[1:] > v[:-1]])).astype(np.int32) if n else np.zeros(0, np.int32)
        if spec.random_cuts:
            kind = np.uint16 if rank[-1] < 2**16 else np.int32
            codes.append(np.empty(n, kind))
            codes[f][o] = rank
            values.append(v[np.searchsorted(rank, np.arange(rank[-1] + 1))])
        else:
            ranks[f, o] = np.arange(n, dtype=np.int32)
            by_place.append((o, rank))
    bits = max(1, int(n).bit_length())
    # the rows that are left, node by node
    every = np.arange(n, dtype=np.int32) if spec.random_cuts or not spec.width else by_place[0][0]
    seeds, counts, first = np.array([seed], np.uint64), np.array([n]), 0
    gains, levels = np.zeros(spec.width), []
    while True:
        m = len(counts)
        of = np.repeat(np.arange(m), counts)
        total = rows.totals(every, of, m)
        owns = rows.own(every) if spec.random_cuts else []
        parent = spec.score(total)
        live = spec.impure(total) & (counts > 1) & (depth > 0)
        best, feature, cut, tried = np.full(m, -np.inf), np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
        last = np.full(m, -1, np.int32)  # the largest rank or place on the left side
        place_of = np.argsort(spec.order(seeds), axis=1)  # when a node tries each feature
        at_place, seen = np.full(m, spec.width), np.zeros(m, np.int64)
        while True:
            # as many features as a node lacks are looked at for sure, so all of them together;
            # exact cuts of numbers one by one, as their running sums round by what stands before
            lacks = spec.tried - tried if spec.classes or spec.random_cuts else np.minimum(spec.tried - tried, 1)
            reach = np.where(live, np.minimum(seen + lacks, spec.width), seen)
            if not (reach > seen).any():
                break
            for f in range(spec.width):
                turn = place_of[:, f]
                chosen = (turn >= seen) & (turn < reach)
                if not chosen.any():
                    continue
                o, nodes, own = every, of, owns
                if not chosen.all():
                    take = np.flatnonzero(np.repeat(chosen, counts))
                    o, nodes, own = o[take], of[take], [c[take] for c in own]
                who = np.flatnonzero(chosen)
                begin = np.cumsum(counts[who]) - counts[who]
                if spec.random_cuts:
                    v = codes[f][o]
                    low, high = values[f][np.minimum.reduceat(v, begin)], values[f][np.maximum.reduceat(v, begin)]
                    fine = high > low
                    spot = np.searchsorted(values[f], spec.draw(seeds[who], f, low, high), side="right") - 1
                    left = rows.sides(own, nodes, who, begin, m, v <= np.repeat(spot.astype(v.dtype), counts[who]))
                    who, points = who[fine], spec.draw(seeds[who[fine]], f, low[fine], high[fine])
                    gain = spec.score(left[:, who]) + spec.score(total[: len(left), who] - left[:, who]) - parent[who]
                    ends = spot[fine].astype(np.int32)
                else:
                    # sorted by node and place; the nodes stand in order already
                    kind = np.uint32 if m.bit_length() + bits <= 32 else np.uint64
                    places = (nodes.astype(kind) << kind(bits)) | ranks[f][o].astype(kind)
                    places.sort()
                    places = (places & kind((1 << bits) - 1)).astype(np.int32)
                    o, v = by_place[f][0][places], by_place[f][1][places]
                    spots = np.flatnonzero((nodes[1:] == nodes[:-1]) & (v[1:] > v[:-1]))
                    if not len(spots):
                        continue
                    at = nodes[spots]
                    score = _split_score(spec, rows.before(o, nodes, begin, who, m, spots), total, at)
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    top = np.maximum.reduceat(score, edge)
                    who = at[edge]
                    hits = np.flatnonzero(score == np.repeat(top, np.diff(np.append(edge, len(at)))))
                    hits = hits[np.concatenate([[True], at[hits[1:]] != at[hits[:-1]]])]
                    spot = spots[hits]
                    gain, ends = top - parent[who], places[spot]
                    a, b = x[f][o[spot]], x[f][o[spot + 1]]
                    points = (a + b) / 2
                    points = np.where((points < b) & (points >= a), points, a)
                tried[who] += 1
                better = (gain > best[who]) | ((gain == best[who]) & (turn[who] < at_place[who]))
                which = who[better]
                best[which], feature[which], cut[which], last[which] = gain[better], f, points[better], ends[better]
                at_place[which] = turn[which]
            seen = reach
        split = feature >= 0
        gains += np.bincount(feature[split], np.maximum(best[split], 0.0), spec.width)
        place = np.cumsum(split) - 1
        below = np.where(split, first + m + 2 * place, -1)
        level = {"feature": feature.astype(np.int32), "cut": cut, "left": below.astype(np.int32)}
        if spec.keep:
            level["value"] = total.T
        levels.append(level)
        if not split.any():
            break
        take = None if split.all() else np.flatnonzero(np.repeat(split, counts))
        nodes = of if take is None else of[take]
        kept_counts = counts[split]
        begin = np.cumsum(kept_counts) - kept_counts
        o = every if take is None else every[take]
        if spec.random_cuts:
            is_right = np.empty(len(o), bool)
            by = np.repeat(feature[split], kept_counts)
            for f in np.unique(feature[split]):
                mine = np.flatnonzero(by == f)
                is_right[mine] = codes[f][o[mine]] > last[nodes[mine]]
        else:
            is_right = ranks.ravel()[feature[nodes] * n + o] > last[nodes]
        side = 2 * place.astype(np.int32)[nodes]
        sides = np.bincount(side + is_right, minlength=2 * len(kept_counts))
        to = np.cumsum(sides) - sides
        # a right row moves to its rank among the right rows, a left one to that among the left
        shift_right = np.repeat(to[1::2], kept_counts)
        shift_left = np.repeat(to[::2] - begin, kept_counts) + np.arange(len(o))
        rights = np.cumsum(is_right) - is_right
        rights -= np.repeat(rights[begin], kept_counts)
        every = np.empty_like(o)
        every[np.where(is_right, shift_right + rights, shift_left - rights)] = o
        counts, seeds, first, depth = sides, children(seeds[split]), first + m, depth - 1
    return {k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}, gains


def _split_score(spec: Spec, left: list[np.ndarray], total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``score`` of both sides of every spot; both have rows."""
    if not spec.classes:
        w, s = left
        return s * s / w + (total[1][at] - s) ** 2 / (total[0][at] - w)
    a = square_a = square_b = 0.0
    for own, whole in zip(left, total):
        rest = whole[at] - own
        a, square_a, square_b = a + own, square_a + own * own, square_b + rest * rest
    return square_a / a + square_b / (total.sum(axis=0)[at] - a)


def _between(a: float, b: float) -> float:
    """The cut between two neighbouring values."""
    middle = (a + b) / 2
    return float(middle if a <= middle < b else a)


@dataclass
class _Tree:
    """The upper part of one tree. A leaf that is finished elsewhere has feature -2 - part."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)
    seed: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    parts: list = field(default_factory=list)

    def add(self, value: np.ndarray, seed, depth: int) -> int:
        for into, x in zip((self.feature, self.cut, self.left, self.value, self.seed, self.depth), (-1, 0.0, -1, value, seed, depth)):
            into.append(x)
        return len(self.feature) - 1

    def hand_over(self, node: int) -> None:
        self.parts.append((np.uint64(self.seed[node]), self.depth[node]))
        self.feature[node] = -1 - len(self.parts)

    def packed(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature, np.int32), "cut": np.array(self.cut), "left": np.array(self.left, np.int32), "value": np.array(self.value)}


def route(packed: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x`` (features, rows)."""
    at = np.zeros(x.shape[1], np.int64)
    todo = np.flatnonzero(packed["feature"][at] >= 0)
    while len(todo):
        f = packed["feature"][at[todo]]
        at[todo] = packed["left"][at[todo]] + (x[f, todo] > packed["cut"][at[todo]])
        todo = todo[packed["feature"][at[todo]] >= 0]
    return at


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (width, rows), labels, keys of a batch of (x, label, key)."""
    flat = np.asarray(batch.column("x").flatten(), np.float64)
    return np.ascontiguousarray(flat.reshape(len(batch), width).T), np.asarray(batch.column("label"), np.float64), np.asarray(batch.column("key"), np.int64)


PART = "tree int, part int, feature binary, cut binary, left binary, value binary, gains binary"


def _part(spec: Spec, tree: int, part: int, nodes: dict[str, np.ndarray], gains: np.ndarray) -> pa.RecordBatch:
    packed = [nodes[k].tobytes() if spec.keep else b"" for k in ("feature", "cut", "left")] + [nodes["value"].tobytes() if spec.keep else b"", gains.tobytes()]
    arrays = [pa.array([tree], pa.int32()), pa.array([part], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]]
    return pa.RecordBatch.from_arrays(arrays, names=["tree", "part", "feature", "cut", "left", "value", "gains"])


CELL = "cell long, stat int, total double"


class _Store:
    """Dense sums or maxima of one task; only cells that were met leave it."""

    def __init__(self, size: int, width: int, empty):
        self.dense, self.empty = np.full((size, width), empty), empty

    def cells(self) -> pa.RecordBatch:
        cell, stat = np.nonzero(self.dense != self.empty)
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(stat.astype(np.int32)), pa.array(self.dense[cell, stat])], names=["cell", "stat", "total"])


class _Growing:
    """Upper levels of all trees, over a written table of (x, label, key)."""

    def __init__(self, spec: Spec, rows: DataFrame, n: int, total: np.ndarray):
        self.spec, self.rows = spec, rows
        self.room = max(2, (min(CELLS, RANDOM_CELLS) if spec.random_cuts else CELLS) // (spec.width + spec.stats))
        self.trees = [_Tree() for _ in range(spec.trees)]
        self.gains = np.zeros((spec.trees, spec.width))
        self.open: list[tuple[int, int]] = []
        totals = self._weighted() if spec.bootstrap and n > self.room else [total] * spec.trees
        for t, tree in enumerate(self.trees):
            self._place(t, tree.add(totals[t], spec.root(t), spec.depth), n)

    def _place(self, t: int, node: int, weight: float) -> None:
        tree = self.trees[t]
        if weight <= self.room:
            tree.hand_over(node)
        elif tree.depth[node] > 0 and bool(self.spec.impure(np.asarray(tree.value[node])[:, None])[0]):
            self.open.append((t, node))

    def run(self) -> None:
        edges = self._edges() if self.open and not self.spec.random_cuts else None
        while self.open:
            spec, nodes = self.spec, self.open
            looked = spec.width if spec.random_cuts else min(spec.width, max(2 * spec.tried, 8))
            bins = 1 if spec.random_cuts else BINS
            step = max(1, PASS_CELLS // (looked * bins * spec.stats))
            self.open = []
            for i in range(0, len(nodes), step):
                self._level(nodes[i : i + step], looked, edges)

    def _edges(self) -> np.ndarray:
        """Cuts (features, BINS - 1) at the quantiles of each feature."""
        names = [f"x{i}" for i in range(self.spec.width)]
        found = quantiles(self.rows.select(*[F.get("x", i).alias(c) for i, c in enumerate(names)]), names, [i / BINS for i in range(1, BINS)])
        return np.array([found[c] for c in names], np.float64)

    def _weighted(self) -> np.ndarray:
        """(trees, stats) over all rows with their weights in each tree."""
        spec = self.spec

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((spec.trees, spec.stats))
            for batch in batches:
                _, y, key = _columns(batch, spec.width)
                for t in range(spec.trees):
                    total[t] += spec.table(y, spec.weights(t, key)).sum(axis=1)
            tree, stat = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(stat.astype(np.int32)), pa.array(total[tree, stat])], names=["cell", "stat", "total"])

        out = np.zeros((spec.trees, spec.stats))
        for r in self.rows.mapInArrow(count, CELL).groupBy("cell", "stat").agg(F.sum("total").alias("total")).collect():
            out[r["cell"], r["stat"]] = r["total"]
        return out

    def _cells(self, nodes: list[tuple[int, int]], how, cells) -> pa.Table:
        """Sums or extremes over all rows of what ``cells`` makes of each tree's rows, which
        come by slot; the slots of a tree are neighbours."""

        def count(each) -> Iterator[pa.RecordBatch]:
            store = None
            for taken in each:
                store = cells(store, *taken)
            if store is not None:
                yield store.cells()

        return self._taken(nodes, count, CELL).groupBy("cell", "stat").agg(how.alias("total")).toArrow()

    def _taken(self, nodes: list[tuple[int, int]], use, schema: str) -> DataFrame:
        """What ``use`` yields of the rows of ``nodes``, batch by batch and tree by tree: features,
        labels, weights, slots, and the tree's first slot and the one after its last."""
        spec = self.spec
        slots = {}
        for slot, (t, node) in enumerate(nodes):
            slots.setdefault(t, {})[node] = slot
        state = self.rows.sparkSession.sparkContext.broadcast({t: (self.trees[t].packed(), own) for t, own in slots.items()})

        def taken(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                x, y, key = _columns(batch, spec.width)
                for t, (packed, own) in state.value.items():
                    w = spec.weights(t, key)
                    slot_of = np.full(len(packed["feature"]), -1)
                    slot_of[list(own)] = list(own.values())
                    slot = slot_of[route(packed, x)]
                    take = np.flatnonzero((slot >= 0) & (w > 0))
                    if len(take):
                        take = take[np.argsort(slot[take], kind="stable")]
                        yield x[:, take], y[take], w[take], slot[take], min(own.values()), max(own.values()) + 1

        return self.rows.mapInArrow(lambda batches: use(taken(batches)), schema)

    def _level(self, nodes: list[tuple[int, int]], looked: int, edges: np.ndarray | None) -> None:
        spec = self.spec
        seeds = np.array([self.trees[t].seed[i] for t, i in nodes], np.uint64)
        order = spec.order(seeds)[:, :looked]
        total = np.array([self.trees[t].value[i] for t, i in nodes]).T
        stats = spec.stats

        def gathered(found: pa.Table, size: int, width: int, empty: float) -> np.ndarray:
            out = np.full((size, width), empty)
            out[np.asarray(found["cell"]), np.asarray(found["stat"])] = np.asarray(found["total"])
            return out

        size = len(nodes) * looked
        place_of = np.argsort(order, axis=1) if looked == spec.width else None
        if spec.random_cuts:
            def ranges(store, x, y, w, slot, low, high):
                store = store or _Store(size, 2, -np.inf)
                begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                met = slot[begin]
                cell = (met[:, None] * looked + place_of[met]).ravel()
                for side, v in enumerate((-np.minimum.reduceat(x, begin, axis=1), np.maximum.reduceat(x, begin, axis=1))):
                    store.dense[cell, side] = np.maximum(store.dense[cell, side], v.T.ravel())
                return store

            reach = gathered(self._cells(nodes, F.max("total"), ranges), size, 2, -np.inf).reshape(len(nodes), looked, 2)
            low, high = -reach[:, :, 0], reach[:, :, 1]
            cuts = np.stack([np.array([spec.draw(seeds[i : i + 1], int(order[i, p]), low[i, p : p + 1], high[i, p : p + 1])[0] for i in range(len(nodes))]) for p in range(looked)], axis=1)
            cut_of = np.take_along_axis(cuts, place_of, axis=1)

            def sides(store, x, y, w, slot, low, high):
                store = store or _Store(size, stats, 0.0)
                begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                met = slot[begin]
                cell = (met[:, None] * looked + place_of[met]).ravel()
                below = x <= cut_of[slot].T
                for k, own in enumerate(spec.table(y, w)):
                    store.dense[cell, k] += np.add.reduceat(below * own, begin, axis=1).T.ravel()
                return store

            left = gathered(self._cells(nodes, F.sum("total"), sides), size, stats, 0.0).reshape(len(nodes), looked, 1, stats)
            points = cuts[:, :, None]
            valid = (high > low)[:, :, None]
        else:
            return self._best(nodes, looked, edges, order, place_of, total)
        for i, (t, node) in enumerate(nodes):
            own = total[:, i]
            l = left[i].reshape(-1, stats).T
            gain = spec.score(l) + spec.score(own[:, None] - l) - spec.score(own[:, None])
            gain = np.where(valid[i].ravel(), gain, -np.inf).reshape(looked, -1)
            usable = np.flatnonzero(np.isfinite(gain).any(axis=1))[: spec.tried]
            if not len(usable):
                continue  # no looked-at feature cuts it: a leaf
            place = usable[int(np.argmax(gain[usable].max(axis=1)))]
            spot = int(np.argmax(gain[place]))
            self._split(t, node, int(order[i, place]), float(points[i, place, spot]), float(gain[place, spot]), left[i, place, spot])

    def _split(self, t: int, node: int, feature: int, cut: float, gain: float, below: np.ndarray) -> None:
        tree = self.trees[t]
        self.gains[t, feature] += max(gain, 0.0)
        pair = children(np.array([tree.seed[node]], np.uint64))
        a = tree.add(below, pair[0], tree.depth[node] - 1)
        b = tree.add(np.asarray(tree.value[node]) - below, pair[1], tree.depth[node] - 1)
        tree.feature[node], tree.cut[node], tree.left[node] = feature, cut, a
        for child in (a, b):
            value = np.asarray(tree.value[child])
            self._place(t, child, float(value.sum() if self.spec.classes else value[0]))

    def _best(self, nodes: list[tuple[int, int]], looked: int, edges: np.ndarray, order: np.ndarray, place_of: np.ndarray | None, total: np.ndarray) -> None:
        """Split each node at the best cut of the features that it tries."""
        spec, stats, size = self.spec, self.spec.stats, len(nodes) * looked * BINS
        empty = np.array([0.0] * stats + [-np.inf] * 2)

        def each_bin(x, slot):
            """Rows by feature, and their bins."""
            for f in range(spec.width):
                where = place_of[slot, f] if place_of is not None else np.where(order[slot] == f, np.arange(looked), -1).max(axis=1)
                mine = np.flatnonzero(where >= 0)
                if len(mine):
                    yield x[f, mine], mine, (slot[mine] * looked + where[mine]) * BINS + np.searchsorted(edges[f], x[f, mine], side="left")

        def bins(store, x, y, w, slot, low, high):
            store = store or _Store(size, stats + 2, empty)
            s, base = spec.table(y, w), low * looked * BINS
            own = slice(base, high * looked * BINS)
            for v, mine, cell in each_bin(x, slot):
                for k in range(stats):
                    store.dense[own, k] += np.bincount(cell - base, s[k, mine], own.stop - base)
                by = np.argsort(cell, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], np.diff(cell[by]) > 0]))
                met = cell[by[begin]]
                for side, sign in ((stats, -1.0), (stats + 1, 1.0)):
                    store.dense[met, side] = np.fmax(store.dense[met, side], np.fmax.reduceat(sign * v[by], begin))
            return store

        found = self._cells(nodes, F.when(F.first("stat") < stats, F.sum("total")).otherwise(F.max("total")), bins)
        dense = np.tile(empty, (size, 1))
        dense[np.asarray(found["cell"]), np.asarray(found["stat"])] = np.asarray(found["total"])
        dense = dense.reshape(len(nodes), looked, BINS, stats + 2)
        hist, least, most = dense[..., :stats], -dense[..., stats], dense[..., stats + 1]
        after = np.cumsum(hist, axis=2)
        before = after - hist
        usable = least.min(axis=2) < most.max(axis=2)
        tries = usable & (np.cumsum(usable, axis=1) <= spec.tried)
        best: list[tuple] = [(-np.inf,)] * len(nodes)  # score, -place, -cut, left side
        wanted = np.zeros((len(nodes), looked, BINS), bool)  # bins with a cut that may be better
        lacking = [] if looked == spec.width else np.flatnonzero(tries.sum(axis=1) < spec.tried).tolist()
        for i in set(range(len(nodes))) - set(lacking):
            own = total[:, i : i + 1]
            bounds = np.full((looked, BINS), -np.inf)
            for p in np.flatnonzero(tries[i]):
                full = np.flatnonzero(most[i, p] > -np.inf)
                low, high = most[i, p, full[:-1]], least[i, p, full[1:]]
                split = np.flatnonzero(low < high)
                if len(split):
                    left = after[i, p, full[split]].T
                    score = _split_score(spec, list(left[: stats if spec.classes else 2]), own, np.zeros(len(split), int))
                    at = int(np.argmax(score))
                    best[i] = max(best[i], (float(score[at]), -int(p), -_between(low[split[at]], high[split[at]]), left[:, at]), key=lambda c: c[:3])
                # cut out and sorted by label at best, a bin cannot add more than this
                pure = hist[i, p].sum(axis=1) if spec.classes else hist[i, p, :, 2]
                rest = np.maximum(own - after[i, p].T, 0.0) if spec.classes else own - after[i, p].T
                bounds[p] = np.where(least[i, p] < most[i, p], spec.score(before[i, p].T) + spec.score(rest) + pure, -np.inf)
            wanted[i] = bounds * (1 + 1e-9) >= max(best[i][0], np.finfo(float).min)
        if wanted.any():
            for r in self._inside(nodes, each_bin, wanted.ravel(), before.reshape(-1, stats), total, looked).collect():  # one row a bin
                i, p = r["cell"] // (looked * BINS), r["cell"] // BINS % looked
                best[i] = max(best[i], (r["score"], -p, -r["cut"], np.array(r["below"])), key=lambda c: c[:3])
        for i, (t, node) in enumerate(nodes):
            if len(best[i]) > 1:
                gain = best[i][0] - float(spec.score(total[:, i : i + 1])[0])
                self._split(t, node, int(order[i, -best[i][1]]), -best[i][2], gain, best[i][3])
        if lacking:  # too few of the features looked at have two values
            step = max(1, PASS_CELLS // (spec.width * BINS * stats))
            for i in range(0, len(lacking), step):
                self._level([nodes[j] for j in lacking[i : i + step]], spec.width, edges)

    def _inside(self, nodes: list[tuple[int, int]], each_bin, wanted: np.ndarray, before: np.ndarray, total: np.ndarray, looked: int) -> DataFrame:
        """The best cut inside each of the ``wanted`` bins, from all its values: cell, score, cut,
        below (the sums of the left side of the node)."""
        spec, stats = self.spec, self.spec.stats
        at = np.flatnonzero(wanted)
        held = self.rows.sparkSession.sparkContext.broadcast((wanted, dict(zip(at.tolist(), before[at])), total))

        def values(each) -> Iterator[pa.RecordBatch]:
            for x, y, w, slot, _, _ in each:
                s = spec.table(y, w)
                for v, mine, cell in each_bin(x, slot):
                    take = np.flatnonzero(held.value[0][cell])
                    if not len(take):
                        continue
                    v, mine, cell = v[take], mine[take], cell[take]
                    by = np.lexsort((v, cell))
                    v, cell = v[by], cell[by]
                    begin = np.flatnonzero(np.concatenate([[True], (v[1:] > v[:-1]) | (cell[1:] != cell[:-1])]))
                    sums = np.add.reduceat(s[:, mine[by]], begin, axis=1).T
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, stats, dtype=np.int32)), pa.array(np.ascontiguousarray(sums).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[begin]), pa.array(v[begin]), lists], names=["cell", "value", "sums"])

        def pick(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            cell = table["cell"][0].as_py()
            v = np.asarray(table["value"].combine_chunks(), np.float64)
            sums = np.asarray(table["sums"].combine_chunks().flatten(), np.float64).reshape(-1, stats)
            by = np.argsort(v, kind="stable")
            v = v[by]
            begin = np.flatnonzero(np.concatenate([[True], v[1:] > v[:-1]]))
            left = held.value[1][cell] + np.cumsum(np.add.reduceat(sums[by], begin, axis=0), axis=0)[:-1]
            v = v[begin]
            out = {"cell": [], "score": [], "cut": [], "below": []}
            if len(left):
                own = held.value[2][:, cell // (looked * BINS)][:, None]
                score = _split_score(spec, list(left.T[: stats if spec.classes else 2]), own, np.zeros(len(left), int))
                i = int(np.argmax(score))
                out = {"cell": [cell], "score": [float(score[i])], "cut": [_between(v[i], v[i + 1])], "below": [left[i].tolist()]}
            return pa.table(out, schema=pa.schema([("cell", pa.int64()), ("score", pa.float64()), ("cut", pa.float64()), ("below", pa.list_(pa.float64()))]))

        dealt = self._taken(nodes, values, "cell long, value double, sums array<double>")
        return dealt.groupBy("cell").applyInArrow(pick, "cell long, score double, cut double, below array<double>")

    def finished(self) -> DataFrame:
        """``PART`` rows of all nodes that were handed over."""
        spec, spark = self.spec, self.rows.sparkSession
        todo = spark.sparkContext.broadcast([(t.packed(), t.parts) for t in self.trees])
        bytes_all = self.rows.count() * 8 * (spec.width + 2)
        if bytes_all <= 2 * LIMITS.broadcast_bytes and all(len(t.feature) == 1 for t in self.trees):
            table = self.rows.orderBy("key").toArrow().combine_chunks()
            batch = table.to_batches()[0] if table.num_rows else None
            data = spark.sparkContext.broadcast(_columns(batch, spec.width) if batch is not None else None)

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for ids in batches:
                    for t in ids.column(0).to_pylist():
                        x, y, key = data.value
                        w = spec.weights(t, key)
                        use = np.flatnonzero(w > 0)
                        seed, depth = todo.value[t][1][0]
                        if len(use):
                            yield _part(spec, t, 0, *grow(spec, x[:, use], y[use], w[use], seed, depth))

            tasks = min(spec.trees, 2 * spark.sparkContext.defaultParallelism)
            return spark.range(0, spec.trees, 1, tasks).mapInArrow(alone, PART)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, key = _columns(batch, spec.width)
                line = np.concatenate([x.view(np.int64), y.view(np.int64)[None], key[None]]).T
                for t, (packed, _) in enumerate(todo.value):
                    w = spec.weights(t, key)
                    part = -2 - packed["feature"][route(packed, x)]
                    use = np.flatnonzero((part >= 0) & (w > 0))
                    if not len(use):
                        continue
                    use = use[np.argsort(part[use], kind="stable")]
                    begin = np.flatnonzero(np.concatenate([[True], part[use[1:]] != part[use[:-1]]]))
                    rows = [line[own].tobytes() for own in np.split(use, begin[1:])]
                    arrays = [pa.array(np.full(len(rows), t, np.int32)), pa.array(part[use[begin]].astype(np.int32)), pa.array(rows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["tree", "part", "rows"])

        def finish(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            t, part = (g.as_py() for g in group)
            lines = [np.frombuffer(r.as_buffer(), np.int64).reshape(-1, spec.width + 2) for r in table["rows"]]
            key = np.concatenate([r[:, -1] for r in lines])
            order = np.argsort(key, kind="stable")
            y = np.concatenate([r[:, -2] for r in lines])[order].view(np.float64)
            x = np.empty((spec.width, len(key)))
            for f in range(spec.width):
                x[f] = np.concatenate([r[:, f] for r in lines])[order].view(np.float64)
            key = key[order]
            del lines, table, order
            seed, depth = todo.value[t][1][part]
            return pa.Table.from_batches([_part(spec, t, part, *grow(spec, x, y, spec.weights(t, key), seed, depth))])

        dealt = self.rows.mapInArrow(deal, "tree int, part int, rows binary")
        return dealt.groupBy("tree", "part").applyInArrow(finish, PART)


def _nodes(row, stats: int) -> dict[str, np.ndarray]:
    """The nodes of a ``PART`` row."""
    kinds = {"feature": np.int32, "cut": np.float64, "left": np.int32, "value": np.float64}
    nodes = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
    return nodes | {"value": nodes["value"].reshape(-1, stats)}


@dataclass
class TreesModel:
    """``parts``: one row a finished part of a tree; ``tops``: the upper part of each tree."""

    spec: Spec
    parts: DataFrame
    tops: list[dict[str, np.ndarray]]
    importances: np.ndarray

    def _loaded(self, rows: list) -> dict[int, dict[int, dict[str, np.ndarray]]]:
        out: dict[int, dict[int, dict[str, np.ndarray]]] = {}
        for r in rows:
            out.setdefault(r["tree"], {})[r["part"]] = _nodes(r, self.spec.stats)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the class with the largest mean share (ties to the
        first), or the mean of the leaves."""
        spark, spec = df.sparkSession, self.spec
        sizes = self.parts.groupBy("tree").agg(F.sum(F.length("feature") + F.length("cut") + F.length("left") + F.length("value")).alias("n")).orderBy("tree").collect()
        if any(r["n"] > MODEL_BYTES for r in sizes):
            return self._dealt(df)
        rounds, room = [[]], MODEL_BYTES
        for r in sizes:
            if rounds[-1] and r["n"] > room:
                rounds.append([])
                room = MODEL_BYTES
            rounds[-1].append(r["tree"])
            room -= r["n"]
        names = df.columns
        out = df.withColumn("_votes", F.array_repeat(F.lit(0.0), spec.classes or 1))
        for i, trees in enumerate(rounds):
            own = self._loaded(self.parts.where(F.col("tree").isin(trees)).collect())
            for t in range(spec.trees):
                if t in trees or (i == 0 and not any(t in r for r in rounds)):
                    own.setdefault(t, {})
            held = spark.sparkContext.broadcast({t: (self.tops[t], parts) for t, parts in own.items()})

            @F.pandas_udf(T.ArrayType(T.DoubleType()))
            def voted(features, votes):
                import pandas as pd

                if not len(features):
                    return pd.Series([], dtype=object)
                x, total = np.ascontiguousarray(np.stack(features.to_numpy()).T), np.stack(votes.to_numpy()).copy()
                for top, parts in held.value.values():
                    leaf = route(top, x)
                    value = top["value"][leaf].copy()
                    part = -2 - top["feature"][leaf]
                    for p in np.unique(part[part >= 0]):
                        mine = np.flatnonzero(part == p)
                        if p in parts:  # without rows in the tree, its upper part decides
                            value[mine] = parts[p]["value"][route(parts[p], x[:, mine])]
                    total += value / value.sum(axis=1, keepdims=True) if spec.classes else value[:, 1:2] / value[:, :1]
                return pd.Series(list(total))

            out = out.withColumn("_votes", voted(vector_to_array("features"), "_votes"))
            if i + 1 < len(rounds):
                out = materialize(out)
        return self._decided(out, names)

    def _decided(self, voted: DataFrame, names: list[str]) -> DataFrame:
        best = F.array_position("_votes", F.array_max("_votes")) - 1 if self.spec.classes else F.get("_votes", 0) / self.spec.trees
        return voted.withColumn("prediction", best.cast("double")).select(*[F.col(f"`{c}`") for c in names], "prediction")

    def _dealt(self, df: DataFrame) -> DataFrame:
        """As ``transform`` for trees that are too large to be sent whole: a row goes to the
        part of each tree that it falls into, and its votes come back in the order of the trees."""
        spark, spec, names = df.sparkSession, self.spec, df.columns
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        held = spark.sparkContext.broadcast(self.tops)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))

        def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                line = np.asarray(batch.column("x").flatten(), np.float64).reshape(len(batch), spec.width)
                x = np.ascontiguousarray(line.T)
                for t, top in enumerate(held.value):
                    leaf = route(top, x)
                    part = -2 - top["feature"][leaf]
                    arrays = [batch.column("_row"), pa.array(np.full(len(leaf), t, np.int32)), pa.array(np.maximum(part, -1).astype(np.int32)), lists(line), lists(np.ascontiguousarray(top["value"][leaf], np.float64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["_row", "tree", "part", "x", "value"])

        fallen = materialize(rows.select("_row", vector_to_array("features").alias("x")).mapInArrow(fall, "_row long, tree int, part int, x array<double>, value array<double>"))
        shares = fallen.groupBy("tree", "part").agg(F.ceil(F.count(F.lit(1)) / DEALT_ROWS).cast("int").alias("shares"))
        shares = F.broadcast(shares.where("part >= 0"))  # one row a finished part
        asked = fallen.where("part >= 0").join(shares, ["tree", "part"]).withColumn("share", F.pmod(F.xxhash64("_row"), F.col("shares")).cast("int")).drop("shares")
        parts = self.parts.drop("gains").join(shares, ["tree", "part"]).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).drop("shares")

        def look(asking: pa.Table, part: pa.Table) -> pa.Table:
            asking = asking.combine_chunks()
            value = np.asarray(asking["value"].combine_chunks().flatten(), np.float64).reshape(-1, spec.stats)
            if len(asking) and len(part):  # without rows in the tree, its upper part decides
                nodes = _nodes(part.to_pylist()[0], spec.stats)
                x = np.ascontiguousarray(np.asarray(asking["x"].combine_chunks().flatten(), np.float64).reshape(len(asking), spec.width).T)
                value = nodes["value"][route(nodes, x)]
            return pa.table({"_row": asking["_row"], "tree": asking["tree"], "value": lists(np.ascontiguousarray(value))})

        at = ["tree", "part", "share"]
        found = asked.groupBy(*at).cogroup(parts.groupBy(*at)).applyInArrow(look, "_row long, tree int, value array<double>")
        every = found.unionByName(fallen.where("part < 0").select("_row", "tree", "value"))
        votes = every.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("_all"))
        zero = F.array_repeat(F.lit(0.0), spec.classes or 1)
        if spec.classes:
            own = lambda e: F.transform(e["value"], lambda v: v / F.aggregate(e["value"], F.lit(0.0), lambda a, w: a + w))
        else:
            own = lambda e: F.array(e["value"][1] / e["value"][0])
        summed = F.aggregate("_all", zero, lambda a, e: F.zip_with(a, own(e), lambda v, w: v + w))
        voted = rows.join(votes.select("_row", summed.alias("_votes")), "_row")
        return self._decided(voted, names)

    def save(self, path: str) -> None:
        spark, spec = self.parts.sparkSession, self.spec
        self.parts.drop("gains").write.parquet(f"{path}/parts")
        tops = [(t, *[bytearray(top[k].tobytes()) for k in ("feature", "cut", "left", "value")]) for t, top in enumerate(self.tops)]
        spark.createDataFrame(tops, "tree int, feature binary, cut binary, left binary, value binary").write.parquet(f"{path}/tops")
        meta = [(spec.classes, spec.width, spec.tried, spec.trees, spec.depth, spec.bootstrap, spec.random_cuts, spec.seed, self.importances.tolist())]
        schema = "classes int, width int, tried int, trees int, depth int, bootstrap boolean, random_cuts boolean, seed long, importances array<double>"
        spark.createDataFrame(meta, schema).coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreesModel":
        m = spark.read.parquet(f"{path}/meta").first()
        model = TreesModel(Spec(*m[:8]), spark.read.parquet(f"{path}/parts"), [], np.array(m["importances"]))
        tops = spark.read.parquet(f"{path}/tops").withColumn("part", F.lit(0)).orderBy("tree").collect()
        loaded = model._loaded(tops)
        model.tops = [loaded[t][0] for t in range(model.spec.trees)]
        return model


@dataclass
class Trees:
    """Forest or extra trees over ``features`` (vector) and ``label``; ``classes`` 0 for a
    numeric label, else labels are 0 to classes - 1.

    ``depth`` None grows until leaves are pure. ``features`` tried a node: "sqrt", "third"
    or "all". A bootstrap gives each row a Poisson weight a tree, by the hash of ``key``
    (a number a row); without it and with random cuts no row is left out.
    """

    classes: int
    trees: int = 100
    depth: int | None = None
    features: str = "sqrt"
    bootstrap: bool = True
    random_cuts: bool = False
    seed: int = 42
    key: str | None = None
    keep: bool = True

    def fit(self, df: DataFrame) -> TreesModel:
        key = F.xxhash64(F.col(f"`{self.key}`")) if self.key else F.monotonically_increasing_id()
        rows = spread(df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), key.alias("key")), "key")
        by_class = [F.sum(F.when(F.col("label") == c, 1.0).otherwise(0.0)) for c in range(self.classes)]
        sums = by_class or [F.count(F.lit(1)).cast("double"), F.sum("label"), F.sum(F.col("label") * F.col("label"))]
        fact = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        if not fact["n"]:
            raise ValueError("no rows to fit")
        width = fact["width"]
        tried = {"sqrt": max(1, int(sqrt(width))), "third": max(1, ceil(width / 3)), "all": width}[self.features]
        depth = self.depth if self.depth is not None else 1_000_000
        spec = Spec(self.classes, width, tried, self.trees, depth, self.bootstrap, self.random_cuts, self.seed, self.keep)
        growing = _Growing(spec, rows, fact["n"], np.array([fact[f"s{i}"] or 0.0 for i in range(len(sums))], np.float64))
        growing.run()
        parts = materialize(growing.finished())
        gains = growing.gains.copy()
        for r in parts.select("tree", "gains").toLocalIterator():  # one short row a finished part
            gains[r["tree"]] += np.frombuffer(r["gains"], np.float64)
        totals = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).mean(axis=0)
        shares = shares / shares.sum() if shares.sum() > 0 else shares
        return TreesModel(spec, parts, [t.packed() for t in growing.trees], shares)
