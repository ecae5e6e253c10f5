"""Random forests of all folds side by side, on the blocks of counts of linear.Blocks. Each fold's trees grow in one task
(or several, where there are more cores than folds) from whole arrays: no row is shuffled by tree, and no text is a dense vector."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators import linear
from lexloom.session import cut

#: Bins of a feature (0: the row has no such term), drawn rows that a pass over the levels and a step take at once, cells
#: of a dense table of rows to guess.
BINS, PASS, STEP, CELLS = 32, 12_000_000, 500_000, 8_000_000


def guesses(made: linear.Blocks, specs: list[tuple[tuple[str, ...], object]], trees: int, depth: int, seed: int) -> DataFrame:
    """(key, fold, y, spec, yhat, score) of the rows of each fold by forests fitted on the others, as of pyspark.ml: a row
    counts Poisson(1) times in a tree, a node tries the root of the number of features, in at most BINS bins, by Gini; the
    score is the mean over trees of the class shares at the leaf."""
    names, folds, sc = made.names, made.folds, made.blocks.sparkSession.sparkContext
    parts = max(1, min(trees, sc.defaultParallelism // (len(folds) * len(specs))))
    used = np.ones((len(folds), made.width), bool)
    used[:, : made.v] = made.told
    on = [made.columns(blocks, condition) & used for blocks, condition in specs]
    sent = sc.broadcast(pickle.dumps((made._frame(), on)))
    source = made.blocks.select("keys", "data").rdd.coalesce(1)

    def task(spec: int, j: int, part: int):
        def run(rows: Iterator) -> Iterator:
            frame, on = pickle.loads(sent.value)
            keys, fold, label, share = _grown(rows, frame, on[spec][j], j, len(names), range(part, trees, parts), depth, seed)
            for key, y, p in zip(keys, label.tolist(), share, strict=True):
                yield spec, key, fold, y, p.tolist()

        return source.mapPartitions(run)

    fields = (("spec", T.IntegerType()), ("key", made.data.rows.schema["key"].dataType), ("fold", T.IntegerType()), ("label", T.IntegerType()), ("p", T.ArrayType(T.DoubleType())))
    all_parts = sc.union([task(s, j, part) for s in range(len(specs)) for j in range(len(folds)) for part in range(parts)])
    found = made.blocks.sparkSession.createDataFrame(all_parts, T.StructType([T.StructField(n, t) for n, t in fields]), verifySchema=False)
    if parts > 1:
        found = cut(found).groupBy("spec", "key", "fold", "label").agg(F.array(*(F.sum(F.col("p")[i]) for i in range(len(names)))).alias("p"))
    best, named = F.array_max("p"), F.array(*map(F.lit, names))
    return cut(found.select("key", "fold", named[F.col("label")].alias("y"), "spec", named[F.array_position("p", best).cast("int") - 1].alias("yhat"), (best / trees).alias("score")))


def _grown(blocks: Iterator, frame: tuple, on: np.ndarray, j: int, classes: int, trees: range, depth: int, seed: int) -> tuple:
    """Keys, fold and labels of the rows of fold j, and the sums over trees of their class shares."""
    fold, v, square = int(frame[4][0][j]), frame[2], frame[3][:, [j]]
    frame, idf, number = (*frame[:3], square, *frame[4:]), np.sqrt(square[:, 0]).astype(np.float32), np.cumsum(on) - 1
    small, dense = np.uint16 if on.sum() < 1 << 16 else np.uint32, np.flatnonzero(on[v:])
    keys, of, label, many, place, value = [], [], [], [], [], []
    for b in blocks:
        r = linear._Rows(b["data"], frame)
        use = on[r.place]
        own, w = [number[r.place[use]]], [(r.value * idf[r.place] / r.length[r.part, 0])[use]]
        n = np.bincount(r.row[use], minlength=len(r.fold))
        if len(dense):  # these stand in every row, so their zeros have a bin too
            row = np.concatenate((r.row[use], np.repeat(np.arange(len(r.fold)), len(dense))))
            order = np.argsort(row, kind="stable")
            own, w = [np.concatenate((own[0], np.tile(number[v + dense], len(r.fold))))[order]], [np.concatenate((w[0], r.x[:, dense].ravel().astype(np.float32)))[order]]
            n = n + len(dense)
        keys += b["keys"]
        for to, x in ((of, r.fold), (label, r.label), (many, n.astype(np.int32)), (place, own[0].astype(small)), (value, w[0].astype(np.float32))):
            to.append(x)
    of, label, many, place, value = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (of, label, many, place, value))
    train = np.repeat(of != fold, many)
    edges = _edges(place[train], value[train], int(on.sum()))
    bins = _binned(edges, place, value)
    del value
    own, rest = of != fold, np.flatnonzero(of == fold)
    guess = place[~train], bins[~train], many[rest]
    # The rows of a fold stand in the order of their keys for the draws, whatever way they came.
    rows = np.flatnonzero(own)
    order = np.empty(len(rows), np.int64)
    order[sorted(range(len(rows)), key=[keys[i] for i in rows].__getitem__)] = np.arange(len(rows))
    data = _Sorted(place[train], bins[train], many[rows], int(on.sum()))
    label_of, order = label[rows][data.order], order[data.order]
    share = np.zeros((len(rest), classes))
    at_once = max(1, PASS // max(len(rows), 1))
    for i in range(0, len(trees), at_once):
        steps = []
        for t in trees[i : i + at_once]:
            w = np.random.default_rng([seed, fold, t]).poisson(1.0, len(rows)).astype(np.uint8)[order]
            row = np.flatnonzero(w).astype(np.int32)
            if steps and len(steps[-1].row) + len(row) <= STEP:
                steps[-1].add(t, row, w[row])
            else:
                steps.append(_Trees(t, row, w[row], classes, label_of, (seed, fold)))
        for level in range(depth):
            left = [s for s in steps if len(s.row)]
            if not left:
                break
            data.deal(np.random.default_rng([seed, fold, level, 1]))
            for s in left:
                s.split(data)
        _guess(steps, *guess, int(on.sum()), share)
    return [keys[i] for i in rest], fold, label[rest], share


def _codes(place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Numbers in the order of (place, value)."""
    bits = (value + np.float32(0)).view(np.uint32)  # -0 is 0
    return place.astype(np.uint64) << np.uint64(32) | np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _edges(place: np.ndarray, value: np.ndarray, p: int) -> np.ndarray:
    """(place, BINS): the least values of the bins from 1 on: all values that a column has, or as many quantiles."""
    codes, most = np.sort(_codes(place, value)), BINS - 1
    edges = np.full((p, BINS), np.inf, np.float32)

    def values(c: np.ndarray) -> np.ndarray:
        bits = c.astype(np.uint32)
        return np.where(bits >> 31, bits & np.uint32((1 << 31) - 1), ~bits).astype(np.uint32).view(np.float32)

    own = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes
    for c, few in ((codes, False), (own, True)):
        n = np.bincount((c >> np.uint64(32)).astype(np.int64), minlength=p)
        begin = np.cumsum(n) - n
        if few:
            on = np.flatnonzero((n > 0) & (n <= most))
            at = np.arange(most)
            edges[on, :most] = np.where(at < n[on, None], values(c[np.minimum(begin[on, None] + at, len(c) - 1)].ravel()).reshape(-1, most), np.inf) if len(on) else 0
        else:
            on = np.flatnonzero(n)
            if len(on):
                edges[on, :most] = values(c[begin[on, None] + np.arange(most) * n[on, None] // most].ravel()).reshape(-1, most)
    return edges


def _binned(edges: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The bin of each value: how many edges of its column it reaches, 1 at least."""
    out, flat = np.empty(len(place), np.uint8), edges.ravel()
    for a in range(0, len(place), 1_000_000):
        at, v, b = place[a : a + 1_000_000].astype(np.int64) * BINS, value[a : a + 1_000_000], 0
        for s in (16, 8, 4, 2, 1):
            b = b + s * (flat[at + b + (s - 1)] <= v)
        out[a : a + 1_000_000] = np.maximum(b, 1)
    return out


class _Sorted:
    """Rows of (column, bin), for one level at a time sorted by the group that their column is dealt to.

    At each level the columns are dealt anew into groups of the root of their number, and each node of any tree draws a
    group as the features that it tries. So a node tries a uniformly random set, independent of those of the nodes above
    it, and the values of a row in that set are found without reading the row's others.
    """

    def __init__(self, place: np.ndarray, bins: np.ndarray, many: np.ndarray, p: int) -> None:
        self.order = np.argsort(many, kind="stable")  # rows of near lengths together: they are sorted as a table
        begin = (np.cumsum(many) - many)[self.order]
        self.many, self.p = many[self.order], p
        self.begin = np.cumsum(self.many, dtype=np.int64) - self.many
        at = np.arange(len(place)) + np.repeat(begin - self.begin, self.many)
        self.place, self.bins = place[at], bins[at]
        self.groups = max(1, p // math.ceil(math.sqrt(p))) if p else 1
        self.told = np.empty(len(place), np.uint16)
        self.first = np.zeros((len(many), self.groups + 1), np.uint8 if self.many.max(initial=0) < 256 else np.uint32)

    def deal(self, random: np.random.Generator) -> None:
        self.columns = np.array_split(random.permutation(self.p), self.groups)
        code = np.zeros(self.p, np.uint32)
        for g, c in enumerate(self.columns):
            code[c] = g << 16 | np.arange(len(c), dtype=np.uint32) << 5
        a = 0
        while a < len(self.many):
            z = min(len(self.many), a + 20_000)
            z = max(a + 1, a + int(np.searchsorted((np.arange(a, z) - a + 1) * self.many[a:z].astype(np.int64), 4_000_000, "right")))
            lo, hi = self.begin[a], self.begin[z] if z < len(self.many) else len(self.place)
            table = np.full((z - a, int(self.many[z - 1])), 0xFFFFFFFF, np.uint32)
            on = np.arange(table.shape[1]) < self.many[a:z, None]
            table[on] = code[self.place[lo:hi]] | self.bins[lo:hi]
            table.sort(1)
            found = table[on]
            self.told[lo:hi] = found.astype(np.uint16)
            n = np.bincount(np.repeat(np.arange(z - a) * self.groups, self.many[a:z]) + (found >> 16), minlength=(z - a) * self.groups)
            np.cumsum(n.reshape(z - a, -1), 1, out=n.reshape(z - a, -1))
            self.first[a:z, 1:] = n.reshape(z - a, -1)
            a = z

    def values(self, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the values in a group: their index into row, and slot * BINS + bin."""
        flat, at = self.first.ravel(), row * np.int64(self.groups + 1) + group
        low = flat[at].astype(np.int64)
        n = flat[at + 1] - low
        of = np.repeat(np.arange(len(row), dtype=np.int32), n)
        return of, self.told[np.arange(len(of)) + np.repeat(self.begin[row] + low - (np.cumsum(n) - n), n)]


class _Trees:
    """Some trees that grow together, a level at a time. Nodes are numbered as they are made, the second child of a split
    next to the first; row, node and weight are of the drawn rows that are not yet at a leaf."""

    def __init__(self, t: int, row: np.ndarray, weight: np.ndarray, classes: int, label: np.ndarray, seed: tuple) -> None:
        self.classes, self.label, self.random = classes, label, np.random.default_rng([*seed, t, 2])
        self.row, self.weight, self.node = row, weight, np.zeros(len(row), np.int32)
        self.roots, self.made = 1, 0
        self.parts: list[tuple] = []

    def add(self, t: int, row: np.ndarray, weight: np.ndarray) -> None:
        self.row, self.weight = np.concatenate((self.row, row)), np.concatenate((self.weight, weight))
        self.node = np.concatenate((self.node, np.full(len(row), self.roots, np.int32)))
        self.roots += 1

    def _new(self, n: np.ndarray) -> np.ndarray:
        """Makes nodes with these class counts; those of several classes are open. Their number among the open ones, or -1."""
        total = n.sum(1, keepdims=True)
        self.parts.append((np.full(len(n), -1, np.int32), np.zeros(len(n), np.uint8), np.zeros(len(n), np.int32), (n / np.maximum(total, 1)).astype(np.float32)))
        several = n.max(1) < total[:, 0]
        self.open = np.flatnonzero(several)
        self.counts, self.made = n[several], self.made + len(n)
        return np.where(several, np.cumsum(several) - 1, -1).astype(np.int32)

    def _keep(self, to: np.ndarray) -> None:
        on = to >= 0
        self.row, self.weight, self.node = self.row[on], self.weight[on], to[on]

    def split(self, data: _Sorted) -> None:
        c, bits = self.classes, max(1, (self.classes - 1).bit_length())
        if not self.parts:
            n = np.bincount(self.node.astype(np.int64) * c + self.label[self.row], self.weight, self.roots * c).reshape(-1, c)
            self._keep(self._new(n)[self.node])
        counts, open_, at = self.counts, self.open, self.parts[-1]
        group = self.random.integers(data.groups, size=len(counts))
        of, told = data.values(self.row, group[self.node])
        node = self.node[of]
        code = node.astype(np.uint64) << np.uint64(16) | (told ^ np.uint16(BINS - 1))  # the highest bin first
        code = (code << np.uint64(bits) | self.label[self.row[of]].astype(np.uint64)) << np.uint64(8) | self.weight[of]
        code.sort()
        slot, low = np.full(len(counts), -1, np.int64), np.zeros(len(counts), np.int64)
        if len(code):
            run = (code >> np.uint64(8 + bits)).astype(np.int64)
            ends = np.flatnonzero(np.concatenate((run[1:] != run[:-1], [True])))
            kind, w = (code >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1), (code & np.uint64(255)).astype(np.int64)
            run = run[ends]
            column = run >> 5
            new = np.concatenate(([True], column[1:] != column[:-1]))
            begin = np.flatnonzero(new)
            who = column >> 11
            score = np.zeros(len(ends))
            mine, whole = np.zeros(len(ends), np.int64), counts.sum(1)[who]
            squares, rest = np.zeros(len(ends)), np.zeros(len(ends))
            of_column = np.cumsum(new) - 1
            for i in range(c):
                sums = np.cumsum(np.where(kind == i, w, 0))[ends]
                before = np.concatenate(([0], sums))[begin]
                high = sums - before[of_column]
                below = counts[:, i][who] - high
                mine += high
                squares += high.astype(np.float64) ** 2
                rest += below**2
            under = whole - mine
            score = squares / mine + np.where(under > 0, rest / np.maximum(under, 1), -np.inf)
            gain = score - ((counts**2).sum(1) / counts.sum(1))[who]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            best = np.maximum.reduceat(gain, first)
            told_best = np.flatnonzero((gain == np.repeat(best, np.diff(np.append(first, len(who))))) & (gain > 1e-9 * whole))
            if len(told_best):
                told_best = told_best[np.concatenate(([True], who[told_best][1:] != who[told_best][:-1]))]
                slot[who[told_best]] = column[told_best] & 2047
                low[who[told_best]] = BINS - 1 - (run[told_best] & (BINS - 1))
        split = slot >= 0
        right = np.zeros(len(self.row), bool)
        hit = (told >> 5 == slot[node]) & (told & (BINS - 1) >= low[node])
        right[of[hit]] = True
        number = np.cumsum(split) - 1
        widths = np.cumsum([0, *map(len, data.columns)])
        at[0][open_[split]] = np.concatenate(data.columns)[widths[group[split]] + slot[split]] if split.any() else 0
        at[1][open_[split]] = low[split]
        at[2][open_[split]] = self.made + 2 * number[split]
        child = np.where(split[self.node], 2 * number[self.node] + right, -1)
        self._keep(child.astype(np.int32))
        n = np.bincount(self.node.astype(np.int64) * c + self.label[self.row], self.weight, 2 * int(split.sum()) * c).reshape(-1, c)
        self._keep(self._new(n)[self.node])

    def whole(self) -> tuple:
        """Column (-1: a leaf), least bin to the second child, first child and class shares of all nodes."""
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


def _guess(steps: list[_Trees], place: np.ndarray, bins: np.ndarray, many: np.ndarray, p: int, share: np.ndarray) -> None:
    """Adds the class shares at the leaf of each tree to the rows' sums."""
    ends = np.cumsum(many, dtype=np.int64)
    made = [(s.roots, *s.whole()) for s in steps if s.parts]
    size = max(1, CELLS // max(p, 1))
    for a in range(0, len(many), size):
        z = min(len(many), a + size)
        lo, hi = ends[a] - many[a], ends[z - 1]
        table = np.zeros((z - a, max(p, 1)), np.uint8)
        table[np.repeat(np.arange(z - a), many[a:z]), place[lo:hi]] = bins[lo:hi]
        flat = table.ravel()
        for roots, column, low, child, shares in made:
            at = np.tile(np.arange(roots, dtype=np.int64), z - a)
            base = np.repeat(np.arange(z - a) * max(p, 1), roots)
            on = np.flatnonzero(column[at] >= 0)
            while len(on):
                x = at[on]
                x = child[x] + (flat[base[on] + column[x]] >= low[x])
                at[on] = x
                on = on[column[x] >= 0]
            share[a:z] += shares[at].reshape(z - a, roots, -1).sum(1, dtype=np.float64)
