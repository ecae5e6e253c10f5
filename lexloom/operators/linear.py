"""Linear classifiers of all folds side by side: texts are read once into blocks of counts, each pass over the blocks serves
every fold and every set of features. Logistic regression and complement Naive Bayes, as of pyspark.ml on the same vectors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import normalise
from lexloom.operators import features as ft
from lexloom.session import cut, drop_cut, spread

#: Rows of a block. Steps of corrections that L-BFGS keeps, for few and for many rows, and numbers of the driver that they may take for all fits.
#: Train rows from which fits begin on a part of them, and (each how many-th row, steps there).
BLOCK, KEPT, KEPT_MOST, MANY, PARTS = 512, (6, 20), 30_000_000, 20_000, ((4, 15),)
#: What a Python worker keeps of the blocks it met, from pass to pass: lengths by block, up to so many bytes.
LENGTHS, LENGTHS_MOST = {}, 64_000_000


def frequent(counts: DataFrame, folds: list[int], limit: int, held: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """counts (term, n0, n1, ...: occurrences by fold) -> the terms that are among the limit most frequent of the rows
    outside some fold, ties by name, and a table of fold and term that tells in which. held (fold, fit): the folds that
    each fit leaves out, where these are several.

    The most frequent terms of all rows are taken until none of the others can be frequent enough outside a fold.
    """
    total, asked = sum(F.col(f"n{f}") for f in folds), 4 * limit
    while True:
        rows = counts.withColumn("_n", total).orderBy(F.desc("_n"), "term").limit(asked).collect()
        terms = [r["term"] for r in rows]
        each = np.array([[r[f"n{f}"] for r in rows] for f in folds], np.int64).reshape(len(folds), -1)
        n = each.sum(0) - (each if held is None else held.T.astype(np.int64) @ each)
        name = np.empty(len(terms), np.int64)
        name[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        order = [np.lexsort((name, -x))[:limit] for x in n]
        if len(rows) < asked or all(x[o[-1]] > rows[-1]["_n"] for x, o in zip(n, order, strict=True)):
            break
        asked *= 8
    told = np.zeros(n.shape, bool)
    for row, o, x in zip(told, order, n, strict=True):
        row[o[x[o] > 0]] = True
    kept = np.flatnonzero(told.any(0))
    return [terms[i] for i in kept], told[:, kept]


def _apart(text: Column) -> Column:
    """The words of ft.word_ngrams and what is shorter, with a space between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the text of each word of ft.word_ngrams; texts as _apart leaves them."""
    split = pc.split_pattern(texts, " ")
    flat, row = split.flatten(), np.repeat(np.arange(len(texts)), split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    long = pc.greater_equal(pc.utf8_length(flat), 2)
    return row[long.to_numpy(zero_copy_only=False)], flat.filter(long)


def _next(row: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words with the numbers i (below 0: none) in their rows, the neighbours: row and first * n + second."""
    on = (row[1:] == row[:-1]) & (i[1:] >= 0) & (i[:-1] >= 0)
    return row[1:][on], i[:-1][on].astype(np.int64) * n + i[1:][on]


def _word_counts(rows: DataFrame, folds: list[int], limit: int, held: np.ndarray | None = None) -> DataFrame:
    """rows (fold, text) -> (term, n0, n1, ...) of all words, and of the pairs of neighbours that can be among the limit
    most frequent terms outside a fold: a pair stands no oftener than its words, and limit words set a bound."""
    columns = [f"n{f}" for f in folds]
    apart = rows.select("fold", _apart(F.col("text")).alias("text"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = _words(b.column(1))
            coded = found.dictionary_encode()
            f = np.searchsorted(folds, b.column(0).to_numpy(zero_copy_only=False))[row]
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False) * len(folds) + f, minlength=len(coded.dictionary) * len(folds)).reshape(-1, len(folds))
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, n.T.astype(np.int64))], ["term", *columns])

    schema = ", ".join(["term string", *(f"{c} bigint" for c in columns)])
    words = cut(apart.mapInArrow(single, schema).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)))
    total = sum(F.col(c) for c in columns)
    bounds = []
    for out in np.eye(len(folds), dtype=bool) if held is None else held.T:
        top = words.select((total - sum(F.col(c) for c, x in zip(columns, out, strict=True) if x)).alias("n")).orderBy(F.desc("n")).limit(limit).agg(F.min("n").alias("n"), F.count("*").alias("c")).first()
        bounds.append(top["n"] if top["c"] == limit else 0)
    often = [r["term"] for r in words.where(total >= max(min(bounds), 1)).select("term").collect()]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, met, size = pa.array(often, pa.string()), np.array(often, object), [], 0

        def told() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(met), return_counts=True)
            pair, at = np.unique(code // len(folds), return_inverse=True)
            table = np.zeros((len(pair), len(folds)), np.int64)
            table[at, code % len(folds)] = n
            terms = pc.binary_join_element_wise(known.take(pa.array(pair // len(names))), known.take(pa.array(pair % len(names))), " ")
            return pa.RecordBatch.from_arrays([terms, *map(pa.array, table.T)], ["term", *columns])

        for b in batches:
            row, found = _words(b.column(1))
            i = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)
            row, code = _next(row, i, len(names))
            met.append(code * len(folds) + np.searchsorted(folds, b.column(0).to_numpy(zero_copy_only=False))[row])
            size += len(code)
            if size > 4_000_000:
                yield told()
                met, size = [], 0
        if size:
            yield told()

    both = apart.mapInArrow(pairs, schema).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    return words.unionByName(both.where(total >= max(min(bounds), 1)))


def _by_fold(df: DataFrame, folds: list[int], by: str) -> DataFrame:
    return df.groupBy(by).agg(*(F.sum((F.col("fold") == f).cast("bigint")).alias(f"n{f}") for f in folds))


class Blocks:
    """The rows of a data set as blocks of term counts and fixed features, and what is fitted on the rows outside a fold.

    Columns are the terms of the kinds (word, char), then the fixed features: loanword, stats, and lexicon for each
    condition. Counts are kept once for all folds; a fold's vocabulary, document frequencies, lengths and scales are
    tables of fold and column, so they come from its train rows only. Where the data has several regimes of folds, its rows
    are told apart by their folds in all of them, and each fold of each regime is a fit that leaves some of these out.
    """

    def __init__(self, data, kinds: tuple[str, ...], conditions: tuple, fixed: bool) -> None:
        from lexloom.operators.models import WIDTH

        self.data, self.folds = data, sorted(data.sizes)
        self.held = np.array([[f in out for _, _, out in data.fits] for f in self.folds]).reshape(len(self.folds), len(data.fits))
        self.names = [r["y"] for r in data.names.orderBy("label").collect()]
        self.terms, told, at = [], [], 0
        self.spans: dict = {}
        read = cut(spread(data.rows).select("key", "fold", "label", normalise(F.col("text")).alias("text")))
        for kind in ("word", "char"):
            terms = []
            if kind in kinds:
                rows = read.select("fold", "text")
                if kind == "word":
                    counts = cut(_word_counts(rows, self.folds, data.LIMIT, self.held))
                else:
                    words = _by_fold(rows.select("fold", F.explode(F.split("text", " ")).alias("word")).where("word <> ''"), self.folds, "word")
                    counts = words.select("*", F.explode(ft._char_grams(2, 5)).alias("term")).groupBy("term").agg(*(F.sum(f"n{f}").alias(f"n{f}") for f in self.folds))
                terms, own = frequent(counts, self.folds, data.LIMIT, self.held)
                told.append(own)
            self.terms.append(terms)
            self.spans[kind] = (at, at := at + len(terms))
        self.v = at
        self.told = np.concatenate(told, 1) if told else np.zeros((len(data.fits), 0), bool)
        extra, rows = [], read
        if fixed:
            rows = rows.join(data.fixed(None).select("key", "loanword", "stats"), "key")
            extra += ["loanword", "stats"]
            for b in ("loanword", "stats"):
                self.spans[b] = (at, at := at + WIDTH[b])
        for i, c in enumerate(conditions):
            rows = rows.join(data.fixed(c).select("key", F.col("lexicon").alias(f"_x{i}")), "key")
            extra.append(f"_x{i}")
            self.spans["lexicon", c] = (at, at := at + WIDTH["lexicon"])
        self.width = at
        pieces = F.split("text", " ") if "char" in kinds else F.array().cast("array<string>")
        ready = rows.select("key", "fold", F.col("label").cast("int").alias("label"), (_apart(F.col("text")) if "word" in kinds else F.lit("")).alias("w"), pieces.alias("p"), (F.concat(*extra) if extra else F.array().cast("array<double>")).alias("x"))
        key = data.rows.schema["key"].dataType
        schema = T.StructType([T.StructField("keys", T.ArrayType(key)), T.StructField("data", T.BinaryType())])
        self.blocks = cut(ready.mapInArrow(_packer(*self.terms, self.width - self.v), schema))
        drop_cut(read)
        cores = self.blocks.sparkSession.sparkContext.defaultParallelism
        self.rdd = self.blocks.select("data").rdd.coalesce(2 * cores)
        self._measure()

    def _sum(self, f, *args, rdd=None) -> dict[str, np.ndarray]:
        """What f(state, block, *args) adds up in state over the blocks of a task, summed over tasks (most: the largest)."""
        sc = self.blocks.sparkSession.sparkContext
        sent = sc.broadcast(pickle.dumps(args))

        def run(rows: Iterator) -> Iterator:
            state, own = {}, pickle.loads(sent.value)
            for r in rows:
                f(state, r["data"], *own)
            state.pop("room", None)
            yield pickle.dumps({n: x.astype(np.float32) if n == "w" else x for n, x in state.items()})

        total: dict = {}
        for one in (self.rdd if rdd is None else rdd).mapPartitions(run).collect():
            for k, x in pickle.loads(one).items():
                x = x.astype(np.float64)
                total[k] = x if k not in total else np.maximum(total[k], x) if k == "most" else total[k] + x
        sent.destroy()
        return total

    def _measure(self) -> None:
        """Document frequencies, then lengths, and sums, squares and largest values of every column by fold and class."""
        k, c = self.held.shape[1], len(self.names)
        self.n = np.array([self.data.sizes[f] for f in self.folds], np.float64) @ ~self.held
        df = self._sum(_document_counts, self.v, np.array(self.folds)).get("df", np.zeros((len(self.folds), self.v)))
        idf = np.log((1.0 + self.n[:, None]) / (1.0 + (~self.held).T.astype(np.float64) @ df)) + 1.0
        self.square = np.where(self.told, idf * idf, 0.0).T
        empty = {"sums": np.zeros((self.width, k * c)), "squares": np.zeros((self.width, k)), "most": np.zeros((self.width, k))}
        m = empty | self._sum(_column_sums, self._frame(), c)
        used = np.ones((self.width, k), bool)
        used[: self.v] = self.told.T
        self.sums = np.where(used[:, :, None], m["sums"].reshape(self.width, k, c), 0.0)
        self.most = np.where(used, m["most"], 0.0)
        mean = self.sums.sum(2) / np.maximum(self.n, 1)
        var = np.maximum(m["squares"] / np.maximum(self.n, 1) - mean * mean, 0.0) * self.n / np.maximum(self.n - 1, 1)
        exact = np.where(np.arange(self.width) < self.v, 1e-6, 1e-12)[:, None]  # what rounding leaves of a constant column
        self.std = np.where(used & (var > exact * mean * mean), np.sqrt(var), 0.0)
        self.mean = mean

    def _frame(self) -> tuple:
        return self.spans["word"], self.spans["char"], self.v, self.square, (np.array(self.folds), self.held), self.width

    def columns(self, blocks: tuple[str, ...], condition) -> np.ndarray:
        on = np.zeros(self.width, bool)
        for b in blocks:
            lo, hi = self.spans[(b, condition) if b == "lexicon" else b]
            on[lo:hi] = True
        return on

    def logistic(self, specs: list[tuple[tuple[str, ...], object]], iterations: int, tol: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (blocks, condition) and fold the weights (column, class) of the values divided by lengths, and intercepts:
        the least mean log loss plus |w|^2 / 2n, with w of the columns over their largest values (as MaxAbsScaler and
        LogisticRegression without standardization). Two classes have one column, as of the binomial family.

        L-BFGS as breeze runs it: columns shifted and divided by their deviation; a fit ends when its gradient is below tol
        times the loss, or its steps better it by less than tol of itself in 20 (measured over the last 10). With very
        many rows it begins with some steps on a part of them (PARTS); it always ends on all rows.
        """
        c = len(self.names)
        c = 1 if c == 2 else c
        k, fits = self.held.shape[1], []
        few, most = KEPT
        kept = few if min(self.n, default=0) < MANY else max(few, min(most, KEPT_MOST // max(2 * c * self.width * k * len(specs), 1)))
        for blocks, condition in specs:
            on = self.columns(blocks, condition)
            for j in range(k):
                s = np.where(on & (self.std[:, j] > 0), self.std[:, j], np.inf)
                fits.append(_Fit(j, 1 / s, self.mean[:, j] / s, np.where(np.isinf(s), 0.0, (self.most[:, j] / s) ** 2) / max(self.n[j], 1), c, tol, kept))
        for step, most in (*(PARTS if min(self.n, default=0) >= MANY else ()), (1, iterations)):
            part = self.parts(step)
            for f in fits:
                f.begin(step, most)
            while active := [f for f in fits if not f.ended]:
                at, own = [f.weights() for f in active], max(c - 1, 1)
                w = np.concatenate([w[:, :own] for w, _ in at], 1).astype(np.float32)
                got = self._sum(_losses, self._frame(), w, np.concatenate([b for _, b in at]), np.array([f.fold for f in active]), c, rdd=part and part.rdd)
                for i, f in enumerate(active):
                    g = got["w"][:, i * own : (i + 1) * own]
                    f.take(got["loss"][i], got["n"][i], g if c == 1 else np.concatenate([g, -g.sum(1, keepdims=True)], 1), got["b"][i])
            if part:
                drop_cut(part)
        return [f.weights() for f in fits]

    def parts(self, step: int) -> DataFrame | None:
        """Blocks of each step-th row of a block; None for all rows."""
        if step == 1:
            return None

        def run(rows: Iterator) -> Iterator:
            for r in rows:
                yield (_part(r["data"], step),)

        cores = self.blocks.sparkSession.sparkContext.defaultParallelism
        return cut(self.blocks.sparkSession.createDataFrame(self.rdd.mapPartitions(run), "data binary", verifySchema=False).coalesce(2 * cores))

    def bayes(self, specs: list[tuple[tuple[str, ...], object]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for complement Naive Bayes on the columns over their largest values, with 1 added to each."""
        out = []
        for blocks, condition in specs:
            on = self.columns(blocks, condition)
            size = sum(self.data.LIMIT if b in ("word", "char") else self.spans[(b, condition) if b == "lexicon" else b][1] - self.spans[(b, condition) if b == "lexicon" else b][0] for b in blocks)
            for j in range(self.held.shape[1]):
                top = np.where(on & (self.most[:, j] > 0), self.most[:, j], np.inf)[:, None]
                own = self.sums[:, j] / top
                rest = own.sum(1, keepdims=True) - own
                w = np.log(rest.sum(0) + size) - np.log(rest + 1.0)
                out.append((np.where(np.isinf(top), 0.0, w / top), np.zeros(len(self.names))))
        return out

    def guesses(self, found: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(key, fold, y, spec, yhat, score) of the rows of each fold by the fit on the others. found: by spec and fold. Of
        several regimes, the specs of the second are numbered after those of the first."""
        k, names, frame, c = self.held.shape[1], self.names, self._frame(), found[0][0].shape[1]
        regimes = [np.flatnonzero([r == x for r, _, _ in self.data.fits]) for x in sorted({r for r, _, _ in self.data.fits})]
        number = np.array([f for _, f, _ in self.data.fits])
        sc = self.blocks.sparkSession.sparkContext
        sent = sc.broadcast(pickle.dumps((np.concatenate([w for w, _ in found], 1), np.concatenate([b for _, b in found]))))

        def run(blocks: Iterator) -> Iterator:
            w, b = pickle.loads(sent.value)
            for r in blocks:
                rows = _Rows(r["data"], frame, kind=np.float64)
                fold, label, out = rows.fold, rows.label, _held(frame, rows.fold)
                z = (rows.times(w, np.repeat(np.tile(np.arange(k), len(found) // k), c)) + b).reshape(len(fold), -1, k, c)
                for i, own in enumerate(regimes):
                    of = own[out[:, own].argmax(1)]
                    x = z[np.arange(len(fold)), :, of]
                    x = np.concatenate([np.zeros_like(x), x], 2) if c == 1 and len(names) == 2 else x
                    p = np.exp(x - x.max(2, keepdims=True))
                    p /= p.sum(2, keepdims=True)
                    best = p.argmax(2)
                    for s in range(p.shape[1]):
                        yield i * p.shape[1] + s, r["keys"], number[of].tolist(), [names[y] for y in label], [names[y] for y in best[:, s]], p[np.arange(len(fold)), s, best[:, s]].tolist()

        key = self.data.rows.schema["key"].dataType
        lists = {"key": key, "fold": T.IntegerType(), "y": T.StringType(), "yhat": T.StringType(), "score": T.DoubleType()}
        schema = T.StructType([T.StructField("spec", T.IntegerType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists.items())])
        rows = self.blocks.sparkSession.createDataFrame(self.blocks.rdd.mapPartitions(run), schema, verifySchema=False)
        each = rows.select("spec", F.explode(F.arrays_zip(*lists)).alias("x"))
        return cut(each.select("spec", *(F.col(f"x.{n}").alias(n) for n in lists)))


class _Fit:
    """One logistic regression: L-BFGS over the shifted and scaled columns, one trial point a pass."""

    def __init__(self, fold: int, scale: np.ndarray, shift: np.ndarray, penalty: np.ndarray, c: int, tol: float, kept: int) -> None:
        self.fold, self.scale, self.shift, self.penalty, self.c, self.asked, self.kept = fold, scale[:, None], shift[:, None], penalty[:, None], c, tol, kept
        self.x, self.pairs = np.zeros((len(scale) + 1, c)), []

    def begin(self, step: int, most: int) -> None:
        """Goes on with each step-th row. Mean losses of fewer rows get the penalty of so many rows, as a fit of their own
        has; with that of all rows they would be learnt by heart, and the start for all rows be worse than none."""
        self.tol, self.factor, self.most = self.asked if step == 1 else 5 * self.asked, step, most
        self.ended, self.trial, self.f, self.past, self.steps = False, self.x, None, [], 0

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.x if self.ended else self.trial
        return at[:-1] * self.scale, at[-1] - (at[:-1] * self.shift).sum(0)

    def take(self, loss: float, n: float, w: np.ndarray, b: np.ndarray) -> None:
        """What a pass found at the trial point: the sums of the losses and of the gradients."""
        n, u = max(n, 1.0), self.trial[:-1]
        penalty = self.penalty * self.factor
        f = loss / n + 0.5 * (penalty * u * u).sum()
        if self.f is None and not np.isfinite(f):
            raise FloatingPointError(f"the loss of fit {self.fold} is {f} where it begins: a feature isn't a finite number")
        g = np.concatenate([(w * self.scale - self.shift * b) / n + penalty * u, b[None] / n])
        if self.f is not None and not f <= self.f + 1e-4 * self.rate * self.slope:
            self.rate /= 4
            if self.rate < 1e-9:
                self.ended = True
            self.trial = self.x + self.rate * self.way
            return
        if self.f is not None:
            s, y = (self.trial - self.x).astype(np.float32), (g - self.g).astype(np.float32)
            if (sy := float((s * y).sum())) > 1e-10 * float((y * y).sum()):
                self.pairs = [*self.pairs, (s, y, sy)][-self.kept:]
            self.steps += 1
        self.x, self.f, self.g, self.past = self.trial, f, g, [*self.past, f][-11:]
        if np.linalg.norm(g) <= max(self.tol * abs(f), 1e-8) or self.steps >= self.most or len(self.past) == 11 and max(self.past) - f <= self.tol / 2 * abs(f):
            self.ended = True
            return
        q, told = -g, []
        for s, y, sy in reversed(self.pairs):
            told.append(a := float((s * q).sum()) / sy)
            q = q - a * y
        if self.pairs:
            s, y, sy = self.pairs[-1]
            q = q * (sy / float((y * y).sum()))
        for (s, y, sy), a in zip(self.pairs, reversed(told), strict=True):
            q = q + (a - float((y * q).sum()) / sy) * s
        self.slope = float((q * g).sum())
        if self.slope >= 0:
            q, self.pairs, self.slope = -g, [], -float((g * g).sum())
        self.rate = 1.0 if self.pairs else min(1.0, 1.0 / np.linalg.norm(g))
        self.way, self.trial = q, self.x + self.rate * q


def _packer(word: list[str], char: list[str], extra: int):
    """A function over Arrow batches (key, fold, label, w, p, x) that gives (keys, data): the counts of some rows."""
    v = len(word) + len(char)
    single = sorted({w for t in word for w in t.split(" ")})
    name, n = {w: i for i, w in enumerate(single)}, len(single)
    coded = np.array([name[t] if " " not in t else n + name[t.split(" ")[0]] * n + name[t.split(" ")[1]] for t in word], np.int64)
    place = np.argsort(coded)
    coded = coded[place]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, kept = pa.array(single, pa.string()), {t: i + len(word) for i, t in enumerate(char)}, {}
        small = np.uint16 if v < 1 << 16 else np.uint32

        def places(w: str) -> list[int]:
            if (found := kept.get(w)) is None:
                p = f" {w} " if w else ""
                if len(kept) > 200_000:
                    kept.clear()
                found = kept[w] = [at[g] for n in range(2, 6) for i in range(len(p) - n + 1) if (g := p[i : i + n]) in at]
            return found

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                rows = np.arange(b.num_rows)
                sizes = lambda c: b.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                code = [np.zeros(0, np.int64)]
                if word:
                    row, found = _words(b.column(3))
                    i = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)
                    of, pair = _next(row, i, n)
                    row, i = np.concatenate((row, of)), np.concatenate((i, n + pair))
                    j = np.minimum(np.searchsorted(coded, i), len(coded) - 1)
                    on = coded[j] == i
                    code.append(row[on] * v + place[j[on]])
                if char:
                    pieces = b.column(4).flatten().dictionary_encode()
                    own = [places(w) for w in pieces.dictionary.to_pylist()]
                    flat, lens = np.array([i for p in own for i in p], np.int64), np.array([len(p) for p in own], np.int64)
                    of = pieces.indices.to_numpy(zero_copy_only=False)
                    many = lens[of] if len(of) else np.zeros(0, np.int64)
                    begin = (np.cumsum(lens) - lens)[of] if len(of) else many
                    code.append(np.repeat(np.repeat(rows, sizes(4)) * v, many) + flat[np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)])
                code = np.concatenate(code)
                if len(code) * 20 > b.num_rows * v:
                    counts = np.bincount(code, minlength=b.num_rows * v)
                    code = np.flatnonzero(counts)
                    counts = counts[code]
                else:
                    code, counts = np.unique(code, return_counts=True)
                row = code // max(v, 1)
                counts = counts.astype(np.uint8 if len(counts) == 0 or counts.max() < 256 else np.uint32)
                x = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, extra)
                packed = (b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), np.bincount(row, minlength=b.num_rows).astype(np.uint32), (code - row * v).astype(small), counts, x)
                data = _pack(packed)
                keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([data], pa.binary())], ["keys", "data"])

    return pack


def _pack(block: tuple) -> bytes:
    data = pickle.dumps(block, 5)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _part(data: bytes, step: int) -> bytes:
    fold, label, n, place, count, x = _unpack(data)
    on = np.repeat(np.arange(len(n)), n) % step == 0
    return _pack((fold[::step], label[::step], n[::step], place[on], count[on], x[::step]))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


class _Rows:
    """The rows of a block: term values with their places, the divisors of the word and of the char values of each
    row by fold, and the fixed features. Products go by the places, or by a dense copy where that is less work."""

    def __init__(self, data: bytes, frame: tuple, kind: type = np.float32, room: dict | None = None) -> None:
        (_, words), _, self.v, square, _, self.width = frame
        self.fold, self.label, n, place, count, x = _unpack(data)
        row = np.repeat(np.arange(len(n)), n)
        self.x, self.place, self.kind, self.room, self.words, self.row = x.astype(np.float64), place, kind, room, words, row
        logs = 1 + np.log(np.arange(1, 257, dtype=kind))
        self.value = logs[count - 1] if count.dtype == np.uint8 else 1 + np.log(count, dtype=kind)
        self.part = 2 * row + (place >= words)
        self.starts = np.flatnonzero(np.diff(self.part, prepend=-1))
        self.length = np.ones((2 * len(self.fold), square.shape[1]), kind)
        self.filled = None
        kept = (hash(data), len(data), kind, hash(square.tobytes())) if room is not None else None
        if kept in LENGTHS:
            self.length = LENGTHS[kept]
        elif len(place):
            length = np.sqrt(np.add.reduceat(square.astype(kind).take(place, 0) * (self.value * self.value)[:, None], self.starts, axis=0))
            self.length[self.part[self.starts]] = np.where(length > 0, length, 1)
            if kept:
                if self.length.nbytes * (len(LENGTHS) + 1) > LENGTHS_MOST:
                    LENGTHS.clear()
                LENGTHS[kept] = self.length

    def dense(self, columns: int) -> np.ndarray | None:
        """The values as a table, where that is less work for as many columns (by measured times); its room is kept for the
        next block. It holds them until clear()."""
        if self.filled is not None:
            return self.filled
        size = len(self.fold) * self.v
        if self.room is None or size * (1.2e-9 + 5.3e-11 * columns) > len(self.place) * columns * 7.5e-9:
            return None
        if self.room.get("dense") is None or len(self.room["dense"]) < len(self.fold):
            self.room["dense"] = np.zeros((len(self.fold), self.v), self.kind)
        self.filled = self.room["dense"][: len(self.fold)]
        np.put(self.filled, self.row * self.v + self.place, self.value)
        return self.filled

    def clear(self) -> None:
        if self.filled is not None:
            self.filled.fill(0)
            self.filled = None

    def times(self, w: np.ndarray, of: np.ndarray) -> np.ndarray:
        """(row, column) products with w (place, column) of fits on the folds numbered of."""
        s = np.zeros((2 * len(self.fold), w.shape[1]), self.kind)
        if len(self.place):
            if (x := self.dense(w.shape[1])) is not None:
                s[::2], s[1::2] = x[:, : self.words] @ w[: self.words], x[:, self.words :] @ w[self.words : self.v]
            else:
                g = w.take(self.place, 0)
                g *= self.value[:, None]
                s[self.part[self.starts]] = np.add.reduceat(g, self.starts, axis=0)
            s /= self.length[:, of]
        return s.reshape(len(self.fold), 2, -1).sum(1) + self.x @ w[self.v :]

    def back(self, m: np.ndarray, of: np.ndarray, power: int = 1, largest: bool = False) -> np.ndarray:
        """(place, column) products with m (row, column), of the values or their squares; or the largest such values."""
        out = np.zeros((self.width, m.shape[1]), np.float64)
        value, x, add = (self.value**power, self.x**power, np.maximum if largest else np.add)
        if len(self.place):
            each = (m[:, None] / self.length.reshape(len(self.fold), 2, -1)[:, :, of] ** power).reshape(2 * len(self.fold), -1).astype(self.kind)
            if power == 1 and not largest and (t := self.dense(m.shape[1])) is not None:
                out[: self.words], out[self.words : self.v] = t[:, : self.words].T @ each[::2], t[:, self.words :].T @ each[1::2]
            else:
                order = np.argsort(self.place, kind="stable")
                place = self.place[order]
                starts = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
                g = each.take(self.part[order], 0)
                g *= value[order][:, None]
                out[place[starts]] = add.reduceat(g, starts, axis=0)
        if largest:
            for j in range(m.shape[1]):
                out[self.v :, j] = np.abs(x * m[:, j : j + 1]).max(0)
        else:
            out[self.v :] = x.T @ m
        return out


def _held(frame: tuple, fold: np.ndarray) -> np.ndarray:
    """(row, fit): whether the fit leaves the row out."""
    folds, held = frame[4]
    return held[np.searchsorted(folds, fold)]


def _document_counts(state: dict, data: bytes, v: int, folds: np.ndarray) -> None:
    fold, _, n, place, _, _ = _unpack(data)
    at = np.searchsorted(folds, np.repeat(fold, n)) * v + place
    df = np.bincount(at, minlength=v * len(folds)).reshape(len(folds), v)
    state["df"] = state["df"] + df if "df" in state else df


def _column_sums(state: dict, data: bytes, frame: tuple, c: int) -> None:
    b = _Rows(data, frame)
    train = (~_held(frame, b.fold)).astype(np.float64)
    k = train.shape[1]
    each = (train[:, :, None] * (b.label[:, None] == np.arange(c))[:, None]).reshape(len(b.fold), -1)
    for name, x in (("sums", b.back(each, np.repeat(np.arange(k), c))), ("squares", b.back(train, np.arange(k), 2))):
        state[name] = state[name] + x if name in state else x
    most = b.back(train, np.arange(k), largest=True)
    state["most"] = np.maximum(state["most"], most) if "most" in state else most


def _losses(state: dict, data: bytes, frame: tuple, w: np.ndarray, b: np.ndarray, of: np.ndarray, c: int) -> None:
    """w has all classes but the last, whose weights and gradients are what the sum of the others lacks to zero."""
    rows = _Rows(data, frame, room=state.setdefault("room", {}))
    n, own = len(rows.fold), max(c - 1, 1)
    of_column = np.repeat(of, own)
    z = rows.times(w, of_column).reshape(n, len(of), own).astype(np.float64)
    z = (z if c == 1 else np.concatenate([z, -z.sum(2, keepdims=True)], 2)) + b.reshape(len(of), c)
    train = (~_held(frame, rows.fold)[:, of]).astype(np.float64)
    if c == 1:
        z = z[:, :, 0]
        t = (rows.label == 1).astype(np.float64)[:, None]
        loss = np.maximum(z, 0) - t * z + np.log1p(np.exp(-np.abs(z)))
        r = (0.5 * (1 + np.tanh(z / 2)) - t)[:, :, None]
    else:
        top = z.max(2, keepdims=True)
        e = np.exp(z - top)
        total, at = e.sum(2, keepdims=True), np.arange(n)
        loss = (np.log(total) + top)[:, :, 0] - z[at, :, rows.label]
        r = e / total
        r[at, :, rows.label] -= 1
    r *= train[:, :, None]
    back = rows.back(r[:, :, :own].reshape(n, -1), of_column)
    rows.clear()
    found = ("loss", (loss * train).sum(0)), ("n", train.sum(0)), ("b", r.sum(0)), ("w", back)
    for name, x in found:
        if name in state:
            state[name] += x
        else:
            state[name] = x
