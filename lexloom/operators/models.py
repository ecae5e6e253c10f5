"""Classifiers over sparse TF-IDF, lexicon, loan-word and length features, cross-validated by a fold column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import normalise
from lexloom.operators import features as ft
from lexloom.operators import forest, linear
from lexloom.operators.metrics import multiclass_metrics
from lexloom.operators.numbering import number_rows, running_sums
from lexloom.operators.splits import stratified_folds
from lexloom.session import cut, drop_cut

BLOCKS = ("word", "char", "lexicon", "loanword", "stats")
STATS = ("num_tokens", "num_chars", "avg_token_length", "num_unique_tokens", "type_token_ratio", "num_lines", "avg_line_length")
LEXICAL = ("coverage", "oov", "variant", "pos_diversity", "gloss_ratio")
WIDTH = {"loanword": 2, "stats": len(STATS), "lexicon": len(LEXICAL)}

#: name -> (classifier, feature blocks). Those with the lexicon block need one.
ZOO = {
    "majority": ("majority", ()),
    "stratified_random": ("random", ()),
    "tfidf_logreg": ("logreg", ("word", "char", "loanword", "stats")),
    "tfidf_svm": ("svm", ("word", "char", "loanword", "stats")),
    "tfidf_cnb": ("cnb", ("word", "char")),
    "tfidf_rf": ("rf", ("word", "char", "loanword", "stats")),
    "hybrid_logreg": ("logreg", BLOCKS),
    "hybrid_svm": ("svm", BLOCKS),
    "hybrid_rf": ("rf", BLOCKS),
    "lexicon_only_logreg": ("logreg", ("lexicon", "loanword", "stats")),
}
FAST_ZOO = {m: ZOO[m] for m in ("majority", "tfidf_logreg", "hybrid_logreg")}
#: Iterations of logistic regression and of the SVM, trees of a forest and their depth (the most that Spark grows), inner
#: folds of the calibration.
ITERATIONS, SVM_ITERATIONS, TREES, DEPTH, INNER = 1000, 2000, 100, 30, 3
TOLERANCE = 1e-3
#: Classifiers that are fitted for all folds side by side, where folds and classes are this few together (the driver keeps
#: the weights of each).
TOGETHER, FEW = ("logreg", "cnb", "rf"), 400


def zoo(lexicon: bool, fast: bool = False) -> dict[str, tuple[str, tuple[str, ...]]]:
    """The models of a run; those that need a lexicon only if there is one (an empty one is one)."""
    return {m: x for m, x in (FAST_ZOO if fast else ZOO).items() if lexicon or "lexicon" not in x[1]}


class Dataset:
    """Rows to classify, with what needs no fit made once: (key, y, label, fold), terms, term counts by fold, features.

    rows (key, text, label): those without a label or text take no part. Classes are numbered by a table, however many
    there are. folds (key, fold) overrides k stratified ones. lexicons: condition -> lexicon. Vocabularies (of at most
    LIMIT terms) and scaling are fitted on the train rows of each fold only. fits: (regime, fold, numbers in the fold
    column that it leaves out), one for each fold unless regimes() made them.
    """

    LIMIT = 5000

    def __init__(self, rows: DataFrame, key: str, text: str, label: str, k: int, seed: int = 42, lexicons: dict[str, DataFrame] | None = None, folds: DataFrame | None = None) -> None:
        self.k, self.seed, self.lexicons = k, seed, lexicons or {}
        own = cut(rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("y")))
        self.names = cut(number_rows(own.select("y").distinct(), ["y"], "_l").select("y", F.col("_l").cast("double").alias("label")))
        self.classes = self.names.count()
        names = F.broadcast(self.names) if self.classes <= FEW else self.names
        dealt = stratified_folds(own.select("key", "y"), "key", "y", k, seed).select("key", "fold") if folds is None else folds.select(F.col(key).alias("key"), "fold")
        self.rows = cut(own.join(dealt, "key").join(names, "y").select("key", "text", "y", "label", "fold"))
        drop_cut(own)
        self.sizes = {r["fold"]: r["n"] for r in self.rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        self.fits = [(0, f, {f}) for f in sorted(self.sizes)]
        self._terms: dict[str, tuple[DataFrame, DataFrame]] = {}
        self._fixed: dict[tuple, DataFrame] = {}
        self.found: dict[tuple, DataFrame] = {}

    def terms(self, kind: str) -> tuple[DataFrame, DataFrame]:
        """(key, term, tf) and (term, fold, tf, df)."""
        if kind not in self._terms:
            d = self.rows.select("key", normalise(F.col("text")).alias("text"))
            own = cut((ft.word_terms if kind == "word" else ft.char_terms)(d, "key", "text"))
            counts = own.join(self.rows.select("key", "fold"), "key").groupBy("term", "fold").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
            self._terms[kind] = (own, cut(counts))
        return self._terms[kind]

    def fixed(self, condition: str | None) -> DataFrame:
        """(key, loanword, stats, lexicon) as arrays; without a lexicon its features are zero."""
        if condition not in self._fixed:
            d = self.rows.select("key", "text")
            if None not in self._fixed:
                a = ft.loanword_features(d, "key", "text").select("key", F.array(F.col("loanword_ratio").cast("double"), F.col("loanwords").cast("double")).alias("loanword"))
                b = ft.text_stats(d, "key", "text").select("key", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in STATS)).alias("stats"))
                self._fixed[None] = cut(a.join(b, "key").withColumn("lexicon", F.array(*[F.lit(0.0)] * len(LEXICAL))))
            if condition is not None:
                c = ft.lexicon_features(d, "key", "text", self.lexicons[condition]).select("key", F.array(*(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in LEXICAL)).alias("lexicon"))
                self._fixed[condition] = cut(self._fixed[None].drop("lexicon").join(c, "key"))
        return self._fixed[condition]

    def weights(self, kind: str, fold: int) -> DataFrame:
        """(key, <kind>): the TF-IDF weights of every row as (place, weight) of the train rows' vocabulary."""
        own, counts = self.terms(kind)
        n = sum(v for f, v in self.sizes.items() if f != fold)
        top = counts.where(F.col("fold") != fold).groupBy("term").agg(F.sum("tf").alias("n"), F.sum("df").alias("df")).orderBy(F.desc("n"), "term").limit(self.LIMIT)
        vocab = cut(top.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"), (F.row_number().over(W.orderBy("term")) - 1).alias("i")))
        w = own.join(F.broadcast(vocab), "term").select("key", F.struct("i", ((1.0 + F.log("tf")) * F.col("idf")).alias("w")).alias("x"))
        return w.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias(kind))


def vectors(rows: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """rows (key, y, label, fold, word, char, loanword, stats, lexicon) -> (key, y, label, fold, raw): one sparse vector of
    the blocks, term blocks scaled to length 1, built from whole Arrow batches."""
    kept = ["key", "y", "label", "fold"]
    size = sum(WIDTH.get(b, Dataset.LIMIT) for b in blocks)
    udt = VectorUDT()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        for b in batches:
            row, place, value, at = [], [], [], 0
            for name, col in zip(blocks, b.columns[len(kept) :], strict=True):
                flat, n = col.flatten(), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(b.num_rows), n)
                if name in WIDTH:
                    v, i = flat.to_numpy(zero_copy_only=False), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                    at_next = at + WIDTH[name]
                else:
                    i, v = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
                    norm = np.sqrt(np.bincount(of, v * v, b.num_rows)) if len(v) else np.ones(b.num_rows)
                    v, at_next = v / norm[of] if len(v) else v, at + Dataset.LIMIT
                row.append(of)
                place.append(i + at)
                value.append(v)
                at = at_next
            row, place, value = (np.concatenate(x) for x in (row, place, value))
            order = np.lexsort((place, row))
            order = order[value[order] != 0]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[order], minlength=b.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order], k)) for x, k in ((place, pa.int32()), (value, pa.float64()))]
            v = pa.StructArray.from_arrays([pa.array(np.zeros(b.num_rows, np.int8)), pa.array(np.full(b.num_rows, size, np.int32)), *lists], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], v], [*kept, "raw"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("raw", udt)])
    return rows.select(*kept, *blocks).mapInArrow(pack, schema)


def _classifier(kind: str, n: int, seed: int):
    lr = {"tol": TOLERANCE, "regParam": 1.0 / max(n, 1), "standardization": False}
    return {
        "logreg": lambda: LogisticRegression(maxIter=ITERATIONS, elasticNetParam=0.0, **lr),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=SVM_ITERATIONS, **lr), parallelism=4),
        "cnb": lambda: NaiveBayes(modelType="complement"),
        "rf": lambda: RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed),
    }[kind]()


def platt(scored: DataFrame, rounds: int = 30) -> dict[int, tuple[float, float]]:
    """scored (label, margins array) -> class -> (a, b) of the logistic curve 1 / (1 + exp(-(a * margin + b))) fitted to
    whether a row is of the class, for all classes at once: each Newton step is one aggregate of a row a class."""
    each = cut(scored.select("label", F.posexplode("margins").alias("c", "m")).select("c", "m", (F.col("label") == F.col("c")).cast("double").alias("t")))
    at = {r["c"]: (0.0, 0.0) for r in each.select("c").distinct().collect()}
    for _ in range(rounds):
        curve = F.create_map(*(x for c, (a, b) in at.items() for x in (F.lit(c), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
        p = each.withColumn("w", curve[F.col("c")]).withColumn("p", 1 / (1 + F.exp(-(F.col("w.a") * F.col("m") + F.col("w.b")))))
        q = F.col("p") * (1 - F.col("p"))
        sums = p.groupBy("c").agg(F.sum((F.col("t") - F.col("p")) * F.col("m")).alias("ga"), F.sum(F.col("t") - F.col("p")).alias("gb"), F.sum(q * F.col("m") * F.col("m")).alias("haa"), F.sum(q * F.col("m")).alias("hab"), F.sum(q).alias("hbb")).collect()
        moved = 0.0
        for r in sums:
            haa, hab, hbb = r["haa"] + 1e-6, r["hab"], r["hbb"] + 1e-6
            det = haa * hbb - hab * hab
            da, db = (hbb * r["ga"] - hab * r["gb"]) / det, (haa * r["gb"] - hab * r["ga"]) / det
            step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
            a, b = at[r["c"]]
            at[r["c"]] = (a + step * da, b + step * db)
            moved = max(moved, abs(da), abs(db))
        if moved < 1e-4:
            break
    return at


def _fitted(train: DataFrame, test: DataFrame, kind: str, n: int, seed: int) -> DataFrame:
    """test plus prob, an array of class probabilities (for the SVM calibrated on INNER folds of the train rows, the mean
    of the models fitted to the others)."""
    scaled = lambda stage: Pipeline(stages=[MaxAbsScaler(inputCol="raw", outputCol="features"), stage])
    if kind != "svm":
        return scaled(_classifier(kind, n, seed)).fit(train).transform(test).withColumn("prob", vector_to_array("probability"))
    inner = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(INNER))
    sums = None
    for j in range(INNER):
        part = cut(train.where(inner != j))
        model = scaled(_classifier(kind, part.count(), seed)).fit(part)
        margins = lambda df, model=model: model.transform(df).withColumn("margins", vector_to_array("rawPrediction"))
        curve = platt(margins(train.where(inner == j)).select("label", "margins"))
        a, b = (F.array(*(F.lit(curve.get(c, (0.0, 0.0))[i]) for c in range(max(curve) + 1))) for i in (0, 1))
        p = F.zip_with(F.zip_with("margins", a, lambda m, x: m * x), b, lambda m, x: 1 / (1 + F.exp(-(m + x))))
        own = margins(test).select("key", "y", "label", "fold", p.alias("p")).withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(1e-300), lambda s, y: s + y)))
        sums = own if sums is None else sums.join(own.select("key", F.col("p").alias("q")), "key").withColumn("p", F.zip_with("p", "q", lambda x, y: x + y)).drop("q")
        sums = cut(sums)
    return sums.withColumn("prob", F.transform("p", lambda x: x / INNER))


def predict(data: Dataset, model: str, condition: str | None = None, spec: tuple[str, tuple[str, ...]] | None = None, whole: bool = False) -> DataFrame:
    """(key, fold, y, yhat, score): out-of-fold predictions of a model of ZOO (or of a spec like its values); score is the
    probability of the guess. A fold whose fit fails has null guesses instead of true ones; with whole, as in all queries
    and experiments, it is an error, and so is a fold that no other leaves rows to learn from."""
    kind, blocks = spec or ZOO[model]
    if whole and len(data.sizes) < 2:
        raise ValueError(f"{model}: {sum(data.sizes.values())} rows in {len(data.sizes)} folds, so none to learn from for a fold")
    if kind == "majority":
        return majority(data)
    if kind == "random":
        return stratified_random(data.rows, "key", "y", data.seed).withColumn("score", F.lit(None).cast("double"))
    out = None
    for fold in sorted(data.sizes):
        try:
            own = _fold(data, fold, kind, blocks, condition)
            own = own if beside(data, kind) else cut(own)
        except Exception as e:  # noqa: BLE001
            if whole:
                raise RuntimeError(f"{model}: fold {fold} failed") from e
            print(f"{model}: fold {fold} failed: {str(e)[:200]}")
            own = data.rows.where(F.col("fold") == fold).select("key", "fold", "y", F.lit(None).cast("string").alias("yhat"), F.lit(None).cast("double").alias("score"))
        out = own if out is None else out.union(own)
    if whole:
        _all_told(data, out, model)
    return out


def _all_told(data: Dataset, guesses: DataFrame, model: str) -> None:
    """An error where a row is without a guess, or the probability of one isn't a number."""
    told, n = guesses.where("yhat is not null and not isnan(score)").count(), sum(data.sizes.values())
    if told != n:
        raise RuntimeError(f"{model}: {told} of {n} rows have a guess")


def beside(data: Dataset, kind: str) -> bool:
    return kind in TOGETHER and len(data.fits) * data.classes <= FEW


def regimes(rows: DataFrame, key: str, text: str, label: str, k: int, seed: int, lexicons: dict[str, DataFrame], folds: list[DataFrame]) -> Dataset:
    """A data set whose folds are those of several regimes (key, fold) together, for fit_regimes(); their keys are the same."""
    each = [f.select(key, F.col("fold").alias(f"_f{i}")) for i, f in enumerate(folds)]
    joint = each[0]
    for f in each[1:]:
        joint = joint.join(f, key)
    cells = sorted(tuple(r) for r in joint.select(*(f"_f{i}" for i in range(len(folds)))).distinct().collect())
    number = F.create_map(*(x for i, c in enumerate(cells) for x in (F.lit(":".join(map(str, c))), F.lit(i)))) if cells else F.create_map()
    data = Dataset(rows, key, text, label, k, seed, lexicons, joint.select(key, number[F.concat_ws(":", *(f"_f{i}" for i in range(len(folds))))].alias("fold")))
    data.fits = [(r, f, {i for i, c in enumerate(cells) if c[r] == f}) for r in range(len(folds)) for f in sorted({c[r] for c in cells})]
    return data


def fit_regimes(data: Dataset, model: str, condition: str | None = None) -> list[DataFrame]:
    """(key, fold, y, yhat, score) for each regime of regimes(): out-of-fold predictions of a logistic regression or Naive Bayes, all fitted
    with the same passes."""
    kind, blocks = ZOO[model]
    condition = condition if "lexicon" in blocks else None
    guesses = _together(data, kind, [(blocks, condition)])
    out = [guesses.where(F.col("spec") == i).drop("spec") for i in sorted({r for r, _, _ in data.fits})]
    for p in out:
        _all_told(data, p, model)
    return out


def fit_together(data: Dataset, kind: str, specs: list[tuple[tuple[str, ...], str | None]]) -> None:
    """Fits one kind of TOGETHER on several (blocks, condition) with the same passes, and keeps the guesses of all folds in
    data, where predict() finds them. A kind that isn't fitted side by side is left to predict()."""
    specs = [s for s in dict.fromkeys((b, c if "lexicon" in b else None) for b, c in specs) if (kind, *s) not in data.found]
    if not specs or not beside(data, kind):
        return
    guesses = _together(data, kind, specs)
    for i, s in enumerate(specs):
        data.found[(kind, *s)] = guesses.where(F.col("spec") == i).drop("spec")


def _together(data: Dataset, kind: str, specs: list[tuple[tuple[str, ...], str | None]]) -> DataFrame:
    if not data.fits or any(out >= data.sizes.keys() for _, _, out in data.fits):
        raise ValueError(f"{kind}: {sum(data.sizes.values())} rows, with none to learn from for some fold of {[f for _, f, _ in data.fits]}")
    used = {b for blocks, _ in specs for b in blocks}
    made = linear.Blocks(data, tuple(b for b in ("word", "char") if b in used), tuple(dict.fromkeys(c for b, c in specs if "lexicon" in b)), bool(used & {"loanword", "stats"}))
    if kind == "rf":
        guesses = forest.guesses(made, specs, TREES, DEPTH, data.seed)
    else:
        guesses = made.guesses(made.logistic(specs, ITERATIONS, TOLERANCE) if kind == "logreg" else made.bayes(specs))
    drop_cut(made.blocks)
    return guesses


def _fold(data: Dataset, fold: int, kind: str, blocks: tuple[str, ...], condition: str | None) -> DataFrame:
    if beside(data, kind):
        fit_together(data, kind, [(blocks, condition)])
        return data.found[kind, blocks, condition if "lexicon" in blocks else None].where(F.col("fold") == fold).select("key", "fold", "y", "yhat", "score")
    rows = data.rows.drop("text").join(data.fixed(condition if "lexicon" in blocks else None), "key")
    for b in blocks:
        if b not in WIDTH:
            rows = rows.join(data.weights(b, fold), "key", "left")
    ready = cut(vectors(rows, blocks))
    n = sum(v for f, v in data.sizes.items() if f != fold)
    found = _fitted(ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold), kind, n, data.seed)
    best = F.array_max("prob")
    guessed = found.select("key", "fold", "y", (F.array_position("prob", best) - 1).cast("double").alias("label"), best.alias("score"))
    return guessed.join(data.names.withColumnRenamed("y", "yhat"), "label", "left").select("key", "fold", "y", "yhat", "score")


def majority(data: Dataset) -> DataFrame:
    """Every row of a fold guessed as the most frequent class of the others, ties by name."""
    counts = data.rows.groupBy("y", "fold").agg(F.count("*").alias("n"))
    others = counts.withColumnRenamed("fold", "of").withColumn("fold", F.explode(F.array(*map(F.lit, sorted(data.sizes)))))
    train = others.where("fold <> of").groupBy("fold", "y").agg(F.sum("n").alias("n"))
    guess = train.groupBy("fold").agg(F.min(F.struct((-F.col("n")).alias("n"), "y")).alias("x")).select("fold", F.col("x.y").alias("yhat"))
    return data.rows.join(F.broadcast(guess), "fold").select("key", "fold", "y", "yhat", F.lit(1.0).alias("score"))


def stratified_random(folded: DataFrame, key: str, label: str, seed: int = 42, width: int = 64) -> DataFrame:
    """(key, fold, y, yhat): guesses drawn from the class shares by a hash of the key, for any number of classes.

    Each row draws a number below that of all rows; each class owns a range of them. Rows meet ranges in blocks of width
    numbers, so no row is compared with all classes and none is lost.
    """
    counts = folded.groupBy(F.col(label).alias("yhat")).agg(F.count("*").alias("n"))
    total = folded.count()
    bounds = running_sums(counts, ["yhat"], {"high": "n"}).withColumn("low", F.col("high") - F.col("n"))
    ranges = bounds.select("yhat", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("_b"))
    drawn = folded.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(total, 1)))).withColumn("_b", F.floor(F.col("_u") / width))
    return drawn.join(ranges, "_b").where("_u >= low and _u < high").select(key, "fold", F.col(label).alias("y"), "yhat")


def cross_validate(docs: DataFrame, key: str, text: str, label: str, model: str, k: int = 5, seed: int = 42, blocks: tuple[str, ...] = ("word",), lex: DataFrame | None = None) -> DataFrame:
    """(key, fold, y, yhat, score): out-of-fold predictions of one classifier (logreg, svm, cnb, rf) on some blocks. A fold
    that fails is an error."""
    data = Dataset(docs, key, text, label, k, seed, {"given": lex} if lex is not None else {})
    return predict(data, model, "given" if lex is not None else None, (model, blocks), whole=True).withColumnRenamed("key", key)


def score(predictions: DataFrame, name: str) -> DataFrame:
    """One row: the model's name and its metrics over all out-of-fold predictions."""
    return multiclass_metrics(predictions).select(F.lit(name).alias("model"), "*")
