import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import experiments, metrics, models, splits
from lexloom.operators.transformers import LexiconFeatures, Loanwords, TextStats


def verses(spark, n=120, seed=1):
    """Two kinds of texts with words of their own."""
    rnd = random.Random(seed)
    words = {"a": [f"ka{i}" for i in range(30)], "b": [f"to{i}" for i in range(30)]}
    rows = [(i, " ".join(rnd.choice(words[y] if rnd.random() < 0.8 else words["ab"["ba".index(y)]]) for _ in range(8)), y) for i in range(n) for y in ["ab"[i % 2]]]
    return spark.createDataFrame([*rows, (n, None, "a"), (n + 1, "x", None)], "k bigint, t string, y string")


def lexicon(spark):
    return spark.createDataFrame([(f"ka{i}", "s", None, "NOUN", "g", i) for i in range(20)], "headword string, source string, normalised_form string, pos string, gloss string, ord bigint")


def test_zoo_learns_and_shuffled_labels_do_not(spark):
    rows = verses(spark)
    data = models.Dataset(rows, "k", "t", "y", 2, lexicons={"given": lexicon(spark)})
    acc = lambda p: metrics.multiclass_metrics(p).first()["accuracy"]
    for name in ("tfidf_logreg", "tfidf_cnb", "tfidf_svm", "lexicon_only_logreg"):
        p = models.predict(data, name, "given")
        assert p.count() == 120 and acc(p) > 0.8, name
        assert p.where("score is null or score <= 0 or score > 1.000001").count() == 0
    assert abs(acc(models.predict(data, "majority")) - 0.5) < 0.1
    shuffled = rows.withColumn("y", F.when(F.xxhash64(F.lit(5), "k") % 2 == 0, "a").otherwise("b"))
    p = models.cross_validate(shuffled, "k", "t", "y", "logreg", 2, blocks=("word", "char"))
    assert acc(p) < 0.8 and set(p.columns) == {"k", "fold", "y", "yhat", "score"}


def test_vectors_are_the_features(spark):
    data = models.Dataset(verses(spark, 20), "k", "t", "y", 2)
    rows = data.rows.drop("text").join(data.fixed(None), "key").join(data.weights("word", 0), "key", "left")
    out = {r["key"]: r["raw"] for r in models.vectors(rows, ("word", "loanword", "stats")).collect()}
    for r in rows.collect():
        v = out[r["key"]].toArray()
        w = np.zeros(models.Dataset.LIMIT)
        for x in r["word"] or []:
            w[x["i"]] = x["w"]
        assert np.allclose(v[: len(w)], w / (np.linalg.norm(w) or 1)) and np.allclose(v[len(w) :], [*r["loanword"], *r["stats"]])


def test_side_by_side_fits_are_those_of_spark(spark, monkeypatch):
    """oof_predictions, hybrid_logreg, ablation, tasks: with the same vocabularies, scaling, penalty, and classes."""
    rows = verses(spark, 60).withColumn("y", F.when(F.col("k") % 5 == 4, "c").otherwise(F.col("y")))
    for rows, kind, near in ((rows, "cnb", 1e-6), (rows, "logreg", 0.05), (rows.where("y <> 'c'"), "logreg", 0.05)):
        data = models.Dataset(rows, "k", "t", "y", 2, lexicons={"given": lexicon(spark)})
        blocks = ("word", "char") if kind == "cnb" else models.BLOCKS
        own = {r["key"]: r for r in models.predict(data, kind, "given", (kind, blocks)).collect()}
        monkeypatch.setattr(models, "FEW", 0)
        for r in models.predict(data, kind, "given", (kind, blocks)).collect():
            assert abs(r["score"] - own[r["key"]]["score"]) < near and r["fold"] == own[r["key"]]["fold"]
            assert r["yhat"] == own[r["key"]]["yhat"] or kind == "logreg" and r["score"] < 0.5 + near
        assert len(own) == sum(data.sizes.values())
        monkeypatch.undo()


def test_fits_of_many_rows_begin_with_a_part(spark, monkeypatch):
    """The start at a part of the rows changes the way, not the optimum; no text is shuffled by term."""
    from lexloom.operators import linear

    data = models.Dataset(verses(spark, 200), "k", "t", "y", 2)
    whole = {r["key"]: r["score"] for r in models.predict(data, "x", None, ("logreg", ("word", "char", "stats"))).collect()}
    monkeypatch.setattr(linear, "MANY", 10)
    data.found.clear()
    part = {r["key"]: r["score"] for r in models.predict(data, "x", None, ("logreg", ("word", "char", "stats"))).collect()}
    assert whole.keys() == part.keys() and max(abs(whole[k] - part[k]) for k in whole) < 0.05
    assert not data._terms


def test_words_are_counted_without_rare_pairs(spark, monkeypatch):
    """hybrid_logreg, leakage_inflation: the most frequent terms are those of word_terms, and a pair that can't be among
    them is never a row; blocks count each term as word_terms does, and parts of blocks hold their rows as they are."""
    from lexloom.operators import features as ft
    from lexloom.operators import linear

    texts = ["ab cd, ab-cd x ab", "x y z", "Éa éa ab cd_1 q cd_1 ab", "", "ef gh ab cd ef gh", "𐐨𐐩 𐐨𐐩 1² ab ab", "rare once ab"]
    rows = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts * 3)], "key bigint, fold int, text string")
    whole = collections.Counter()
    for r in ft.word_terms(rows, "key", "text").join(rows.select("key", "fold"), "key").collect():
        whole[r["term"], r["fold"]] += r["tf"]
    got = linear._word_counts(rows, [0, 1, 2], 4)
    counts = {r["term"]: [r["n0"], r["n1"], r["n2"]] for r in got.collect()}
    assert all(n == [whole[t, f] for f in range(3)] for t, n in counts.items())
    assert "ab cd" in counts and "rare" in counts and "rare once" not in counts
    brute = spark.createDataFrame([(t, *(whole[t, f] for f in range(3))) for t in {t for t, _ in whole}], "term string, n0 bigint, n1 bigint, n2 bigint")
    (a, b), (c, d) = linear.frequent(got, [0, 1, 2], 4), linear.frequent(brute, [0, 1, 2], 4)
    assert dict(zip(a, b.T.tolist(), strict=True)) == dict(zip(c, d.T.tolist(), strict=True))

    data = models.Dataset(rows.withColumn("y", F.col("fold").cast("string")), "key", "text", "y", 3)
    found, made = {}, linear.Blocks(data, ("word", "char"), (), False)
    for b in made.blocks.collect():
        _, _, n, place, count, _ = linear._unpack(b["data"])
        at = np.repeat(np.arange(len(n)), n)
        found |= {(b["keys"][i], made.terms[int(j >= made.spans["char"][0])][j - made.spans["char"][0] * int(j >= made.spans["char"][0])], int(j >= made.spans["char"][0])): c for i, j, c in zip(at.tolist(), place.tolist(), count.tolist(), strict=True)}
        whole_rows, part = linear._Rows(b["data"], made._frame()), linear._Rows(linear._part(b["data"], 2), made._frame())
        assert (part.label == whole_rows.label[::2]).all() and np.allclose(part.length.reshape(-1, 2, 3), whole_rows.length.reshape(-1, 2, 3)[::2])
    kinds = [{(r["key"], r["term"], i): r["tf"] for r in data.terms(k)[0].collect()} for i, k in enumerate(("word", "char"))]
    assert found == kinds[0] | kinds[1]


def test_failed_fold_is_null(spark, monkeypatch):
    data = models.Dataset(verses(spark, 20), "k", "t", "y", 2)
    real = models._fold
    monkeypatch.setattr(models, "_fold", lambda d, fold, *a: real(d, fold, *a) if fold else 1 / 0)
    p = models.predict(data, "tfidf_cnb")
    assert p.count() == 20 and p.where("fold = 0 and yhat is null").count() == data.sizes[0] and p.where("fold = 1 and yhat is null").count() == 0


def test_random_guesses_of_many_classes(spark):
    rows = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 2000).cast("string").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    got = models.stratified_random(rows, "k", "y")
    assert got.count() == 6000 and got.select("yhat").distinct().count() > 1500


def test_platt(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.random() < 1 / (1 + math.exp(-(2 * m + 1)))), [-m, m]) for m in (rnd.uniform(-3, 3) for _ in range(4000))]
    a, b = models.platt(spark.createDataFrame(rows, "label double, margins array<double>"))[1]
    assert abs(a - 2) < 0.3 and abs(b - 1) < 0.3


def test_regimes(spark):
    rows = spark.createDataFrame([(i, "xy"[i // 4 % 2], i // 2, i // 3) for i in range(48)], "k bigint, y string, song int, dup int")
    r = splits.split_regimes(rows, "k", "y", 4, 2, "song", "dup")
    assert set(r) == {"non_grouped", "grouped", "deduplicated"} and r["non_grouped"].count() == 96
    for name, group in (("grouped", "song"), ("deduplicated", "dup")):
        j = r[name].join(rows, "k")
        assert j.groupBy(group).agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and j.count() == 48
    spread = collections.Counter((x["y"], x["fold"]) for x in r["grouped"].join(rows, "k").collect())
    assert max(spread.values()) - min(spread.values()) <= 2 and len(spread) == 8
    assert "grouped" not in splits.split_regimes(rows, "k", "y", 4, 1, "song", None, "C")
    assert set(splits.split_regimes(rows.withColumn("dup", F.lit(1)), "k", "y", 4, 1, None, "dup")) == {"non_grouped"}
    assert splits.regime_or_stratified(rows, "k", "y", {}, "grouped", 5).agg(F.max("fold")).first()[0] == 2
    assert splits.fold_count(10, 3, None) == 3 and splits.fold_count(10, 1) == 2


def test_leakage_and_tasks(spark):
    fast = experiments.Config(fast_mode=True, fast_n_folds=2)
    rows = verses(spark, 40).where("y is not null and t is not null")
    gap = {r["regime"]: r for r in experiments.leakage_inflation(rows, "k", "t", "y", {"none": None}, fast, near=False).collect()}
    assert abs(gap["leakage_inflation_gap"]["f1"] - (gap["non_grouped"]["f1"] - gap["deduplicated"]["f1"])) < 1e-5 and len(gap) == 3
    lines = rows.withColumn("genre", F.when(F.col("y") == "a", "song").otherwise("poetry"))
    named = experiments.conditions(lexicon(spark), [])
    out = {(r["model"], r["condition"]): r for r in experiments.task_a(lines, "k", "t", "genre", named, fast).collect()}
    assert len(out) == 2 * 4 + 3 and out["tfidf_logreg", "none"]["macro_f1_mean"] > 0.7
    assert out["tfidf_logreg", "none"][2:] == out["tfidf_logreg", "house"][2:]
    assert experiments.task_a(lines.where("genre = 'song'"), "k", "t", "genre", named, fast) is None
    assert experiments.task_c(lines.limit(1), "k", "t", "y", named, fast) is None
    units = lines.select("k", "t", (F.col("k") % 10).alias("u"), F.when(F.col("y") == "a", "hymn").otherwise("liturgical_prose").alias("kind"))
    assert experiments.proxy_task_a(units, "k", "t", "u", "kind", {"none": None}, fast, grouped=True).count() == 2
    assert experiments.proxy_task_a(units.where("u < 1"), "k", "t", "u", "kind", {"none": None}, fast) is None


def test_masking(spark):
    config = experiments.Config(n_folds=2, mask_fractions=(0.5, 1.0), mask_seeds=(1,))
    rows = verses(spark, 30).where("t is not null and y is not null")
    out = {(r["mask_fraction"], r["seed"]): r for r in experiments.masking(rows, "k", "t", "y", lexicon(spark), config).collect()}
    assert [out[k]["remaining_headwords"] for k in ((0.0, 0), (0.5, 1), (1.0, 1))] == [20, 10, 0]
    assert out[0.0, 0]["coverage_pct"] > out[0.5, 1]["coverage_pct"] > out[1.0, 1]["coverage_pct"] == 0 and out[0.0, 0]["f1_macro"] > 0.7


def test_transformers(spark):
    df = spark.createDataFrame([("Gloria a b",), (None,), ("gloria a b",), ("ka1 x",)], "text string")
    out = LexiconFeatures(outputCol="l").on(lexicon(spark)).transform(Loanwords(outputCol="w").transform(TextStats(outputCol="s").transform(df)))
    rows = {r["text"]: r for r in out.collect()}
    assert out.count() == 4 and rows["Gloria a b"]["w"].toArray().tolist() == [round(1 / 3, 6), 1] and rows["ka1 x"]["l"][0] == 0.5
    assert rows[None]["s"].toArray().tolist() == [0.0] * 7 and rows["Gloria a b"]["s"][4] == 3


def test_statistics(spark):
    p = spark.createDataFrame([(i, "ab"[i % 2], "ab"[i % 2], i % 3) for i in range(12)], "k bigint, y string, yhat string, fold int")
    m = metrics.multiclass_metrics(p).first()
    assert all(m[c] == 1 for c in ("accuracy", "macro_f1", "micro_recall", "weighted_precision", "mcc", "kappa"))
    assert metrics.fold_summary(p).first().asDict() == {"n_folds": 3, "macro_f1_mean": 1.0, "macro_f1_std": 0.0, "accuracy_mean": 1.0, "accuracy_std": 0.0}
    for r in metrics.bootstrap_ci(p, "k", 100, metrics=("accuracy", "mcc")).collect():
        assert r["low"] <= r["point"] <= r["high"] and r["point"] == 1
    s = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.1), ("b", "a", 0.3), ("b", "b", 0.7), ("c", "a", 0.95), ("c", "b", 0.2)], "y string, label string, score double")
    assert {r["label"]: r["auc"] for r in metrics.ovr_auc(s).collect()} == {"a": 0.5, "b": 1.0}
    t = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "f int, a double, b double")
    r = metrics.paired_stats(t, "f").first()
    assert abs(r["w_p"] - 2 / 64) < 1e-6 and abs(r["t_p"] - 0.005926) < 2e-4 and r["w"] == 0
    none = metrics.paired_stats(t.limit(1), "f").first()
    assert none["t"] is None and none["t_p"] is None and none["w_p"] is None
    assert abs(metrics.signed_rank_p_value([1.5, 1.5, 3.0], 0.0, 3) - math.erfc(3 / (math.sqrt(13.5) / 2) / math.sqrt(2))) < 1e-12


def test_forest_splits_are_the_best(spark):
    """cv_rf: each split is the best by Gini of the columns that its node drew, found by brute force; leaves have no split."""
    from lexloom.operators import forest

    rnd = np.random.default_rng(3)
    n, p, classes = 200, 30, 3
    dense = np.where(rnd.random((n, p)) < 0.2, rnd.integers(1, forest.BINS, (n, p)), 0).astype(np.uint8)
    dense[7] = 0
    label, weight = rnd.integers(0, classes, n), rnd.poisson(1.0, n)
    row, place = np.nonzero(dense)
    data = forest._Sorted(place.astype(np.uint16), dense[row, place], np.bincount(row, minlength=n).astype(np.int32), p)
    assert data.groups == 5
    dense, label, weight = dense[data.order], label[data.order], weight[data.order]
    trees = forest._Trees(0, np.flatnonzero(weight).astype(np.int32), weight[weight > 0].astype(np.uint8), classes, label, (1, 0))
    seen = set()
    gini = lambda on: sum(weight[on & (label == c)].sum() ** 2 for c in range(classes)) / max(weight[on].sum(), 1)
    at = np.zeros(n, int)
    for level in range(6):
        data.deal(np.random.default_rng(level))
        assert sorted(x for c in data.columns for x in c) == list(range(p)) and min(map(len, data.columns)) >= 6
        groups = trees.random.bit_generator.state
        trees.split(data)
        column, low, child, share = trees.whole()
        again = np.random.default_rng(0)
        again.bit_generator.state = groups
        open_ = [i for i in range(len(column)) if i in set(at[weight > 0]) and i not in seen and len(set(label[(at == i) & (weight > 0)])) > 1]
        seen |= set(range(max(at) + 1))
        for i, g in zip(open_, again.integers(data.groups, size=len(open_)), strict=True):
            on = at == i
            gain = {(f, b): gini(on & (dense[:, f] >= b)) + gini(on & (dense[:, f] < b)) - gini(on) for f in data.columns[g] for b in range(1, forest.BINS) if weight[on & (dense[:, f] >= b)].sum() and weight[on & (dense[:, f] < b)].sum()}
            best = max(gain.values(), default=0)
            assert best < 1e-9 if column[i] < 0 else abs(gain[column[i], low[i]] - best) < 1e-9
            if column[i] >= 0:
                at[on] = child[i] + (dense[on, column[i]] >= low[i])
        for i in set(at[weight > 0]):
            assert np.allclose(share[i], [weight[(at == i) & (label == c)].sum() / weight[at == i].sum() for c in range(classes)], atol=1e-6)
    assert (column >= 0).sum() > 10


def test_forests_need_no_dense_vectors(spark, monkeypatch):
    """cv_rf: forests are fitted on the blocks, the same whatever way the rows come, and learn what those of Spark learn."""
    rows = verses(spark)
    monkeypatch.setattr(models, "TREES", 20)
    spec = ("rf", ("word", "stats"))
    data = models.Dataset(rows, "k", "t", "y", 2)
    own = {r["key"]: r for r in models.predict(data, "rf", None, spec).collect()}
    assert not data._terms
    again = {r["key"]: r for r in models.predict(models.Dataset(rows.repartition(5, F.rand()), "k", "t", "y", 2), "rf", None, spec).collect()}
    assert len(own) == 120 and {k: (r["fold"], r["y"], r["yhat"]) for k, r in own.items()} == {k: (r["fold"], r["y"], r["yhat"]) for k, r in again.items()}
    assert max(abs(r["score"] - again[k]["score"]) for k, r in own.items()) < 1e-9 and all(0.5 <= r["score"] <= 1 for r in own.values())
    monkeypatch.setattr(models, "FEW", 0)
    whole = {r["key"]: r for r in models.predict(data, "rf", None, spec).collect()}
    right = [sum(r["y"] == r["yhat"] for r in x.values()) for x in (own, whole)]
    assert min(right) > 90 and abs(right[0] - right[1]) <= 12, right


def test_bins_of_a_column():
    """cv_rf: all values of a column that has few, quantiles of one that has many; zeros and negative values keep their order."""
    from lexloom.operators import forest

    few, many = np.array([-2.5, 0.0, -0.0, 1.0, 3.0, 1.0], np.float32), np.linspace(0.01, 1, 310, dtype=np.float32)
    place = np.repeat(np.array([0, 2], np.uint16), [6, 310])
    edges = forest._edges(place, np.concatenate((few, many)), 3)
    b = forest._binned(edges, place, np.concatenate((few, many)))
    assert b[:6].tolist() == [1, 2, 2, 3, 4, 3] and np.bincount(b[6:])[1:].tolist() == [10] * 31 and np.isinf(edges[1]).all()
    assert forest._binned(edges, np.array([2, 2], np.uint16), np.array([0.0, 9.0], np.float32)).tolist() == [1, 31]


def test_regimes_are_fitted_side_by_side(spark, monkeypatch):
    """leakage_inflation: texts become blocks once for both regimes, and each fold of each has the guesses of its own fit."""
    from lexloom.operators import linear

    rows = verses(spark, 60).where("y is not null and t is not null")
    dealt = [rows.select("k", (F.col("k") % 3).cast("int").alias("fold")), rows.select("k", (F.col("k") / 20).cast("int").alias("fold"))]
    made, real = [], linear.Blocks.__init__
    monkeypatch.setattr(linear.Blocks, "__init__", lambda self, *a: (made.append(1), real(self, *a))[1])
    fast = experiments.Config(fast_mode=True, fast_n_folds=2)
    experiments.leakage_inflation(rows, "k", "t", "y", {"none": None}, fast, near=False)
    assert len(made) == 1
    both = models.fit_regimes(models.regimes(rows, "k", "t", "y", 3, 42, {}, dealt), "tfidf_logreg")
    for folds, p in zip(dealt, both, strict=True):
        alone = {r["key"]: r for r in models.predict(models.Dataset(rows, "k", "t", "y", 3, folds=folds), "tfidf_logreg").collect()}
        own = {r["key"]: r for r in p.collect()}
        assert own.keys() == alone.keys() and len(own) == 60
        assert all(own[k]["fold"] == r["fold"] and own[k]["y"] == r["y"] and (own[k]["yhat"] == r["yhat"] and abs(own[k]["score"] - r["score"]) < 0.05 or r["score"] < 0.55) for k, r in alone.items())


def failing(monkeypatch, fold=0):
    """One fold can't be fitted, side by side or alone."""
    real = models._fold
    monkeypatch.setattr(models, "_fold", lambda d, f, *a: 1 / 0 if f == fold else real(d, f, *a))


def test_ablation_of_a_failed_fold_is_an_error(spark, monkeypatch):
    """ablation: means of the folds that are left aren't given as those of all, nor is a missing guess a class."""
    rows = verses(spark, 20)
    one = {"lexicon_only": (("stats",), None)}
    assert experiments.ablation(models.Dataset(rows, "k", "t", "y", 2), one).first()["n_folds"] == 2
    with pytest.raises(ValueError, match="none to learn from"):
        experiments.ablation(models.Dataset(rows.where("k < 1"), "k", "t", "y", 2), one)
    p = spark.createDataFrame([("a", "a", 0), ("a", None, 1)], "y string, yhat string, fold int")
    with pytest.raises(Exception, match="no guess"):
        metrics.fold_summary(p).collect()
    failing(monkeypatch)
    with pytest.raises(RuntimeError, match="fold 0 failed"):
        experiments.ablation(models.Dataset(rows, "k", "t", "y", 2), one)


def test_cross_validation_of_a_failed_fold_is_an_error(spark, monkeypatch):
    """cv_*: a fold that failed isn't scored as wrong guesses of a class without a name."""
    rows = verses(spark, 20)
    monkeypatch.setattr(models, "TREES", 2)
    assert models.cross_validate(rows, "k", "t", "y", "rf", 2, blocks=("stats",)).where("yhat is null").count() == 0
    failing(monkeypatch, 1)
    with pytest.raises(RuntimeError, match="fold 1 failed"):
        models.cross_validate(rows, "k", "t", "y", "rf", 2, blocks=("stats",))


def test_fits_without_a_finite_loss_are_an_error(spark):
    """hybrid_logreg: a feature that is no number doesn't leave weights of zero, whose guesses look like others."""
    data = models.Dataset(verses(spark, 20), "k", "t", "y", 2)
    data._fixed[None] = data.fixed(None).withColumn("stats", F.transform("stats", lambda x: x * float("nan")))
    with pytest.raises(RuntimeError, match="fold 0 failed") as e:
        models.predict(data, "x", None, ("logreg", ("word", "stats")), whole=True)
    assert "finite" in str(e.value.__cause__)


def test_rows_without_a_guess_are_an_error(spark, monkeypatch):
    """oof_predictions: neither a row that got lost, nor one whose guess is null or no number, is passed on."""
    rows, real = verses(spark, 20), models._fold
    cv = lambda: models.cross_validate(rows, "k", "t", "y", "cnb", 2, blocks=("word", "char"))
    assert cv().count() == 20
    nan = F.when(F.col("key") == 3, float("nan")).otherwise(F.col("score"))
    for spoil in (lambda p: p.where("key <> 3"), lambda p: p.withColumn("yhat", F.when(F.col("key") != 3, F.col("yhat"))), lambda p: p.withColumn("score", nan)):
        monkeypatch.setattr(models, "_fold", lambda *a, spoil=spoil: spoil(real(*a)))
        with pytest.raises(RuntimeError, match="19 of 20 rows"):
            cv()


def test_leakage_of_failed_fits_is_an_error(spark, monkeypatch):
    """leakage_inflation: neither means without the folds that failed, nor guesses of a fit on no rows."""
    rows, fast = verses(spark, 20).where("y is not null and t is not null"), experiments.Config(fast_mode=True, fast_n_folds=2)
    run = lambda rows: experiments.leakage_inflation(rows, "k", "t", "y", {"none": None}, fast, near=False)
    with pytest.raises(ValueError, match="none to learn from"):
        run(rows.withColumn("t", F.lit("ka1 to1")))
    real = models._together
    monkeypatch.setattr(models, "_together", lambda *a: real(*a).where("fold <> 0"))
    with pytest.raises(RuntimeError, match="of 20 rows have a guess"):
        run(rows)
    monkeypatch.setattr(models, "_together", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(rows)


def test_task_of_a_failed_fold_is_an_error(spark, monkeypatch):
    """proxy_task_a_grouped, task_a: no means over the folds that are left, and no fits one by one where those side by side failed."""
    lines = verses(spark, 40).where("y is not null and t is not null").select("k", "t", (F.col("k") % 10).alias("u"), F.when(F.col("y") == "a", "hymn").otherwise("liturgical_prose").alias("kind"))
    run = lambda: experiments.proxy_task_a(lines, "k", "t", "u", "kind", {"none": None}, experiments.Config(fast_mode=True, fast_n_folds=2), grouped=True)
    failing(monkeypatch)
    with pytest.raises(RuntimeError, match="fold 0 failed"):
        run()
    monkeypatch.setattr(models, "_together", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run()


def test_proxy_task_is_registered_as_a_whole(spark, monkeypatch):
    """proxy_task_a: ten models and ten folds, as published, not the three of fast mode."""
    from lexloom.plans import catalog

    seen = []
    monkeypatch.setattr(models, "Dataset", lambda rows, key, text, label, k, *a: seen.append(k))
    monkeypatch.setattr(experiments, "evaluate", lambda data, named, fast, positive: seen.append(sorted(models.zoo(True, fast))))
    catalog.QUERIES["proxy_task_a"](spark, "/root/testdata/sf0.01")
    assert seen[-1] == sorted(models.ZOO) and len(seen[-1]) == 10
    monkeypatch.setattr(experiments, "proxy_task_a", lambda *a: seen.append(a[-1].folds))
    catalog.QUERIES["proxy_task_a"](spark, "/root/testdata/sf0.01")
    assert seen[-1] == 10
