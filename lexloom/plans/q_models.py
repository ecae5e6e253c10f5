"""Queries that train models; they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators import experiments, models, splits
from lexloom.plans import base
from lexloom.session import cut, table

QUERIES, ORACLES = {}, {}
#: Folds of the classifiers, as many as of majority_baseline, and the settings of the experiments: as published, and in fast mode.
FOLDS = 5
FULL, FAST = experiments.Config(), experiments.Config(fast_mode=True)


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _docs(spark, d):
    return table(spark, d, "genre_documents").select("gdoc_key", "text", "genre")


def _cv(name: str, **more):
    def run(spark, d):
        return models.score(models.cross_validate(_docs(spark, d), "gdoc_key", "text", "genre", name, FOLDS, **more), name)

    return run


QUERIES["cv_logreg"] = _cv("logreg")
QUERIES["cv_cnb"] = _cv("cnb")
QUERIES["cv_rf"] = _cv("rf")
QUERIES["cv_svm_ovr"] = _cv("svm")


@query("stratified_random")
def _(spark, d):
    f = splits.stratified_folds(_docs(spark, d).where("genre is not null"), "gdoc_key", "genre", FOLDS, 42)
    return models.score(models.stratified_random(f, "gdoc_key", "genre"), "stratified_random")


@query("hybrid_logreg")
def _(spark, d):
    return models.score(models.cross_validate(_docs(spark, d), "gdoc_key", "text", "genre", "logreg", FOLDS, blocks=models.BLOCKS, lex=base.combined(spark, d)), "hybrid_logreg")


def _conditions(spark, d):
    return experiments.conditions(cut(base.house(spark, d)), [cut(base.external(spark, d))])


@query("ablation")
def _(spark, d):
    named = {c: x for c, x in _conditions(spark, d).items() if x is not None}
    return experiments.ablation(models.Dataset(_docs(spark, d), "gdoc_key", "text", "genre", FOLDS, lexicons=named))


@query("oof_predictions")
def _(spark, d):
    """Out-of-fold guesses of the genre with their probability."""
    return models.cross_validate(_docs(spark, d), "gdoc_key", "text", "genre", "cnb", FOLDS, blocks=("word", "char")).select("gdoc_key", "fold", "y", "yhat", F.round("score", 6).alias("score"))


@query("leakage_inflation")
def _(spark, d):
    """The genre by plain folds and by folds that keep copies together."""
    return experiments.leakage_inflation(_docs(spark, d), "gdoc_key", "text", "genre", {"none": None}, FAST, near=False)


@query("task_a")
def _(spark, d):
    """Lines of songs against lines of other genres, all conditions, in fast mode (three models, three folds)."""
    docs = table(spark, d, "genre_documents").select("gdoc_key", "genre", F.posexplode("lines").alias("line_no", "text"))
    lines = docs.where(F.size(tokens(F.col("text"))) >= 2).withColumn("line_key", F.concat_ws(":", F.col("gdoc_key").cast("string"), F.col("line_no").cast("string")))
    return experiments.task_a(lines, "line_key", "text", "genre", _conditions(spark, d), FAST)


def _unit_lines(spark, d):
    lines = base.lines(spark, d).where(F.size(tokens(F.col("line"))) >= 2)
    return lines.select(F.concat_ws(":", F.col("unit_key").cast("string"), F.col("line_no").cast("string")).alias("line_key"), "unit_key", "unit_type", F.col("line").alias("text"))


@query("proxy_task_a")
def _(spark, d):
    """Lines of hymns and canticles against lines of prose, all conditions, ten models and ten folds."""
    return experiments.proxy_task_a(_unit_lines(spark, d), "line_key", "text", "unit_key", "unit_type", _conditions(spark, d), FULL)


@query("proxy_task_a_grouped")
def _(spark, d):
    """The same with the lines of a unit in one fold, in fast mode."""
    return experiments.proxy_task_a(_unit_lines(spark, d), "line_key", "text", "unit_key", "unit_type", _conditions(spark, d), FAST, grouped=True)
