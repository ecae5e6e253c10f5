"""Experiments over models, lexicon conditions and split regimes: tasks, ablation, masking, leakage."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import dedup, metrics, models, splits
from lexloom.operators.lexicon import coverage_total
from lexloom.operators.models import BLOCKS, Dataset
from lexloom.operators.numbering import number_rows
from lexloom.session import cut


@dataclass
class Config:
    """Settings of a run, with the values of the published configuration. Paths are relative to the file they come from."""

    paths: dict[str, str] = field(default_factory=dict)
    n_folds: int = 10
    fast_n_folds: int = 3
    n_repeats: int = 5
    n_bootstrap: int = 1000
    dedupe_threshold: int = 85
    top_k: tuple[int, ...] = (1, 3, 5)
    mask_fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    mask_seeds: tuple[int, ...] = (42, 123, 456, 789, 101)
    method: str = "auto"
    manual_boundary_file: str | None = None
    regex_pattern: str | None = None
    fast_mode: bool = False
    loanword_seeds: tuple[str, ...] = ()
    seed: int = 42

    @property
    def folds(self) -> int:
        return self.fast_n_folds if self.fast_mode else self.n_folds


def load_config(path: str) -> Config:
    """A YAML file: nested sections are flattened by their last name; unknown names are ignored."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    known, found = {f.name for f in fields(Config)}, {"paths": {k: str((Path(path).parent / v).resolve()) for k, v in (raw.pop("paths", None) or {}).items()}}
    for name, value in raw.items():
        for k, v in value.items() if isinstance(value, dict) else [(name, value)]:
            k = {"n_iterations": "n_bootstrap", "numpy_seed": "seed"}.get(k, k)
            if k in known and v is not None:
                found[k] = tuple(v) if isinstance(v, list) else v
    return Config(**found)


def conditions(house: DataFrame | None, externals: list[DataFrame]) -> dict[str, DataFrame | None]:
    """condition -> lexicon: none (no lexicon at all), house, existing (the externals together) and combined. A missing
    house list is an empty lexicon; so are no externals."""
    parts = [x for x in (house, *externals) if x is not None]
    if not parts:
        return {"none": None}
    empty = parts[0].where("false")
    existing = empty
    for e in externals:
        existing = existing.unionByName(e, allowMissingColumns=True)
    own = house if house is not None else empty
    return {"none": None, "house": own, "existing": existing, "combined": own.unionByName(existing, allowMissingColumns=True)}


def evaluate(data: Dataset, named: dict[str, DataFrame | None], fast: bool, positive: str | None = None) -> DataFrame:
    """(model, condition, n_folds, means and deviations over folds) of every model under every condition.

    A model without lexicon features is fitted once and stands for all conditions. positive: the class whose binary F1,
    precision, recall and MCC are reported too. A fold that fails is an error.
    """
    out, once = None, {}
    models.fit_together(data, "logreg", [(blocks, c) for c, lex in named.items() for kind, blocks in models.zoo(lex is not None, fast).values() if kind == "logreg"])
    for condition, lex in named.items():
        for name, (_, blocks) in models.zoo(lex is not None, fast).items():
            lexical = "lexicon" in blocks
            if lexical or name not in once:
                p = models.predict(data, name, condition if lexical else None, whole=True)
                each = metrics.multiclass_metrics(p, ("fold",), 15)
                asked = ["macro_f1", "accuracy"]
                if positive is not None:
                    b = p.select("fold", (F.col("y") == positive).cast("int").alias("y"), (F.col("yhat") == positive).cast("int").alias("yhat"), F.lit(0.5).alias("score"))
                    cols = ["precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc", "kappa"]
                    each = each.drop(*cols).join(metrics.binary_metrics(b, ("fold",)).select("fold", *cols), "fold")
                    asked += cols
                found = cut(each.agg(F.count("*").alias("n_folds"), *(f(m) for m in asked for f in (lambda m: F.round(F.avg(m), 6).alias(f"{m}_mean"), lambda m: F.round(F.stddev_pop(m), 6).alias(f"{m}_std")))))
                if not lexical:
                    once[name] = found
            else:
                found = once[name]
            row = found.select(F.lit(name).alias("model"), F.lit(condition).alias("condition"), "*")
            out = row if out is None else out.union(row)
    return out


def smallest(rows: DataFrame, label: str) -> int:
    return rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0


def task_a(lines: DataFrame, key: str, text: str, genre: str, named: dict[str, DataFrame | None], config: Config) -> DataFrame | None:
    """Songs against other genres, line by line: evaluate() with folds no more than the smaller class has rows. None if
    there are fewer than 10 lines or only songs."""
    rows = cut(lines.where(F.col(genre).isNotNull()).select(key, text, F.when(F.col(genre) == "song", "song").otherwise("other").alias("kind")))
    if rows.count() < 10 or rows.select("kind").distinct().count() < 2:
        return None
    k = splits.fold_count(config.folds, smallest(rows, "kind"))
    return evaluate(Dataset(rows, key, text, "kind", k, config.seed, _some(named)), named, config.fast_mode, "song")


def proxy_task_a(lines: DataFrame, key: str, text: str, unit: str, unit_type: str, named: dict[str, DataFrame | None], config: Config, grouped: bool = False) -> DataFrame | None:
    """Hymns and canticles against prose within one corpus, as a proxy of task A. Needs 2 units of each and 10 lines, else
    None. As published, lines of one unit may stand in train and test; grouped keeps units together."""
    kind = F.when(F.col(unit_type).isin("hymn", "canticle"), "song").when(F.col(unit_type) == "liturgical_prose", "prose")
    rows = cut(lines.select(key, text, F.col(unit).alias("unit"), kind.alias("kind")).where("kind is not null"))
    units = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count_distinct("unit").alias("n")).collect()}
    if min(units.get("song", 0), units.get("prose", 0)) < 2 or rows.count() < 10:
        return None
    k = splits.fold_count(config.folds, smallest(rows, "kind"), sum(units.values()))
    folds = splits.group_folds(rows, key, "unit", "kind", k) if grouped else None
    return evaluate(Dataset(rows, key, text, "kind", k, config.seed, _some(named), folds), named, config.fast_mode, "song")


def _some(named: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    return {c: x for c, x in named.items() if x is not None}


def task_c(lines: DataFrame, key: str, text: str, song: str, named: dict[str, DataFrame | None], config: Config) -> DataFrame | None:
    """Which song a line is from, by classification: evaluate() with the songs as classes. None for fewer than 2 songs."""
    rows = cut(lines.select(key, text, song))
    n = rows.select(song).distinct().count()
    if n < 2:
        return None
    k = splits.fold_count(config.folds, smallest(rows, song), n)
    return evaluate(Dataset(rows, key, text, song, k, config.seed, _some(named)), named, config.fast_mode)


def _regimes(rows: DataFrame, key: str, text: str, label: str, k: int, seed: int, lexicons: dict[str, DataFrame], dealt: list[DataFrame], model: str, condition: str | None) -> list[DataFrame] | None:
    """Predictions for each regime of folds with the same passes over texts and blocks; None where predict() has to do it:
    a row has no fold in a regime, or there are many classes."""
    if len({d.count() for d in (rows, *dealt)}) > 1:
        return None
    data = models.regimes(rows, key, text, label, k, seed, lexicons, dealt)
    return models.fit_regimes(data, model, condition) if models.beside(data, models.ZOO[model][0]) else None


def leakage_inflation(rows: DataFrame, key: str, text: str, label: str, named: dict[str, DataFrame | None], config: Config, near: bool = True) -> DataFrame:
    """(regime, f1, accuracy, mcc): a model cross-validated over plain folds and over folds that keep near-duplicate texts
    together, and the gap. near: groups of similar texts (for short ones), else of equal ones. A fold that fails, or has no
    others to learn from (as where all texts are one group), is an error."""
    rows = cut(rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label))
    groups = dedup.similar_groups(rows, key, text, config.dedupe_threshold) if near else dedup.exact_groups(rows, key, text)
    grouped = cut(rows.join(groups, key))
    k = splits.fold_count(config.folds, smallest(rows, label), grouped.select("group_key").distinct().count())
    lex = _some(named).get("combined")
    model, out = ("hybrid_logreg", {}) if lex is not None else ("tfidf_logreg", {})
    condition = "combined" if lex is not None else None
    dealt = [cut(splits.stratified_folds(rows.select(key, F.col(label).cast("string").alias("y")), key, "y", k, config.seed).select(key, "fold")), cut(splits.group_folds(grouped, key, "group_key", label, k))]
    found = _regimes(rows, key, text, label, k, config.seed, _some(named), dealt, model, condition)
    for i, regime in enumerate(("non_grouped", "deduplicated")):
        p = found[i] if found else models.predict(Dataset(rows, key, text, label, k, config.seed, _some(named), dealt[i]), model, condition, whole=True)
        a = metrics.multiclass_metrics(p, ("fold",), 15).agg(*(F.avg(m).alias(m) for m in ("macro_f1", "accuracy", "mcc")))
        out[regime] = cut(a.select(F.lit(regime).alias("regime"), F.col("macro_f1").alias("f1"), "accuracy", "mcc"))
    both = out["non_grouped"].union(out["deduplicated"])
    sign = F.when(F.col("regime") == "non_grouped", 1.0).otherwise(-1.0)
    gap = both.agg(*(F.when(F.count(m) == 2, F.sum(sign * F.col(m))).alias(m) for m in ("f1", "accuracy", "mcc"))).select(F.lit("leakage_inflation_gap").alias("regime"), "f1", "accuracy", "mcc")
    return both.union(gap).select("regime", *(F.round(m, 6).alias(m) for m in ("f1", "accuracy", "mcc")))


#: Feature blocks and lexicons that each configuration of the ablation keeps.
ABLATIONS = {
    "full_combined": (BLOCKS, "combined"),
    "without_house": (BLOCKS, "existing"),
    "without_existing": (BLOCKS, "house"),
    "without_lexicon": (("word", "char", "loanword", "stats"), None),
    "without_loanwords": (("word", "char", "lexicon", "stats"), "combined"),
    "without_text_stats": (("word", "char", "lexicon", "loanword"), "combined"),
    "lexicon_only": (("lexicon", "loanword", "stats"), "combined"),
}


def ablation(data: Dataset, configs: dict | None = None) -> DataFrame:
    """One row for each configuration: mean and deviation over folds of a logistic regression. Features without a fit are
    made once for all of them. A fold that fails is an error."""
    out = None
    models.fit_together(data, "logreg", [*(configs or ABLATIONS).values()])
    for name, (blocks, lex) in (configs or ABLATIONS).items():
        p = models.predict(data, name, lex, ("logreg", blocks), whole=True)
        one = cut(metrics.fold_summary(p).select(F.lit(name).alias("ablation_condition"), "*"))
        out = one if out is None else out.union(one)
    return out


def masking(rows: DataFrame, key: str, text: str, label: str, lex: DataFrame, config: Config) -> DataFrame:
    """(mask_fraction, seed, remaining_headwords, coverage_pct, total_coverage_pct, f1_macro, accuracy): coverage and a
    hybrid logistic regression with a part of the headwords masked (in the order of md5 of seed and headword)."""
    k = splits.fold_count(config.folds, smallest(rows.where(F.col(label).isNotNull()), label))
    heads = cut(lex.select("headword").distinct())
    n, out = heads.count(), None
    types = cut(rows.select(F.explode(models.ft.tokens(F.col(text))).alias("token")).distinct())
    for fraction in (0.0, *(f for f in config.mask_fractions if f > 0)):
        for seed in (0,) if fraction == 0 else config.mask_seeds:
            order = number_rows(heads.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "headword"))), ["_h", "headword"], "_i")
            left = cut(lex.join(order.where(F.col("_i") >= math.floor(n * fraction)).select("headword"), "headword", "left_semi"))
            data = Dataset(rows, key, text, label, k, config.seed, {"masked": left})
            s = metrics.fold_summary(models.predict(data, "hybrid_logreg", "masked", whole=True))
            c = coverage_total(types, left)
            one = s.join(F.broadcast(c)).select(F.lit(fraction).alias("mask_fraction"), F.lit(seed).alias("seed"), F.lit(n - math.floor(n * fraction)).alias("remaining_headwords"), F.round(100.0 * F.col("direct") / F.greatest("n_types", F.lit(1)), 6).alias("coverage_pct"), F.col("total_pct").alias("total_coverage_pct"), F.col("macro_f1_mean").alias("f1_macro"), F.col("accuracy_mean").alias("accuracy"))
            one = cut(one)
            out = one if out is None else out.union(one)
    return out
