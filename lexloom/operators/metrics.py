"""Classification metrics, resampling and paired statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators.numbering import running_sums

_d = lambda a, b: F.when(b != 0, a / b)
_r = lambda c: F.round(c, 6)


def binary_metrics(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """p (y, yhat, score) -> one row (for each by): counts, accuracy, balanced accuracy, precision, recall, specificity, F1, MCC, kappa,
    log loss and Brier score. Undefined ratios are 0 as usual, MCC and kappa too."""
    clipped = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    cells = (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    a = p.groupBy(*by).agg(*(F.count_if((F.col("y") == y) & (F.col("yhat") == h)).cast("double").alias(n) for n, y, h in cells), F.avg(-F.log(F.when(F.col("y") == 1, clipped).otherwise(1 - clipped))).alias("ll"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("br"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rec, spec, prec = zero(_d(tp, tp + fn)), zero(_d(tn, tn + fp)), zero(_d(tp, tp + fp))
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    mcc = zero(_d(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)))
    out = {"accuracy": _d(tp + tn, n), "balanced_accuracy": (rec + spec) / 2, "precision": prec, "recall": rec, "specificity": spec, "f1": zero(_d(2 * tp, 2 * tp + fp + fn)), "mcc": mcc, "kappa": zero(_d((tp + tn) / n - pe, 1 - pe)), "log_loss": F.col("ll"), "brier": F.col("br")}
    return a.select(*by, *(c.cast("bigint").alias(x) for c, x in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (tn, "tn"))), *(_r(c).alias(k) for k, c in out.items()))


def ranking_areas(p: DataFrame) -> DataFrame:
    """p (y, score) -> (roc_auc, pr_auc): by rank sums with average ranks, and by steps of recall times precision. Rows are
    first counted for each distinct score; sums run over range partitions. Null where a class is missing."""
    g = p.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).withColumn("down", -F.col("score"))
    run = running_sums(g, ["down"], {"cp": "pos", "cn": "neg"})
    a = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("cp") - F.col("pos") / 2.0)).alias("area"), F.sum(F.col("pos") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("steps"))
    return a.select(_r(_d(F.col("area"), F.col("p") * F.col("n"))).alias("roc_auc"), _r(_d(F.col("steps"), F.col("p"))).alias("pr_auc"))


def confusion(p: DataFrame) -> DataFrame:
    """(y, yhat, n, share): counts, and shares of each true class."""
    n = p.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    return n.withColumn("share", _r(F.col("n") / F.sum("n").over(W.partitionBy("y"))))


def _cells(p: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, y, yhat, n): the confusion matrix; p may have weights w."""
    n = F.sum("w") if "w" in p.columns else F.count("*")
    return p.groupBy(*by, "y", "yhat").agg(n.alias("n"))


def class_metrics(p: DataFrame, digits: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, tp, n_true, n_pred, precision, recall, f1) over the labels of either side, 0 where undefined. by:
    columns of separate evaluations, such as folds or draws."""
    n = _cells(p, by)
    sides = n.select(*by, F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("h")), F.struct(F.col("yhat").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("h")))).alias("x"), "n", (F.col("y") == F.col("yhat")).alias("same"))
    a = sides.groupBy(*by, "x.label").agg(F.sum(F.when(F.col("same") & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("x.t")).alias("n_true"), F.sum(F.col("n") * F.col("x.h")).alias("n_pred"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.select(*by, "label", "tp", "n_true", "n_pred", F.round(zero(_d(F.col("tp"), F.col("n_pred"))), digits).alias("precision"), F.round(zero(_d(F.col("tp"), F.col("n_true"))), digits).alias("recall"), F.round(zero(_d(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred"))), digits).alias("f1"))


def multiclass_metrics(p: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """One row (for each by): accuracy, balanced accuracy; precision, recall and F1 in macro, micro and weighted mean; MCC
    and kappa, from the class counts. 0 where undefined."""
    c = class_metrics(p, 15, by)
    d = lambda x: F.col(x).cast("double")
    means = [f(m) for m in ("precision", "recall", "f1") for f in (lambda m: F.avg(m).alias(f"macro_{m}"), lambda m: (F.sum(F.col(m) * F.col("n_true")) / F.sum("n_true")).alias(f"weighted_{m}"))]
    sums = [F.sum("tp").cast("double").alias("c"), F.sum("n_true").cast("double").alias("s"), F.sum(d("n_true") * F.col("n_pred")).alias("x"), F.sum(d("n_true") * F.col("n_true")).alias("tt"), F.sum(d("n_pred") * F.col("n_pred")).alias("pp"), F.avg(F.when(F.col("n_true") > 0, F.col("recall"))).alias("balanced_accuracy")]
    a = c.groupBy(*by).agg(*sums, *means) if by else c.agg(*sums, *means)
    cc, s, x, tt, pp = (F.col(k) for k in ("c", "s", "x", "tt", "pp"))
    r = lambda col: F.round(col, digits)
    mcc = F.coalesce(_d(cc * s - x, F.sqrt(s * s - pp) * F.sqrt(s * s - tt)), F.lit(0.0))
    kappa = F.coalesce(_d(cc / s - x / (s * s), 1 - x / (s * s)), F.lit(0.0))
    named = [r(F.col(f"{m}_{k}")).alias(f"{m}_{k}") for m in ("macro", "weighted") for k in ("precision", "recall", "f1")]
    micro = [r(_d(cc, s)).alias(f"micro_{k}") for k in ("precision", "recall", "f1")]
    return a.select(*by, r(_d(cc, s)).alias("accuracy"), r("balanced_accuracy").alias("balanced_accuracy"), *named, *micro, r(mcc).alias("mcc"), r(kappa).alias("kappa"))


def fold_summary(p: DataFrame, metrics: tuple[str, ...] = ("macro_f1", "accuracy")) -> DataFrame:
    """p (fold, y, yhat) -> one row: the folds, and of each metric its mean and population deviation over them. A row
    without a guess is an error: its fold failed, and means of the others would look like those of all."""
    guess = F.coalesce("yhat", F.raise_error(F.lit("fold_summary: a row has no guess")))
    each = multiclass_metrics(p.withColumn("yhat", guess), ("fold",), 15)
    return each.agg(F.count("*").alias("n_folds"), *(f(m) for m in metrics for f in (lambda m: _r(F.avg(m)).alias(f"{m}_mean"), lambda m: _r(F.stddev_pop(m)).alias(f"{m}_std"))))


def ovr_auc(p: DataFrame) -> DataFrame:
    """p (y, label, score), a row for each record and label -> (label, auc) of each label against the rest, null where
    one side is missing. Rows are first counted for each score; sums run over range partitions."""
    g = p.groupBy("label", "score").agg(F.count_if(F.col("y") == F.col("label")).alias("pos"), F.count_if(F.col("y") != F.col("label")).alias("neg")).withColumn("down", -F.col("score"))
    run = running_sums(g, ["label", "down"], {"cp": "pos"})
    own = run.groupBy("label").agg(F.min(F.col("cp") - F.col("pos")).alias("before"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    area = run.join(own, "label").groupBy("label").agg(F.sum(F.col("neg") * (F.col("cp") - F.col("before") - F.col("pos") / 2.0)).alias("area"), F.first("p").alias("p"), F.first("n").alias("n"))
    return area.select("label", _r(_d(F.col("area"), F.col("p") * F.col("n"))).alias("auc"))


#: The cumulative Poisson(1) distribution as far as 32 random bits can tell: a weight of 12 has probability 6e-11 < 2^-32.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12))


def bootstrap_ci(p: DataFrame, key: str, draws: int, level: float = 0.95, metrics: tuple[str, ...] = ("accuracy",)) -> DataFrame:
    """p (key, y, yhat) -> (metric, point, low, high) of any metrics of multiclass_metrics.

    Each row gets a Poisson(1) weight for each draw from 32 bits of md5 of draw and key, so resampling moves no rows: what
    is shuffled is one confusion matrix a draw. Percentiles are interpolated. A draw of no rows at all is left out.
    """
    each = p.select(key, "y", "yhat", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    w = sum((F.when(u >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    stat = multiclass_metrics(each.select("draw", "y", "yhat", w.alias("w")).where("w > 0"), ("draw",), 15)
    tail = (1 - level) / 2
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select("x.metric", "x.v")
    q = long(stat).groupBy("metric").agg(F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    point = long(multiclass_metrics(p, (), 15))
    return point.join(q, "metric", "left").select("metric", _r("v").alias("point"), _r(F.coalesce(F.col("q")[0], F.col("v"))).alias("low"), _r(F.coalesce(F.col("q")[1], F.col("v"))).alias("high"))


def paired_stats(p: DataFrame, order: str) -> DataFrame:
    """p (order, a, b), one row for each fold or group -> one row: mean and population deviation of a - b, Cohen's d, t and
    its two-sided p, the signed-rank sum and its p. t needs 2 rows that differ in their difference, the signed ranks 6
    rows and a difference; else they are null. For lists of folds: the rank window takes them in one task."""
    d = p.select(order, (F.col("a") - F.col("b")).alias("d"))
    nonzero = d.where("d <> 0").withColumn("ad", F.round(F.abs("d"), 12))
    rank = nonzero.withColumn("r", F.rank().over(W.orderBy("ad")) + (F.count("*").over(W.partitionBy("ad")) - 1) / 2.0)
    plus = rank.agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("wm"), F.collect_list("r").alias("ranks"))
    a = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.stddev_samp("d").alias("ss"))
    one = F.lit(1).alias("_k")
    t = F.when((F.col("n") >= 2) & (F.col("ss") > 0), F.col("mean") / (F.col("ss") / F.sqrt("n")))
    w = F.when((F.col("n") >= 6) & (F.size("ranks") > 0), F.least("wp", "wm"))
    j = a.select("*", one).join(plus.select("*", one), "_k").withColumn("t", t).withColumn("w", w)
    told = j.select("n", "mean", "sd", "t", "w", "ranks").mapInArrow(_p_values, "n bigint, mean double, sd double, t double, w double, t_p double, w_p double")
    return told.select("n", _r("mean").alias("mean_diff"), _r("sd").alias("std_diff"), _r(F.col("mean") / F.greatest("sd", F.lit(1e-10))).alias("cohens_d"), _r("t").alias("t"), _r("t_p").alias("t_p"), _r("w").alias("w"), _r("w_p").alias("w_p"))


def _p_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, t, w, ranks = (b.column(i).to_pylist() for i in (0, 3, 4, 5))
        t_p = [None if x is None else t_p_value(x, k - 1) for x, k in zip(t, n, strict=True)]
        w_p = [None if x is None else signed_rank_p_value(r, x, k) for x, r, k in zip(w, ranks, n, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t_p, pa.float64()), pa.array(w_p, pa.float64())], ["n", "mean", "sd", "t", "w", "t_p", "w_p"])


def signed_rank_p_value(ranks: list[float], w: float, n: int) -> float:
    """Two-sided p of the smaller signed-rank sum: exact for up to 50 differences without ties and zeros, else by the
    normal distribution with the variance that ties leave."""
    if n <= 50 and len(ranks) == n and len(set(ranks)) == n:
        return wilcoxon_p_value(ranks, w)
    sd = math.sqrt(sum(r * r for r in ranks)) / 2
    return math.erfc(abs(w - sum(ranks) / 2) / sd / math.sqrt(2)) if sd else 1.0


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1.0 + num * d) or 1e-300)
                c = (1.0 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def wilcoxon_p_value(ranks: list[float], w: float) -> float:
    """Exact two-sided p of the smaller signed-rank sum, by counting subsets of (doubled) ranks."""
    counts, total = {0: 1}, 2 ** len(ranks)
    for r in (round(2 * x) for x in ranks):
        new = dict(counts)
        for s, n in counts.items():
            new[s + r] = new.get(s + r, 0) + n
        counts = new
    return min(1.0, 2.0 * sum(n for s, n in counts.items() if s <= round(2 * w)) / total)


def holm(p: DataFrame, name: str, alpha: float = 0.05) -> DataFrame:
    """p (name, p) -> rank, adjusted = min(p * (n - rank), 1) and significant, without a running maximum; ties by name.
    For lists of tests, which one task ranks."""
    r = F.row_number().over(W.orderBy("p", name)) - 1
    n = p.count()
    return p.withColumn("rank", r).select(name, "p", "rank", _r(F.least(F.col("p") * (n - F.col("rank")), F.lit(1.0))).alias("adjusted"), (F.col("p") <= alpha / (n - F.col("rank"))).alias("significant"))


def low_power(p: DataFrame, label: str, least: int) -> DataFrame:
    return p.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < least)


def confused_pairs(p: DataFrame) -> DataFrame:
    """(a, b, n): unordered pairs of true and predicted labels among the errors."""
    return p.where("y <> yhat").groupBy(F.least("y", "yhat").alias("a"), F.greatest("y", "yhat").alias("b")).agg(F.count("*").alias("n"))
