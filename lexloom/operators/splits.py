"""Cross-validation folds as a column. Orders come from md5, so they are the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.numbering import number_rows
from lexloom.operators.skew import join_by_size
from lexloom.session import cut


def stratified_folds(rows: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """rows plus fold: rows of a class are dealt out in turn, so its counts differ by at most one between folds. Numbers
    run over (class, hash), without a window over a class."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return number_rows(rows.withColumn("_h", h), [label, "_h", key], "_i").withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i", "_h")


def repeated_folds(rows: DataFrame, key: str, label: str, k: int, repeats: int, seed: int) -> DataFrame:
    """rows plus repeat and fold; repeat r deals with seed + r."""
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.md5(F.concat_ws(":", (F.col("repeat") + seed).cast("string"), F.col(key).cast("string")))
    return number_rows(each.withColumn("_h", h), ["repeat", label, "_h", key], "_i").withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i", "_h")


def group_folds(rows: DataFrame, key: str, group: str, label: str, k: int) -> DataFrame:
    """(key, group, fold): whole groups, with the classes spread evenly. No group stands in two folds.

    Groups are ordered by the class that most of their rows have, the largest first, and dealt out there and back, so
    that each fold gets large and small groups of every class. Only (group, class) counts are shuffled, numbers come from
    range partitions, and a group with a third of all rows is joined with salts. A null group is none.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("_n"))
    main = cut(counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("down"), F.col(label).alias("label"))).alias("x"), F.sum("_n").alias("_n")))
    ordered = main.select(group, F.coalesce(F.col("x.label").cast("string"), F.lit("")).alias("_label"), F.col("x.down").alias("_down"), "_n")
    at = F.pmod(F.col("_i"), F.lit(2 * k))
    folds = cut(number_rows(ordered, ["_label", "_down", group], "_i").select(group, "_n", F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int").alias("fold")))
    return join_by_size(rows, folds, [group], "_n", folds.agg(F.sum("_n")).first()[0] or 0).select(key, group, "fold")


def fold_count(asked: int, *bounds: int | None) -> int:
    """The folds asked for, but no more than any bound (the smallest class, the groups), and at least 2."""
    return max(2, min([asked, *(b for b in bounds if b is not None)]))


def split_regimes(rows: DataFrame, key: str, label: str, k: int, repeats: int = 1, song: str | None = None, dedup: str | None = None, task: str = "A", seed: int = 42) -> dict[str, DataFrame]:
    """regime -> (key, repeat, fold). non_grouped: stratified, repeated; grouped: by song, for tasks A, B and D only, since
    in task C the song is the label; deduplicated: by near-duplicate group. A regime of fewer than 2 groups is left out,
    and none has more folds than groups."""
    out = {"non_grouped": repeated_folds(rows.select(key, label), key, label, k, repeats, seed).select(key, "repeat", "fold")}
    for name, group in (("grouped", song if task in ("A", "B", "D") else None), ("deduplicated", dedup)):
        if group is None:
            continue
        n = rows.select(group).where(F.col(group).isNotNull()).distinct().count()
        if n >= 2:
            out[name] = group_folds(rows.select(key, group, label), key, group, label, min(k, n)).select(key, F.lit(0).alias("repeat"), "fold")
    return out


def regime_or_stratified(rows: DataFrame, key: str, label: str, regimes: dict[str, DataFrame], name: str, k: int, seed: int = 42) -> DataFrame:
    """The regime of that name, or, where there is none, at most 3 stratified folds."""
    if name in regimes:
        return regimes[name]
    return stratified_folds(rows.select(key, label), key, label, min(k, 3), seed).select(key, F.lit(0).alias("repeat"), "fold")
