"""Problem 5: splits that keep related records together, by components and subset sums."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators.components import connected_components
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, table

#: Bits of a subset-sum set. Totals beyond it are counted in units of total / BITS rows, and the rest is settled by groups
#: of any size that fit.
BITS = 1 << 22


def tied_groups(rows: DataFrame, key: str, ties: list[list[str]]) -> DataFrame:
    """(key, group_key, size): every row with the smallest key of all rows tied to it directly or through others.

    ties: lists of columns; two rows are tied if all columns of one list are equal. A null, or an empty string, in one
    of the columns ties nothing. Rows that nothing ties are groups of one. Extra columns are ignored; an empty table
    gives an empty one. Keys are unique.

    Only distinct tie values are nodes: each row links the values it has, components are found over those distinct
    links, and rows are joined to them once. A value that holds a third of all rows is joined by broadcast.
    """
    values = []
    for i, tie in enumerate(ties):
        ok = " and ".join(f"`{c}` is not null" for c in tie)
        for c in tie:
            if dict(rows.dtypes)[c] == "string":
                ok += f" and `{c}` <> ''"
        values.append(F.when(F.expr(ok), F.xxhash64(F.lit(i), *tie)))
    nodes = rows.select(F.col(key).alias("_k"), F.array_compact(F.array(*values)).alias("_v"))
    linked = nodes.select("_k", F.get("_v", F.lit(0)).alias("node"), F.expr("slice(_v, 2, size(_v))").alias("more")).where("node is not null")
    links = linked.select(F.col("node").alias("a"), F.explode_outer("more").alias("b")).select("a", F.coalesce("b", "a").alias("b")).distinct()
    roots = cut(connected_components(links))
    sized = cut(linked.groupBy("node").agg(F.count("*").alias("n"), F.min("_k").alias("least")).join(roots, "node"))
    groups = sized.groupBy("root").agg(F.min("least").alias("group_key"), F.sum("n").alias("size"))
    nodes_of = sized.join(groups, "root").select("node", "n", "group_key", "size")
    total = sized.agg(F.sum("n")).first()[0] or 0
    tied = join_by_size(linked.select("_k", "node"), cut(nodes_of), ["node"], "n", total)
    alone = nodes.where("size(_v) = 0").select("_k", F.col("_k").alias("group_key"), F.lit(1).cast("bigint").alias("size"))
    return tied.select("_k", "group_key", "size").union(alone).withColumnRenamed("_k", key)


def _closest(counts: Counter, goal: int, unit: int) -> Counter:
    """How many groups of each size to take, for a total as near to goal as a subset can be (in whole units).

    A bit set holds the totals that can be reached; the multiplicity of a size is split into powers of two, so there
    are about log(multiplicity) steps a size. For each total the first step that reached it is kept (one array of BITS
    numbers, however many steps there are), which leads back to the groups taken.
    """
    most = max(0, -(-goal // unit)) + max([0, *(-(-s // unit) for s in counts)])
    most, want = min(most, 2 * (goal // unit) + 1), goal // unit
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    first = np.full(most + 1, -1, np.int32)
    for size in sorted(counts, reverse=True):
        left, part = counts[size], 1
        while left and not reach >> want & 1:
            take = min(part, left)
            shift = max(1, size * take // unit) if size * take else 0
            fresh = (reach << shift) & mask & ~reach if shift <= most else 0
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                reach |= fresh
            steps.append((size, take, shift))
            left -= take
            part *= 2
    low, high = reach & ((1 << (want + 1)) - 1), reach >> want
    below = low.bit_length() - 1
    above = want + (high & -high).bit_length() - 1 if high else None
    total = below if above is None or want - below <= above - want else above
    taken: Counter = Counter()
    while total:
        size, take, shift = steps[first[total]]
        taken[size] += take
        total -= shift
    return taken


def _settled(taken: Counter, counts: Counter, goal: int) -> Counter:
    """taken with what rounding to units left over made good by the largest groups that still fit, in or out."""
    rest = goal - sum(s * n for s, n in taken.items())
    for size in sorted(counts, reverse=True):
        n = min(counts[size] - taken[size], rest // size) if rest > 0 else -min(taken[size], -rest // size)
        taken[size] += n
        rest -= n * size
    return taken


def choose_counts(sizes: dict[int, int], shares: list[tuple[str, int]]) -> dict[str, Counter]:
    """For each split, how many groups of each size it gets. The split with the largest share takes what is left over."""
    total, whole = sum(s * n for s, n in sizes.items()), sum(p for _, p in shares)
    unit, left, out = max(1, -(-total // BITS)), Counter(sizes), {}
    order = sorted(shares, key=lambda x: (x[1], x[0]))
    for name, pct in order[:-1]:
        goal = round(total * pct / whole) if whole else 0
        out[name] = _closest(left, goal, unit)
        if unit > 1:
            out[name] = _settled(out[name], left, goal)
        left = left - out[name]
    if order:
        out[order[-1][0]] = left
    return out


def assign_splits(grouped: DataFrame, key: str, shares: list[tuple[str, int]]) -> DataFrame:
    """grouped (key, group_key, size) plus split: whole groups, in totals as near to the shares as their sizes allow.

    The sizes and their multiplicities come to the driver: k different sizes need k * k / 2 rows, so there are few.
    Groups are numbered within their size over range partitions, never in one task, and the first of each size go to
    the first split. A group larger than every share goes where it does least harm, to the largest share.
    """
    groups = cut(grouped.groupBy("group_key").agg(F.first("size").alias("size")).repartitionByRange("size", "group_key").withColumn("part", F.spark_partition_id()))
    per_part = groups.groupBy("size", "part").agg(F.count("*").alias("n"))
    sizes = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    chosen, names = choose_counts(sizes, shares), [n for n, _ in sorted(shares, key=lambda x: (x[1], x[0]))]
    bounds = []
    for size in sizes:
        at = 0
        for name in names:
            n = chosen[name][size]
            if n:
                bounds.append((size, at, at + n, name))
                at += n
    spark = grouped.sparkSession
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("size", "part", "before")
    ranked = groups.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("size", "part").orderBy("group_key")) - 1)
    limits = F.broadcast(spark.createDataFrame(bounds, "size bigint, low bigint, high bigint, split string"))
    split_of = ranked.join(limits, "size").where("rank >= low and rank < high").select("group_key", "split", F.col("size").alias("_n"))
    total = sum(s * n for s, n in sizes.items())
    return join_by_size(grouped, cut(split_of), ["group_key"], "_n", total, "left").select(key, "group_key", "size", "split")


TIES = [["unit_id"], ["genre", "source"]]


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied_groups(table(spark, sf_dir, "genre_documents").select("gdoc_key", "unit_id", "genre", "source"), "gdoc_key", TIES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).where("gdoc_key <> group_key").select("group_key", "gdoc_key")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group and new split."""
    shares = [(r["split"], r["share_pct"]) for r in table(spark, sf_dir, "split_targets").where("split is not null and share_pct is not null").collect()]
    return assign_splits(_grouped(spark, sf_dir), "gdoc_key", shares)
