"""Connected components by parallel hooking and shortcutting over a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import HEAVY_SHARE
from lexloom.session import cut, drop_cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a bigint, b bigint) -> (node bigint, root bigint), root being the smallest node of the component.

    Each round is large-star then small-star over distinct edges: every node hooks its neighbours onto its smallest one,
    and then itself, which halves paths (shortcutting), so rounds grow with the logarithm of the longest path. Nodes of
    many edges are never gathered: minima are partial aggregates, and the minimum of a node with more than one in
    HEAVY_SHARE of the edges is broadcast to its edges instead of moving them. Self loops keep lone nodes; null ends are
    ignored; an empty input gives an empty table. Each round is cut by checkpoint(), so a lost executor costs one round;
    the files of the round before are deleted.
    """
    both = edges.where("a is not null and b is not null").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct()
    nodes = cut(both)
    star = nodes.where("a <> b")
    seen = (star.count(), None)
    last = None
    for _ in range(max_rounds):
        star = cut(_small(_large(star, 2 * seen[0]), 2 * seen[0]))
        if last is not None:
            drop_cut(last)
        last = star
        mark = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    every = nodes.select(F.col("a").alias("node")).union(nodes.select(F.col("b").alias("node"))).distinct()
    return every.join(star.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _with_min(sided: DataFrame, total: int) -> DataFrame:
    """sided (u, v), of about total rows, plus m, the smallest of u and all its v."""
    mins = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    limit = max(total // HEAVY_SHARE, 1000)
    heavy = F.broadcast(mins.where(F.col("n") > limit).select("u", F.col("m").alias("hm")))
    marked = sided.join(heavy, "u", "left")
    light = mins.where(F.col("n") <= limit).select("u", "m")
    return marked.where("hm is not null").select("u", "v", F.col("hm").alias("m")).union(marked.where("hm is null").select("u", "v").join(light, "u").select("u", "v", "m"))


def _large(star: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest one."""
    sided = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_min(sided, total).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(star: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to its smallest one."""
    found = _with_min(star.select(F.col("a").alias("u"), F.col("b").alias("v")), total)
    ends = found.select(F.col("v").alias("a"), F.col("m").alias("b")).union(found.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return ends.where("a <> b").distinct()
