"""Problem 6: near-duplicate records with small edits, by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bags import LEFT, OVERLAP, RIGHT, candidates, class_pairs, members_of, min_hashes, parse, row_pairs, run_pairs, shared_buckets, verify
from lexloom.llm.words import U, mix
from lexloom.operators.components import connected_components
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, table

#: Fingerprints of a text, their symbols, and the symbols that a variant drops. Two fingerprints that differ in at most
#: DROPPED of SYMBOLS symbols lie within 2 * DROPPED deletions and insertions of each other; each emits every variant
#: within half of that, DROPPED deletions, and both meet at what they share. Symbols are minima over the text's pairs of
#: neighbouring words, so texts of Jaccard similarity j agree in a symbol with probability j. At overlap 0.6
#: (j >= 0.43) a fingerprint meets with probability 0.58 and one of six does with 0.994; at 0.65 that is 0.998. A ball of two dropped symbols of four is
#: the same as 36 bands of two minima, of which those of one fingerprint depend on each other.
FINGERPRINTS, SYMBOLS, DROPPED = 6, 4, 2


def ball(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[text, variant]: a 64-bit key for every variant of every fingerprint."""
    symbols = min_hashes(e, starts, FINGERPRINTS * SYMBOLS, seed=6)
    out = []
    for f in range(FINGERPRINTS):
        own = [symbols[:, f * SYMBOLS + i] for i in range(SYMBOLS)]
        for v, kept in enumerate(combinations(range(SYMBOLS), SYMBOLS - DROPPED)):
            key = np.full(len(starts), f * 64 + v + 1, U)
            for i in kept:
                key = mix(key ^ own[i])
            out.append(key)
    return np.stack(out, axis=1)


def unit_texts(units: DataFrame) -> DataFrame:
    """units plus _text: the lines joined by line breaks, or raw_text where lines is null."""
    return units.withColumn("_text", F.coalesce(F.array_join("lines", "\n", ""), F.col("raw_text")))



def _parsed(rows: DataFrame, key: str, text: str) -> DataFrame:
    return parse(rows, key, text, F.lit(LEFT | RIGHT))


def near_duplicate_pairs(rows: DataFrame, key: str, text: str, overlap: float = OVERLAP) -> DataFrame:
    """(key_a, key_b): all pairs of rows of at least that overlap, copies included, smaller key first.

    Null keys, null, empty and short texts (under 20 words) take no part; repeated rows are pairs; extra columns are
    ignored; an empty table gives an empty one.
    """
    parsed = _parsed(rows, key, text)
    return row_pairs(members_of(parsed), class_pairs(parsed, ball, overlap))


def near_duplicate_groups(rows: DataFrame, key: str, text: str, overlap: float = OVERLAP) -> DataFrame:
    """(key, group_key, size): every row that takes part with the smallest key of its group, and the group's rows. A row
    near to no other is a group of its own.

    Not all pairs of a group are verified: first each class of a bucket meets only the first of the bucket and the one
    before it, which is linear in the bucket and joins the bulk of every cluster; then all candidate pairs that the
    groups so far leave apart are verified, those within a group never come up. So no link between groups is lost,
    and a cluster of n edited copies costs about n verifications, not n * n / 2.
    """
    parsed = _parsed(rows, key, text)
    buckets = shared_buckets(parsed, ball)
    thin = cut(run_pairs(buckets.withColumn("g", F.lit(0).cast("bigint")), overlap, thin=True).select("a", "b").distinct())
    links = verify(parsed, thin, overlap).select("a", "b")
    roots = cut(connected_components(links)).select(F.col("node").alias("class"), "root")
    grouped = buckets.join(roots, "class", "left").withColumn("g", F.coalesce("root", "class")).drop("root")
    apart = grouped.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("bucket")
    left = cut(grouped.join(apart, "bucket"))
    rest = candidates(parsed, left.drop("g"), overlap, left.select("class", "g").distinct()).join(thin, ["a", "b"], "left_anti")
    more = verify(parsed, rest, overlap).select("a", "b")
    if not more.isEmpty():
        roots = cut(connected_components(links.union(more))).select(F.col("node").alias("class"), "root")
    classes = cut(members_of(parsed).groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("n")).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
    groups = classes.groupBy("root").agg(F.min("least").alias("group_key"), F.sum("n").alias("size"))
    of = cut(classes.join(groups, "root").select("class", "n", "group_key", "size"))
    total = of.agg(F.sum("n")).first()[0] or 0
    return join_by_size(members_of(parsed), of, ["class"], "n", total).select("key", "group_key", "size")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(unit_texts(table(spark, sf_dir, "liturgical_units").select("unit_key", "lines", "raw_text")), "unit_key", "_text")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its group and the group's size; one whose text takes no part (null or short) is a group of its own."""
    units = unit_texts(table(spark, sf_dir, "liturgical_units").select("unit_key", "lines", "raw_text"))
    groups = near_duplicate_groups(units, "unit_key", "_text").withColumnRenamed("key", "unit_key")
    each = units.select("unit_key").join(groups, "unit_key", "left")
    return each.select("unit_key", F.coalesce("group_key", "unit_key").alias("group_key"), F.coalesce("size", F.lit(1)).cast("bigint").alias("size"))
