"""Problem 4: same or near-same records across splits, by min-hash bands over word pairs and exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bags import LEFT, OVERLAP, RIGHT, class_pairs, members_of, min_hashes, parse, row_pairs
from lexloom.llm.near_duplicates import unit_texts
from lexloom.llm.words import U, mix
from lexloom.session import table

#: At overlap 0.6 two texts have a Jaccard similarity of 0.43 or more; one of the bands then agrees with probability
#: 1 - (1 - 0.43 ** ROWS) ** BANDS = 0.999; at overlap 0.7, with 0.99999.
BANDS, ROWS = 32, 2


def bands(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[text, band]: a 64-bit key for each band."""
    low = min_hashes(e, starts, BANDS * ROWS, seed=4)
    keys = np.arange(1, BANDS + 1, dtype=U)[None, :]
    for r in range(ROWS):
        keys = mix(keys ^ low[:, r * BANDS : (r + 1) * BANDS])
    return keys


def split_side(split: str) -> Column:
    """train stands left, validation and test stand right; a null or other split takes no part."""
    return F.when(F.col(split) == "train", LEFT).when(F.col(split).isin("validation", "test"), RIGHT).otherwise(0)


def cross_split_pairs(rows: DataFrame, key: str, text: str, split: str, overlap: float = OVERLAP) -> DataFrame:
    """(key_a, key_b), smaller key first: pairs of a train and a validation or test row of at least that overlap.

    Copies are pairs. Null keys, null texts, null splits and texts under 20 words take no part. Only buckets with rows of
    both sides give candidates, and only those pairs are verified. An empty table gives an empty one.
    """
    parsed = parse(rows, key, text, split_side(split))
    return row_pairs(members_of(parsed), class_pairs(parsed, bands, overlap))


def overlap_report(rows: DataFrame, key: str, text: str, split: str, by: str, overlap: float = OVERLAP) -> DataFrame:
    """(split, by, n_pairs, n_records): pairs and records of validation and test that also stand in train.

    Pairs are counted by class, without unfolding them: a record of a class has as many as its own and all linked
    classes have train rows.
    """
    parsed = parse(rows, key, text, split_side(split))
    links, members = class_pairs(parsed, bands, overlap).select("a", "b"), members_of(parsed)
    train = members.where(F.col("side") == LEFT).groupBy("class").agg(F.count("*").alias("n"))
    either = links.union(links.select("b", "a")).union(train.select("class", "class"))
    partners = either.toDF("class", "other").join(train.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("n").alias("n"))
    held = rows.select(F.col(key).cast("bigint").alias("key"), F.col(split).alias("split"), F.col(by).alias("by")).where("split in ('validation', 'test')")
    counts = held.join(members.where(F.col("side") == RIGHT).select("key", "class"), "key").groupBy("class", "split", "by").agg(F.count("*").alias("records"))
    return counts.join(partners, "class").groupBy("split", "by").agg(F.sum(F.col("n") * F.col("records")).alias("n_pairs"), F.sum("records").alias("n_records"))


def _both(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str, str]]:
    docs = table(spark, sf_dir, "genre_documents").select("gdoc_key", "text", "split", "source")
    units = unit_texts(table(spark, sf_dir, "liturgical_units").select("unit_key", "lines", "raw_text", "split", "unit_type"))
    return [("genre_documents", docs, "gdoc_key", "text", "source"), ("liturgical_units", units, "unit_key", "_text", "unit_type")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (cross_split_pairs(rows, key, text, "split").select(F.lit(tab).alias("tab"), "key_a", "key_b") for tab, rows, key, text, _ in _both(spark, sf_dir))
    return a.union(b)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by split and source, for units by split and unit type."""
    a, b = (overlap_report(rows, key, text, "split", by).select(F.lit(tab).alias("tab"), "split", F.col("by").alias("source"), "n_pairs", "n_records") for tab, rows, key, text, by in _both(spark, sf_dir))
    return a.union(b)
