"""Problem 2: duplicates hidden by formatting, by progressive refinement of classes."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.words import U, mix
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, table

FIELDS = ("headword", "normalised_form", "source")


def squeezed(c: str) -> Column:
    """The value without white space and punctuation (Unicode P), in lower case. Accents, digits and the rest count."""
    bare = F.regexp_replace(F.col(c), r"(?U)[\s\p{P}\x1c-\x1f]+", "")
    return F.lower(bare)


def _weights(field: int) -> np.ndarray:
    """A 64-bit weight for every byte: letters (in either case) and digits of ASCII count, all else does not."""
    out = np.zeros(256, U)
    for k, low in enumerate(string.ascii_lowercase + string.digits):
        out[[ord(low), ord(low.upper())]] = mix(np.array([k + 1 + 64 * field], U))[0]
    return out


def histogram_keys(values: pa.Array) -> pa.Array:
    """A struct of strings -> one 64-bit key: of each value whether it is null, and its ASCII letters and digits in any
    order and case, which fixes their number too. Sums of byte weights over whole Arrow buffers, no loop over rows."""
    total = np.zeros(len(values), U)
    for i, v in enumerate(values.flatten()):
        v = v.cast(pa.binary())
        _, offsets, data = v.buffers()
        at = np.frombuffer(offsets, np.int32, len(v) + 1, 4 * v.offset).astype(np.int64) if len(v) else np.zeros(1, np.int64)
        taken = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_weights(i)[taken], dtype=U)))
        own = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
        own = np.where(v.is_null().to_numpy(zero_copy_only=False), U(0x5851F42D4C957F2D), own)
        total = mix(total ^ own) if i else mix(own)
    return pa.array(total.view(np.int64))


def _ascii_alike(c: str) -> Column:
    """The value with its case folded where that can matter to ASCII letters: some other letters fold to them."""
    return F.when(F.octet_length(c) == F.length(c), F.col(c)).otherwise(F.lower(c))


def several_members(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(_k, _f0, ...): the rows that share their cheap key with another row; only these need a costlier one."""
    names = [f"_f{i}" for i in range(len(fields))]
    raw = rows.select(F.col(key).alias("_k"), *(F.col(f).alias(n) for f, n in zip(fields, names, strict=True)))
    keyed = raw.withColumn("_inv", F.arrow_udf(histogram_keys, "bigint")(F.struct(*(_ascii_alike(n).alias(n) for n in names))))
    coarse = cut(keyed.groupBy("_inv").agg(F.count("*").alias("_n")).where("_n > 1"))
    total = coarse.agg(F.sum("_n")).first()[0] or 0
    return join_by_size(keyed, coarse, ["_inv"], "_n", total).select("_k", *names)


def format_copies(rows: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of rows that agree in all fields up to white space, letter case and punctuation.

    classes: (copies bigint, first_key) of the classes with several members; members: (key, first_key, copies)
    of all their rows. Null equals only null; an empty value, or one of nothing but punctuation, equals such values.
    Fields are told apart by position, so their order in the input and extra columns don't matter. An empty table gives
    none. A class that holds a third of all rows is counted by partial aggregates and joined with salts.

    Classes are refined step by step, each key only inside classes that still have several rows: (1) letter and digit
    histograms of the raw values, 8 bytes a row, for the whole table; (2) the squeezed values (regular expressions),
    as a 64-bit hash; (3) the squeezed values themselves.
    """
    names = [f"_f{i}" for i in range(len(fields))]
    # one string that tells the values apart: each with its length, a null without one
    squeezed_values = several_members(rows, key, fields).select("_k", *(squeezed(n).alias(n) for n in names))
    exact = F.concat(*(F.coalesce(F.concat(F.length(n).cast("string"), F.lit("="), F.col(n)), F.lit("-")) for n in names))
    several = cut(squeezed_values.select("_k", exact.alias("_exact")))
    hashed = several.withColumn("_h", F.xxhash64("_exact"))
    fine = cut(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1"))
    total = fine.agg(F.sum("_n")).first()[0] or 0
    alike = join_by_size(hashed, fine, ["_h"], "_n", total).select("_k", "_exact")
    classes = cut(alike.groupBy("_exact").agg(F.count("*").alias("copies"), F.min("_k").alias("first_key")).where("copies > 1"))
    members = join_by_size(alike, classes, ["_exact"], "copies", total)
    return classes.drop("_exact"), members.select(F.col("_k").alias(key), "first_key", "copies")


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id and the three fields of lexicon_entries and of the parsed payloads of lexicon_raw.

    A payload that is no JSON object has all fields null.
    """
    entries = table(spark, sf_dir, "lexicon_entries").select("entry_id", *FIELDS)
    raw = table(spark, sf_dir, "lexicon_raw").select("entry_id", F.from_json("payload", ", ".join(f"{f} string" for f in FIELDS)).alias("j"))
    return entries.unionByName(raw.select("entry_id", *(F.col(f"j.{f}").alias(f) for f in FIELDS)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = format_copies(lexicon_rows(spark, sf_dir), "entry_id")
    return members.where("entry_id <> first_key").select(F.col("first_key").alias("id_a"), F.col("entry_id").alias("id_b"))


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry once, with the number of its copies; the row with the smallest entry_id stands for its class."""
    rows = lexicon_rows(spark, sf_dir)
    _, members = format_copies(rows, "entry_id")
    return rows.join(members, "entry_id", "left").where("first_key is null or first_key = entry_id").select("entry_id", *FIELDS, F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
