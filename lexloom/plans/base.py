"""How the reference concepts stand in the tables: lines, token types, lexicons, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.lexicon import entries
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, spread, table

SONG_TYPES = ("hymn", "canticle")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(unit_key, unit_type, line_no, line) of all units."""
    return spread(table(spark, d, "liturgical_units").select("unit_key", "unit_type", unit_lines().alias("lines"))).select("unit_key", "unit_type", F.posexplode("lines").alias("line_no", "line"))


def unit_lines() -> Column:
    """The lines of a unit, or those of raw_text where lines is null."""
    return F.coalesce("lines", F.split("raw_text", "\n"))


def types(spark: SparkSession, d: str) -> DataFrame:
    """(token): the token types of all lines."""
    return lines(spark, d).select(F.explode(tokens(F.col("line"))).alias("token")).distinct()


def house(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "house_lexicon").withColumn("source", F.lit("house_list"))
    return entries(t, "word", "number", "source", "normalized_ilocano", "upos_tag", "english_translation")


def external(spark: SparkSession, d: str) -> DataFrame:
    return entries(table(spark, d, "lexicon_entries"), "headword", "entry_id", "source", "normalised_form", "pos", "gloss")


def combined(spark: SparkSession, d: str) -> DataFrame:
    return house(spark, d).withColumn("tier", F.lit(0)).unionByName(external(spark, d).withColumn("tier", F.lit(1)))


def unit_text() -> Column:
    return F.coalesce(F.array_join("lines", "\n"), F.col("raw_text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, content): each unit as a page that begins with its title."""
    return spread(table(spark, d, "liturgical_units")).select(F.col("unit_key").alias("page"), F.concat_ws("\n", "title", unit_text()).alias("content"))


def with_titles(rows: DataFrame, key: str, titles: DataFrame) -> DataFrame:
    """rows plus the title of each key, ``Song <key>`` where titles (key, title) has none."""
    return rows.join(titles.select(key, "title"), key, "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Song "), F.col(key).cast("string"))))


def shared_by(pairs: DataFrame, value: str, key: str) -> DataFrame:
    """The distinct (value, key) whose value several keys have; a value of very many keys is joined with salts."""
    n = cut(pairs.groupBy(value).agg(F.count("*").alias("_n")).where("_n > 1"))
    return join_by_size(pairs, n, [value], "_n", n.agg(F.sum("_n")).first()[0] or 0).select(value, key)
