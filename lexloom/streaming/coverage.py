"""Lexicon coverage of a stream of lines by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens


def windowed_coverage(lines: DataFrame, lex: DataFrame, ts: str, line: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n_tokens, covered) for each window of event time; lines later than the watermark are left out.

    lines may be a stream or a table; the lexicon is a table, joined as the static side.
    """
    heads = lex.select(F.col("headword").alias("token"), F.lit(1).alias("hit")).distinct()
    each = lines.withWatermark(ts, late).select(ts, F.explode(tokens(F.col(line))).alias("token")).join(heads, "token", "left")
    return each.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n_tokens"), F.count("hit").alias("covered")).select(F.col("w.start").alias("start"), "n_tokens", "covered")
