"""Units of a paged text: pages, headings, blank lines, patterns, manual slices, and the choice between them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import is_heading, speaker_of, stripped, unit_type
from lexloom.operators.numbering import number_rows
from lexloom.session import cut

PAGE_MARK = r"={10,}[ \t]*\nPAGE[ \t]+\d+[ \t]*\n={10,}[ \t]*\n"


def split_pages(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page int, content): what follows each page mark, stripped. Text before the first mark is dropped."""
    parts = F.split(F.col(text), PAGE_MARK)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(0)), lambda m: F.regexp_extract(m, r"PAGE[ \t]+(\d+)", 1).cast("int"))
    return raw.select(key, F.explode(F.arrays_zip(numbers.alias("page"), bodies.alias("content"))).alias("x")).select(key, F.col("x.page").alias("page"), stripped(F.col("x.content")).alias("content"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page, line_no, line): the lines that aren't blank, stripped."""
    return pages.select("page", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).select("page", "line_no", stripped(F.col("raw")).alias("line")).where("line <> ''")


def _typed(units: DataFrame) -> DataFrame:
    return units.withColumn("unit_type", unit_type(F.col("title"), F.col("text"), F.col("speaker")))


def by_headings(pages: DataFrame) -> DataFrame:
    """(unit_id, page, title, n_lines, speaker, text, unit_type): a heading of more than 5 characters begins a unit, every
    page begins anew, and a heading without lines is dropped."""
    lines = page_lines(pages).withColumn("head", is_heading(F.col("line")) & (F.length("line") > 5))
    block = W.partitionBy("page").orderBy("line_no")
    blocks = lines.withColumn("block", F.sum(F.col("head").cast("int")).over(block))
    units = blocks.groupBy("page", "block").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("heading"),
        F.count_if(~F.col("head")).alias("n_lines"),
        F.min_by(speaker_of(F.col("line")), F.when(~F.col("head") & speaker_of(F.col("line")).isNotNull(), F.col("line_no"))).alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("text"),
    )
    units = units.where("n_lines > 0").withColumn("title", F.coalesce("heading", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" block"))))
    return _typed(number_rows(units, ["page", "block"], "unit_id")).select("unit_id", "page", "title", "n_lines", "speaker", "text", "unit_type")


def by_blank_lines(pages: DataFrame) -> DataFrame:
    """As by_headings; units are blocks between blank lines, named by their first line if it is a heading."""
    blocks = pages.select("page", F.posexplode(F.split("content", r"\n[\t\x0b\f\r\n ]*\n")).alias("block", "body"))
    lines = blocks.select("page", "block", F.filter(F.transform(F.split("body", "\n"), stripped), lambda x: x != "").alias("lines")).where("size(lines) > 0")
    units = number_rows(lines, ["page", "block"], "unit_id")
    first = F.col("lines")[0]
    spoken = F.filter(F.transform("lines", speaker_of), lambda x: x.isNotNull())
    units = units.select("unit_id", "page", F.when(is_heading(first), first).otherwise(F.concat(F.lit("Block "), F.col("unit_id").cast("string"))).alias("title"), F.size("lines").cast("bigint").alias("n_lines"), F.get(spoken, F.lit(0)).alias("speaker"), F.array_join("lines", "\n").alias("text"))
    return _typed(units)


def by_pattern(pages: DataFrame, pattern: str) -> DataFrame:
    """(page, unit_id, title, text): parts between matches; unit_id is the part's index, so empty parts leave gaps. A
    pattern with groups gives what they capture as parts, too (by Python, which knows that form of split).

    Each row is split for itself: hand a whole corpus as one row, or its pages as rows.
    """
    if re.compile(pattern).groups:
        cut_ = F.arrow_udf(lambda texts: pa.array([None if t is None else [x or "" for x in re.split(pattern, t)] for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")
        bodies = cut_("content")
    else:
        bodies = F.split("content", pattern)
    parts = pages.select("page", F.posexplode(bodies).alias("unit_id", "body")).select("page", "unit_id", stripped(F.col("body")).alias("text")).where("text <> ''")
    return parts.select("page", "unit_id", F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), "text")


def plausibility(units: DataFrame, method: str) -> DataFrame:
    """(method, n_units, avg_lines, n_types, score): how plausible a segmentation is, 0 for none."""
    a = units.agg(F.count("*").alias("n"), F.avg("n_lines").alias("avg_lines"), F.count_distinct("unit_type").alias("n_types"), F.count_if(F.col("n_lines") <= 1).alias("tiny"))
    n_score = F.when(F.col("n").between(5, 30), 1.0).when(F.col("n").between(3, 50), 0.6).otherwise(0.2)
    size_score = F.when(F.col("avg_lines").between(3, 30), 1.0).when(F.col("avg_lines").between(1, 50), 0.5).otherwise(0.2)
    score = 0.3 * n_score + 0.3 * size_score + 0.2 * F.least(F.col("n_types") / 3.0, F.lit(1.0)) + 0.2 * F.greatest(1 - F.col("tiny") / F.greatest("n", F.lit(1)), F.lit(0.0))
    return a.select(F.lit(method).alias("method"), F.col("n").alias("n_units"), F.round("avg_lines", 6).alias("avg_lines"), "n_types", F.round(F.when(F.col("n") > 0, score).otherwise(0.0), 6).alias("score"))


def best_method(scores: DataFrame) -> DataFrame:
    """The row of the highest score; headings win a tie."""
    return scores.orderBy(F.desc("score"), F.when(F.col("method") == "headings", 0).otherwise(1)).limit(1)


def manual_slices(lines: DataFrame, bounds: DataFrame, width: int = 64) -> DataFrame:
    """(title, unit_type, n_lines, text): lines (n, line) with start_line <= n < end_line of each bound; a range join by
    blocks of width line numbers, so each line meets only bounds of its block. Every bound is a unit of its own, also if
    another has its title and start; bounds without a unit_type give a null one."""
    typed = bounds if "unit_type" in bounds.columns else bounds.withColumn("unit_type", F.lit(None).cast("string"))
    own = cut(typed.where("end_line > start_line").withColumn("_id", F.monotonically_increasing_id()))
    spans = own.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor((F.col("end_line") - 1) / width))))
    hit = lines.withColumn("_b", F.floor(F.col("n") / width)).join(spans, "_b").where("n >= start_line and n < end_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return hit.groupBy("_id").agg(F.first("title").alias("title"), F.first("unit_type").alias("unit_type"), F.count("*").alias("n_lines"), text.alias("text")).drop("_id")


UNIT = ("unit_id", "page", "title", "n_lines", "speaker", "text", "unit_type")


def detect_units(pages: DataFrame, manual: DataFrame | None = None, lines: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """UNIT columns plus heuristic: units by manual bounds over lines (n, line) if there are any, else by a pattern, else
    by the more plausible of headings and blank lines. Units of bounds and patterns have no speaker; those of bounds no
    page, those of patterns the type unknown."""
    null = lambda kind: F.lit(None).cast(kind)
    if manual is not None and lines is not None and not manual.isEmpty():
        slices = number_rows(manual_slices(lines, manual), ["title", "text"], "unit_id")
        return slices.select("unit_id", null("bigint").alias("page"), "title", "n_lines", null("string").alias("speaker"), "text", "unit_type", F.lit("manual").alias("heuristic"))
    if pattern:
        parts = by_pattern(pages, pattern)
        return parts.select(F.col("unit_id").cast("bigint").alias("unit_id"), "page", "title", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), null("string").alias("speaker"), "text", F.lit("unknown").alias("unit_type"), F.lit("regex").alias("heuristic"))
    ways = {"headings": by_headings(pages), "blank_lines": by_blank_lines(pages)}
    best = best_method(plausibility(ways["headings"], "headings").union(plausibility(ways["blank_lines"], "blank_lines"))).first()["method"]
    return ways[best].select(*UNIT, F.lit(best).alias("heuristic"))
