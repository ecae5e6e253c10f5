"""Problem 9: text cut off by field limits, by length histograms of each source, and by how a text ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.term_counts import count_terms
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, table

#: A length is a spike of its source if n texts have it, where neighbours up to NEAR longer or shorter average m, and
#: n > m + 6 sqrt(m) + 2, and if at least OPEN of these texts end openly or in points.
NEAR, OPEN = 25, 0.6
#: The last line of a verse is short if it has fewer words than all but this share of the other verse lines.
SHORT_SHARE = 0.01

#: All patterns are matched from the start of the reversed text, so that they take time linear in it.
#: What may follow the last mark of a whole text: closing signs, symbols, marks of no width, white space.
_CLOSING = r"""["'”’»)\]}*_\p{So}\p{Sk}\p{Cf}\p{M}\s]*"""
_AFTER = r"(?U)\A" + _CLOSING + r"(?:\)[.!]?\w{1,12}\(" + _CLOSING + ")?"
STOPPED = _AFTER + "[.!?…]"
MARKED = _AFTER + "[.,;:!?…]"
DOTTED = r"(?U)\A" + _CLOSING + r"(?:\.\.|…)"
#: A whole verse may also end in a symbol, a closing sign or a line break.
SIGNED = r"(?U)\A(?:[\s\p{Cf}]*\n|" + _CLOSING + r"[”»)\]}\p{So}])"
BROKEN = r"(?U)\A\s*(?:\x{FFFD}|\w{0,8}#?&|[^<>\n]{0,80}<)"
_NO_WORD = r"\A[^\p{L}\p{M}\p{N}_'-]+"


def text_ends(docs: DataFrame, key: str, text: str, source: str, genre: str, verse: tuple[str, ...]) -> DataFrame:
    """(doc, source, verse, chars, bytes, stopped, marked, dotted, broken, word, line_words) of every text with a word.

    word is the last word in lower case; line_words the words of the last line that isn't blank. A text of unknown genre
    is verse if it has several lines.
    """
    t, back = F.col("t"), F.col("back")
    piece = F.regexp_replace(F.regexp_extract(F.lower(back), r"(?U)\A\s*(\S+)", 1), _NO_WORD, "")
    word = F.regexp_replace(F.reverse(piece), _NO_WORD, "")
    known = docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), F.col(genre).alias("g"), F.col(text).alias("t"), F.reverse(text).alias("back")).where(t.rlike(r"(?U)\S"))
    is_verse = F.coalesce(F.col("g").isin(*verse), F.instr(F.trim(t), "\n") > 0)
    return known.select(
        "doc", "source", is_verse.alias("verse"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), back.rlike(STOPPED).alias("stopped"), (back.rlike(MARKED) | back.rlike(SIGNED)).alias("marked"), back.rlike(DOTTED).alias("dotted"), back.rlike(BROKEN).alias("broken"),
        word.alias("word"), _words_in(F.regexp_extract(back, r"(?U)\A\s*([^\n]*)", 1)).alias("line_words"),
    )


def _words_in(line: Column) -> Column:
    """Words of a line, read in either direction."""
    return F.regexp_count(line, F.lit(r"(?U)[\p{L}\p{N}]\S*"))


def length_spikes(ends: DataFrame) -> DataFrame:
    """(source, kind chars or bytes, length, n, dots, longest): lengths at which a source cuts its texts; dots if it then
    sets points; longest if no text of the source is longer.

    The histogram is a partial aggregate, so a source with a third of all rows is no hot group; its window runs over the
    distinct lengths of a source.
    """
    opened = F.when(F.col("verse"), ~F.col("marked") | F.col("dotted")).otherwise(~F.col("stopped") | F.col("dotted"))
    sized = ends.where("source is not null").select("source", opened.alias("open"), "dotted", F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("kind"), F.col("bytes").alias("length")))).alias("x"))
    bars = sized.groupBy("source", "x.kind", "x.length").agg(F.count("*").alias("n"), F.count_if("open").alias("open"), F.count_if("dotted").alias("dotted"))
    near = W.partitionBy("source", "kind").orderBy("length").rangeBetween(-NEAR, NEAR)
    mean = (F.sum("n").over(near) - F.col("n")) / (2.0 * NEAR)
    longest = F.col("length") == F.max("length").over(W.partitionBy("source", "kind"))
    found = bars.withColumn("mean", mean).withColumn("longest", longest).where((F.col("n") >= 4) & (F.col("n") > F.col("mean") + 6 * F.sqrt("mean") + 2) & (F.col("open") >= OPEN * F.col("n")))
    return found.select("source", "kind", "length", "n", (F.col("dotted") * 2 > F.col("n")).alias("dots"), "longest")


def _short_line(docs: DataFrame, text: str, genre: str, verse: tuple[str, ...]) -> int:
    """The least number of words that more than SHORT_SHARE of verse lines (but last ones) stay under or at."""
    lines = docs.where(F.col(genre).isin(*verse)).select(F.explode(F.slice(F.reverse(F.split(text, "\n")), F.lit(2), F.size(F.split(text, "\n")))).alias("line"))
    bars = {r["w"]: r["n"] for r in lines.select(F.least(_words_in(F.col("line")), F.lit(100)).alias("w")).where("w > 0").groupBy("w").agg(F.count("*").alias("n")).collect()}
    total, below = sum(bars.values()), 0
    for w in sorted(bars):
        below += bars[w]
        if below > SHORT_SHARE * total:
            return w
    return 0


def truncated_texts(docs: DataFrame, key: str, text: str, source: str, genre: str, verse: tuple[str, ...] = ("song", "poetry")) -> DataFrame:
    """(doc, source, reason): the texts that were cut, with the first reason that holds.

    - broken: the text ends in the remains of a character, an entity or a tag;
    - maximum: its length in characters or bytes is a spike at the maximum of its source, and it ends without a mark
      (prose: without a stop mark), or in the points that this source sets at its limit;
    - limit: the same at a spike below the maximum, in a source some of whose texts keep no limit;
    - open: prose ends without a stop mark;
    - word: a verse without an end mark, or a text that ends in points, ends in a word that stands nowhere else inside a
      text, and so is part of one;
    - line: a verse without an end mark ends in a line far shorter than verse lines are.

    Null, empty and blank texts are no case; repeated rows come out each; a null source has no spikes; long texts are
    looked at whole; other columns are ignored; an empty table gives none. How a text ends is worked out once and cut;
    besides, texts are read for the histogram of line lengths and for the counts of last words.
    """
    docs = docs.select(key, text, source, genre)
    ends = cut(text_ends(docs, key, text, source, genre, verse))
    spikes = cut(length_spikes(ends))
    short = _short_line(docs, text, genre, verse)
    total = spikes.agg(F.sum("n")).first()[0] or 0
    for kind in ("chars", "bytes"):
        own = spikes.where(F.col("kind") == kind).select("source", F.col("length").alias(kind), "n", F.col("dots").alias(f"dots_{kind}"), F.col("longest").alias(f"top_{kind}"))
        ends = join_by_size(ends, own, ["source", kind], "n", total, "left").drop("n")
    at_limit = F.col("dots_chars").isNotNull() | F.col("dots_bytes").isNotNull()
    dots_there = F.coalesce("dots_chars", F.lit(False)) | F.coalesce("dots_bytes", F.lit(False))
    at_top = F.coalesce("top_chars", F.lit(False)) | F.coalesce("top_bytes", F.lit(False))
    open_end = F.when(F.col("verse"), ~F.col("marked")).otherwise(~F.col("stopped"))
    sure = F.when(F.col("broken"), "broken").when(at_limit & (open_end | (F.col("dotted") & dots_there)), F.when(at_top, "maximum").otherwise("limit")).when(~F.col("verse") & ~F.col("stopped"), "open")
    sure = sure.when(F.col("verse") & ~F.col("marked") & (F.col("line_words") < short), "line")
    judged = ends.withColumn("reason", sure)
    unsure = F.col("reason").isNull() & (F.col("word") != "") & (F.col("dotted") | (F.col("verse") & ~F.col("marked")))
    asked = judged.groupBy("word").agg(F.count("*").alias("ends"), F.count_if(unsure).alias("n")).where("n > 0")
    known = count_terms(docs, text).select(F.col("term").alias("word"), "occurrences")
    parts = cut(asked.join(known, "word", "left").where("coalesce(occurrences, 0) <= ends").select("word", "n"))
    broken_words = join_by_size(judged.where(unsure).drop("reason"), parts, ["word"], "n", parts.agg(F.sum("n")).first()[0] or 0).select("doc", "source", F.lit("word").alias("reason"))
    return judged.where("reason is not null").select("doc", "source", "reason").union(broken_words)


def truncation_report(cases: DataFrame, docs: DataFrame, text: str, source: str) -> DataFrame:
    """(source, n_texts, n_cut, share): how many of a source's texts that aren't blank were cut."""
    n = docs.where(F.col(text).rlike(r"(?U)\S")).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_texts"))
    c = cases.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n_cut"))
    return n.join(c, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n_texts", F.coalesce("n_cut", F.lit(0)).cast("bigint").alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_texts")).alias("share"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "genre")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select(F.col("doc").alias("doc_id"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(_cases(spark, sf_dir), table(spark, sf_dir, "documents"), "text", "source")
