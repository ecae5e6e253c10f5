"""What may explain a wrong guess of a line: tags, tokens that no lexicon has, tokens found by a variant only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import bare, modern_candidates, split_tokens
from lexloom.operators.features import TAG_LOANWORDS
from lexloom.operators.lexicon import lookup_cascade
from lexloom.session import cut, drop_cut

#: Words up to which what is told of them is broadcast; more are joined by a shuffle.
FEW = 200_000


def told_types(types: DataFrame, lex: DataFrame) -> DataFrame:
    """(token, oov, mapped, varied): whether no lookup finds a type, only a variant of it does, and it has another spelling."""
    p = F.col("priority")
    return lookup_cascade(types, lex).select("token", p.isNull().cast("int").alias("oov"), F.coalesce((p > 0).cast("int"), F.lit(0)).alias("mapped"), (F.size(modern_candidates(F.col("token"))) > 1).cast("int").alias("varied"))


def words_of(lines: DataFrame) -> DataFrame:
    """(word, token), cut: the distinct words of lines (norm) between spaces, and what is left of each without outer punctuation."""
    return cut(lines.select(F.explode(F.split("norm", " ")).alias("word")).distinct().select("word", bare(F.col("word")).alias("token")))


def tagged_lines(lines: DataFrame, told: DataFrame, shared: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """lines (key, norm, ts, ...) plus oov_tokens and variant_mapped_tokens, in the order of the line and joined by ``;``,
    and tags. told is of told_types; shared (line) holds the lines that several songs contain; words is words_of(lines),
    where lines are cut already. ts are the tokens of norm, which are made anew from it.

    Types are looked up once, and their words are joined back: broadcast where there are FEW, so that lines are counted in
    place. Lines are cut without ts, and words with what is told of them, since the driver keeps every version of
    a plan while it runs, and one plan of all parts took more memory there than the data. Tags, joined by commas: short_phrase (at most 3 tokens), high_oov (more than
    half of the tokens), spelling_variant, shared_refrain, loanword_heavy (more than 0.3 of the tokens); else unknown.
    """
    own = lines.drop("ts")
    if words is None:
        own = cut(own)
        words = words_of(own)
    by_word = cut(words.where("token <> ''").join(told, "token"))
    few = by_word.count() <= FEW
    drop_cut(words)
    each = own.select("key", F.posexplode(F.split("norm", " ")).alias("i", "word")).join(F.broadcast(by_word) if few else by_word, "word")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "token")))), lambda x: x["token"]), ";")
    loan = F.sum(F.col("token").isin(*TAG_LOANWORDS).cast("int"))
    ag = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("oov").alias("oov"), F.sum("varied").alias("nv"), loan.alias("loan"), joined(F.col("oov") == 1).alias("oov_tokens"), joined(F.col("mapped") == 1).alias("variant_mapped_tokens"))
    j = own.join(shared.select(F.col("line").alias("norm"), F.lit(1).alias("shared")), "norm", "left").join(ag, "key", "left").withColumn("ts", split_tokens(F.col("norm")))
    tags = F.concat_ws(",", F.when(F.coalesce("n", F.lit(0)) <= 3, "short_phrase"), F.when(F.col("oov") > 0.5 * F.col("n"), "high_oov"), F.when(F.col("nv") > 0, "spelling_variant"), F.when(F.col("shared") == 1, "shared_refrain"), F.when(F.col("loan") > 0.3 * F.col("n"), "loanword_heavy"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return j.select(*lines.columns, empty("oov_tokens"), empty("variant_mapped_tokens"), F.coalesce(F.nullif(tags, F.lit("")), F.lit("unknown")).alias("tags"))


def exported(wrong: DataFrame, system: str, condition: str) -> DataFrame:
    """key and the eleven columns of an error export, from tagged lines with line, y, yhat and score."""
    return wrong.select("key", F.col("line").alias("phrase_raw"), F.col("norm").alias("phrase_normalised"), F.col("y").alias("true"), F.col("yhat").alias("predicted"), "score", F.lit(system).alias("system"), F.lit(condition).alias("lexicon_condition"), F.size("ts").alias("phrase_length"), "oov_tokens", "variant_mapped_tokens", F.col("tags").alias("reason_tag"))
