"""Lexicon tables, lookups and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import modern_candidates, old_candidates
from lexloom.operators.numbering import number_rows
from lexloom.session import cut


def clean_word(c: str):
    return F.lower(F.trim(F.col(c)))


def entries(df: DataFrame, word: str, ord_: str, source: str | None = None, form: str | None = None, pos: str | None = None, gloss: str | None = None) -> DataFrame:
    """(headword, source, normalised_form, pos, gloss, ord): rows with a headword. The literal ``nan`` is none."""
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return df.select(clean_word(word).alias("headword"), text(source).alias("source"), (clean_word(form) if form else F.lit(None).cast("string")).alias("normalised_form"), text(pos).alias("pos"), text(gloss).alias("gloss"), F.col(ord_).cast("bigint").alias("ord")).where("headword <> '' and headword <> 'nan'")


def first_entries(lex: DataFrame, order: list[str]) -> DataFrame:
    """The first entry of each headword: one partial aggregate, no window over a frequent headword."""
    rest = [c for c in lex.columns if c != "headword"]
    kept = lex.groupBy("headword").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return kept.select("headword", *(F.col(f"x.{c}").alias(c) for c in rest))


def conflicts(lex: DataFrame) -> DataFrame:
    """(headword, n_sources, n_entries): headwords that several sources have; all entries are kept by a merge."""
    return lex.groupBy("headword").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_entries")).where("n_sources > 1")


def lookup_direct(types: DataFrame, lex: DataFrame) -> DataFrame:
    """(token, n_entries): tokens that are headwords."""
    return types.join(lex.groupBy("headword").agg(F.count("*").alias("n_entries")), types["token"] == F.col("headword")).select("token", "n_entries")


def keys_of(lex: DataFrame) -> DataFrame:
    """(key, kind): headwords (kind 0) and normalised forms (kind 1), each once."""
    heads = lex.select(F.col("headword").alias("key"), F.lit(0).alias("kind"))
    return heads.union(lex.where("normalised_form is not null and normalised_form <> ''").select("normalised_form", F.lit(1))).distinct()


def candidate_rows(types: DataFrame, modern: bool = True, old: bool = True) -> DataFrame:
    """(token, candidate, ord): each candidate once, with its first rule."""
    t = F.col("token")
    lists = ([modern_candidates(t)] if modern else []) + ([old_candidates(t)] if old else [])
    each = types.select("token", F.explode(F.concat(*lists) if len(lists) > 1 else lists[0]).alias("x"))
    return each.groupBy("token", F.col("x.candidate").alias("candidate")).agg(F.min("x.ord").alias("ord"))


def lookup_cascade(types: DataFrame, lex: DataFrame) -> DataFrame:
    """(token, key, priority): for every token type the first key that its candidates meet, headword before normalised
    form, the word itself before modern and these before old spellings; null key where none does."""
    hits = candidate_rows(types).join(keys_of(lex).withColumnRenamed("key", "candidate"), "candidate").select("token", "candidate", (F.col("ord") * 2 + F.col("kind")).alias("priority"))
    best = hits.groupBy("token").agg(F.min(F.struct("priority", "candidate")).alias("x"))
    return types.join(best, "token", "left").select("token", F.col("x.candidate").alias("key"), F.col("x.priority").alias("priority"))


def coverage_change(types: DataFrame, lex: DataFrame) -> DataFrame:
    """One row: types covered before (headwords) and after (any modern candidate a headword) normalising."""
    heads = lex.select(F.col("headword").alias("candidate")).distinct()
    hit = candidate_rows(types, old=False).join(heads, "candidate").groupBy("token").agg(F.min("ord").alias("o"))
    a = types.join(hit, "token", "left").agg(F.count("*").alias("n_types"), F.count_if(F.expr("o = 0")).alias("before"), F.count_if(F.expr("o is not null")).alias("after"))
    n = F.greatest("n_types", F.lit(1))
    return a.select("n_types", "before", "after", F.round(100.0 * F.col("before") / n, 6).alias("before_pct"), F.round(100.0 * F.col("after") / n, 6).alias("after_pct"), (F.col("after") - F.col("before")).alias("gain"))


def condition_coverage(types: DataFrame, lex: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(condition, n_types, direct, variant, oov, direct_pct, total_pct): types covered under each condition, a predicate on
    the entries; ``none`` (no lexicon) comes first. Candidates meet the keys once, whatever the number of conditions."""
    rows = lex.select("*", *(c.cast("int").alias(f"_c{i}") for i, c in enumerate(conditions.values())))
    flags = [F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(conditions))]
    keyed = rows.select(F.col("headword").alias("candidate"), F.lit(0).alias("kind"), *(f"_c{i}" for i in range(len(conditions))))
    forms = rows.where("normalised_form <> ''").select("normalised_form", F.lit(1), *(f"_c{i}" for i in range(len(conditions))))
    keys = keyed.union(forms).groupBy("candidate", "kind").agg(*flags)
    hits = candidate_rows(types).join(keys, "candidate").withColumn("p", F.col("ord") * 2 + F.col("kind"))
    best = hits.groupBy("token").agg(*(F.min(F.when(F.col(f"_c{i}") == 1, F.col("p"))).alias(f"_p{i}") for i in range(len(conditions))))
    counts = [F.count("*").alias("n")] + [f(i) for i in range(len(conditions)) for f in (lambda i: F.count_if(F.col(f"_p{i}") == 0).alias(f"_d{i}"), lambda i: F.count(f"_p{i}").alias(f"_t{i}"))]
    a = types.join(best, "token", "left").agg(*counts)
    zero = F.lit(0).cast("bigint")
    told = [F.struct(F.lit("none").alias("condition"), zero.alias("d"), zero.alias("t")), *(F.struct(F.lit(c).alias("condition"), F.col(f"_d{i}").alias("d"), F.col(f"_t{i}").alias("t")) for i, c in enumerate(conditions))]
    n, d, t = F.col("n"), F.col("x.d"), F.col("x.t")
    pct = lambda c: F.round(100.0 * c / F.greatest(n, F.lit(1)), 6)
    return a.select("n", F.explode(F.array(*told)).alias("x")).select("x.condition", n.alias("n_types"), d.alias("direct"), (t - d).alias("variant"), (n - t).alias("oov"), pct(d).alias("direct_pct"), pct(t).alias("total_pct"))


def masked_coverage(types: DataFrame, lex: DataFrame, fractions: tuple[float, ...], seeds: tuple[int, ...]) -> DataFrame:
    """(fraction, seed, n_left, direct, total, direct_pct, total_pct): coverage where the first floor(n * fraction) of the n
    headwords, in the order of md5 of seed and headword, are masked with all their entries; first nothing (seed 0).

    Headwords are numbered over range partitions. Candidates meet the keys once: a type is covered as long as one
    headword behind its keys is left, so its last headword decides for every fraction at once.
    """
    heads = cut(lex.select("headword").distinct())
    n = heads.count()
    seeded = heads.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), "headword")))
    rank = cut(number_rows(seeded, ["seed", "_h", "headword"], "_i").select("headword", "seed", (F.pmod(F.col("_i"), F.lit(max(n, 1))) + 1).alias("r")))
    keys = lex.select(F.col("headword").alias("candidate"), "headword").union(lex.where("normalised_form <> ''").select("normalised_form", "headword")).distinct()
    hits = candidate_rows(types).join(keys, "candidate").select("token", "headword", (F.col("token") == F.col("headword")).alias("own")).groupBy("token", "headword").agg(F.max("own").alias("own"))
    last = cut(hits.join(rank, "headword").groupBy("token", "seed").agg(F.max(F.when(F.col("own"), F.col("r"))).alias("direct"), F.max("r").alias("any")))
    n_types, masked = types.count(), {f: math.floor(n * f) for f in fractions}
    cells = [F.struct(F.lit(f).alias("fraction"), F.lit(n - k).cast("bigint").alias("n_left"), F.count_if(F.col("direct") > k).alias("direct"), F.count_if(F.col("any") > k).alias("total")) for f, k in masked.items()]
    each = last.groupBy("seed").agg(F.array(*cells).alias("x")).select(F.col("seed").cast("int").alias("seed"), F.explode("x").alias("x"))
    whole = last.where(F.col("seed") == seeds[0]).agg(F.count("direct").alias("direct"), F.count("any").alias("total")).select(F.lit(0).alias("seed"), F.struct(F.lit(0.0).alias("fraction"), F.lit(n).cast("bigint").alias("n_left"), "direct", "total").alias("x"))
    pct = lambda c: F.round(100.0 * F.col(c) / max(n_types, 1), 6)
    return whole.union(each).select("x.fraction", "seed", "x.n_left", "x.direct", "x.total", pct("x.direct").alias("direct_pct"), pct("x.total").alias("total_pct"))


def token_pos(types: DataFrame, lex: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(token, pos_<tag> ...): 1 where an entry of the token's first key has that tag, as written; tags is a bounded list."""
    found = lookup_cascade(types, lex)
    told = lex.select(F.col("headword").alias("k"), F.lit(0).alias("kind"), "pos").union(lex.where("normalised_form <> ''").select("normalised_form", F.lit(1), "pos"))
    by_key = told.groupBy("k", "kind").agg(*(F.max((F.col("pos") == t).cast("int")).alias(f"pos_{t}") for t in tags))
    j = found.join(by_key, (F.col("key") == F.col("k")) & (F.col("priority") % 2 == F.col("kind")), "left")
    return j.select("token", *(F.coalesce(f"pos_{t}", F.lit(0)).alias(f"pos_{t}") for t in tags))


def coverage_total(types: DataFrame, lex: DataFrame) -> DataFrame:
    """One row: types covered directly, by the full cascade, and not at all."""
    found = lookup_cascade(types, lex)
    a = found.agg(F.count("*").alias("n_types"), F.count_if(F.expr("priority = 0")).alias("direct"), F.count_if(F.expr("priority > 0")).alias("variant"), F.count_if(F.expr("priority is null")).alias("oov"))
    return a.withColumn("total_pct", F.round(100.0 * (F.col("direct") + F.col("variant")) / F.greatest("n_types", F.lit(1)), 6))


def token_features(types: DataFrame, lex: DataFrame) -> DataFrame:
    """(token, in_lexicon, in_lexicon_variant, has_pos, has_gloss, n_pos): what the entries of the first key say."""
    found = lookup_cascade(types, lex)
    told = lex.select(F.col("headword").alias("k"), F.lit(0).alias("kind"), "pos", "gloss").union(lex.where("normalised_form <> ''").select("normalised_form", F.lit(1), "pos", "gloss"))
    by_key = told.groupBy("k", "kind").agg(F.count("pos").alias("np"), F.count("gloss").alias("ng"), F.count_distinct("pos").alias("n_pos"))
    j = found.join(by_key, (F.col("key") == F.col("k")) & (F.col("priority") % 2 == F.col("kind")), "left")
    one = lambda c: F.when(c, 1).otherwise(0)
    return j.select("token", one(F.col("priority") == 0).alias("in_lexicon"), one(F.col("priority") > 0).alias("in_lexicon_variant"), one(F.col("np") > 0).alias("has_pos"), one(F.col("ng") > 0).alias("has_gloss"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"))


def number_ranges(df: DataFrame, n: str) -> DataFrame:
    """(low, high, label): runs of successive numbers, as ``a`` or ``a-b``. For number lists of the size of a word list."""
    runs = df.select(F.col(n).cast("bigint").alias("n")).where("n is not null").distinct().withColumn("run", F.col("n") - F.row_number().over(W.orderBy("n")))
    found = runs.groupBy("run").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return found.select("low", "high", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string"))).alias("label"))
