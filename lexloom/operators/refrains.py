"""Lines that stand within texts: containment as a substring, without comparing every line with every text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut, drop_cut

#: Lines, with what is looked up for them, that are broadcast to the texts; more are joined by a shuffle.
FEW = 100_000


def _grams(pieces: DataFrame, n: int) -> DataFrame:
    """(key, g): runs of n neighbouring pieces of each text."""
    return pieces.where(F.size("p") >= n).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: F.slice("p", i, n))).alias("g"))


def _lengths(words: DataFrame, word: Column) -> Column:
    """The different lengths of a word column, as an array."""
    return F.array(*(F.lit(r[0]) for r in words.select(F.length(word)).distinct().collect())).cast("array<int>")


def shared(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, lo, hi): each distinct line that several texts contain, also within a longer line, within a word, or across
    a line break, with the smallest and the largest key of those. Both sides are normalised: lines (line), texts (key,
    text) with a key for each text.

    The inner words of a line are whole words of a text; its first may end, its last may begin a longer word. Lines of
    up to three words are looked up among the runs of as many words; longer ones come by their rarest run of inner words
    (two of a line of four words, else three) to the texts that hold it, and are verified there. A run of one text only is
    none that several contain, so most lines end at the first one that is looked up.
    """
    t = cut(texts.where("text is not null"))
    ls = cut(lines.where("line is not null").select("line").distinct())
    words = ls.withColumn("w", F.split("line", " ")).withColumn("k", F.size("w"))
    pieces = t.select("key", F.split("text", " ").alias("p"))
    one, two, three, four, more = (words.where(x) for x in ("k = 1", "k = 2", "k = 3", "k = 4", "k > 4"))
    vocab = cut(pieces.select("key", F.explode("p").alias("t")).groupBy("t").agg(F.min("key").alias("lo"), F.max("key").alias("hi")))

    parts = F.flatten(F.transform(_lengths(one, F.col("line")), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring("t", i, n))))
    within = vocab.select(F.explode(F.array_distinct(parts)).alias("line"), "lo", "hi")
    parts = [cut(one.select("line").join(within, "line").select("line", "lo", "hi"))]

    last = _lengths(two.union(three), F.element_at("w", -1))
    begun = vocab.select("t", F.explode(F.array_distinct(F.transform(last, lambda n: F.substring("t", F.lit(1), n)))).alias("end"))
    for n, some in ((2, two), (3, three)):
        ready = some.select("line", "w", F.element_at("w", -1).alias("end")).join(begun, "end").select("line", F.col("w")[0].alias("first"), F.concat(F.slice("w", 2, n - 2), F.array("t")).alias("rest"))
        ready = cut(ready)
        runs = _grams(pieces, n).select("key", F.col("g")[0].alias("own"), F.slice("g", 2, n - 1).alias("rest"))
        ends = cut(some.select(F.right(F.col("w")[0], F.lit(1)).alias("a"), F.slice("w", 2, n - 2).alias("b"), F.left(F.element_at("w", -1), F.lit(1)).alias("c")).distinct())
        if ends.count() <= FEW:
            at = (F.right("own", F.lit(1)) == F.col("a")) & (F.slice("rest", 1, n - 2) == F.col("b")) & (F.left(F.element_at("rest", -1), F.lit(1)) == F.col("c"))
            runs = runs.join(F.broadcast(ends), at, "left_semi")
        parts.append(cut(runs.join(F.broadcast(ready) if ready.count() <= FEW else ready, "rest").where(F.endswith("own", "first")).groupBy("line").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))))
        drop_cut(ready)
        drop_cut(ends)

    def hashed(words: Column, n: int, start: int, stop: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(start), stop), lambda i: F.xxhash64(*(F.get(words, i - 1 + j) for j in range(n)))))

    for n, some in ((2, four), (3, more)):
        held = t.withColumn("p", F.split("text", " ")).where(F.size("p") >= n).select("key", "text", F.explode(hashed(F.col("p"), n, 1, F.size("p") - n + 1)).alias("h"))
        counts = cut(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        own = hashed(F.col("w"), n, 2, F.col("k") - n)
        left = cut(some.select("line", F.xxhash64(*(F.get("w", j + 1) for j in range(n))).alias("h")).join(counts, "h", "left_semi").select("line"))
        each = left.withColumn("w", F.split("line", " ")).withColumn("k", F.size("w")).select("line", F.size(own).alias("m"), F.explode(own).alias("h")).join(counts, "h")
        rarest = cut(each.groupBy("line", "m").agg(F.min(F.struct("n", "h")).alias("x"), F.count("*").alias("c")).where("c = m").select("line", F.col("x.h").alias("h")))
        if rarest.count() <= FEW:
            met = held.join(F.broadcast(rarest), "h")
        else:
            met = held.select("key", "h").join(rarest, "h").select("line", "key").join(t, "key")
        parts.append(cut(met.where(F.contains("text", "line")).groupBy("line").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))))
        for x in (counts, left, rarest):
            drop_cut(x)
    found = reduce(DataFrame.union, parts)
    out = cut(found.groupBy("line").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi"))
    for x in (t, ls, vocab, *parts):
        drop_cut(x)
    return out
