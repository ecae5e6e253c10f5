"""Text, lexicon, loan-word and TF-IDF features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.lexicon import lookup_cascade

#: Loan-word seeds of the configuration, and the short list of the error tags.
LOANWORDS = ("gloria", "aleluya", "espiritu", "domini", "santo", "cristo", "bendito", "amen", "hosanna", "sacramento", "cordero", "creda", "evangelio", "sermon", "gracia", "apostolica", "ceremonia", "patri", "nunc", "dimittis", "agnus", "dei", "pax", "introita", "kyrie", "excelsis", "pentecostes", "trinidad", "prefacio", "numero")
TAG_LOANWORDS = ("gloria", "aleluya", "espiritu", "santo", "cristo", "amen", "hosanna", "bendito", "sacramento", "cordero")


def text_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Counts and lengths of each text; averages are 0 where there is no token or line."""
    t, toks = F.col(text), F.col("_t")
    filled = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n, chars = F.size(toks), F.aggregate(toks, F.lit(0), lambda a, x: a + F.length(x))
    d = docs.select(key, text, tokens(t).alias("_t"))
    per = lambda a, b: F.round(F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0), 6)
    return d.select(key, n.alias("num_tokens"), F.length(t).alias("num_chars"), per(chars, n).alias("avg_token_length"), F.size(F.array_distinct(toks)).alias("num_unique_tokens"), per(F.size(F.array_distinct(toks)), n).alias("type_token_ratio"), F.size(filled).alias("num_lines"), per(F.aggregate(filled, F.lit(0), lambda a, x: a + F.length(x)), F.size(filled)).alias("avg_line_length"))


def loanword_features(docs: DataFrame, key: str, text: str, seeds: tuple[str, ...] = LOANWORDS) -> DataFrame:
    hits = F.size(F.filter(F.col("_t"), lambda x: x.isin(*seeds)))
    return docs.select(key, tokens(F.col(text)).alias("_t")).select(key, hits.alias("loanwords"), F.round(hits / F.greatest(F.size("_t"), F.lit(1)), 6).alias("loanword_ratio"))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n)."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def lexicon_features(docs: DataFrame, key: str, text: str, lex: DataFrame) -> DataFrame:
    """Coverage of the token occurrences of each text by the full cascade; five zeros for a text without tokens.

    The cascade runs once for each token type and is joined back; pos and gloss are those of the first key's entries.
    """
    counts = token_counts(docs, key, text)
    found = lookup_cascade(counts.select("token").distinct(), lex).where("priority is not null").select("token", "priority", "key")
    told = lex.select(F.col("headword").alias("k"), F.lit(0).alias("kind"), "pos", "gloss").union(lex.where("normalised_form <> ''").select("normalised_form", F.lit(1), "pos", "gloss"))
    by_key = told.groupBy("k", "kind").agg(F.count("gloss").alias("glosses"), F.collect_set("pos").alias("pos"))
    hit = found.join(by_key, (F.col("key") == F.col("k")) & (F.col("priority") % 2 == F.col("kind"))).select("token", "priority", "glosses", "pos")
    j = counts.join(hit, "token", "left")
    a = j.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("priority").isNotNull(), F.col("n")).otherwise(0)).alias("found"), F.sum(F.when(F.col("priority") > 0, F.col("n")).otherwise(0)).alias("variant"), F.sum(F.coalesce(F.col("n") * F.col("glosses"), F.lit(0))).alias("glosses"), F.size(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("pos"))
    n = F.col("n")
    whole = docs.select(key).join(a, key, "left")
    ratio = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return whole.select(key, ratio(F.col("found") / n).alias("coverage"), ratio(1 - F.col("found") / n).alias("oov"), ratio(F.col("variant") / n).alias("variant"), ratio(F.col("pos") / n).alias("pos_diversity"), ratio(F.col("glosses") / F.greatest("found", F.lit(1))).alias("gloss_ratio"))


def word_ngrams(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores of the lower-cased text, and pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def word_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words and word pairs."""
    return docs.select(key, F.explode(word_ngrams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _char_grams(low: int, high: int) -> Column:
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    return F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.length(padded), F.lit(high))), lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))))


def char_terms(docs: DataFrame, key: str, text: str, low: int = 2, high: int = 5) -> DataFrame:
    """(key, term, tf) of character n-grams within words, each word padded by a space at both ends.

    n-grams are cut once for each distinct word and weighted by its count.
    """
    from lexloom.functions.text import normalise

    words = docs.select(key, F.explode(F.split(normalise(F.col(text)), " ")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))
    of_word = words.select("word").distinct().select("word", F.explode(_char_grams(low, high)).alias("term")).groupBy("word", "term").agg(F.count("*").alias("c"))
    return words.join(of_word, "word").groupBy(key, "term").agg(F.sum(F.col("n") * F.col("c")).alias("tf"))


def vocabulary(terms: DataFrame, n_docs: int, limit: int) -> DataFrame:
    """(term, idf): the terms of most occurrences, ties by name, with smooth idf."""
    top = terms.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "term").limit(limit)
    return top.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(terms: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, term, weight): sublinear tf times idf, each text's vector of length 1. vocab (a bounded list) is broadcast."""
    raw = terms.join(F.broadcast(vocab), "term").select(key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def char_tfidf(docs: DataFrame, key: str, text: str, limit: int, low: int = 2, high: int = 5) -> DataFrame:
    """(key, term, weight): tfidf of char_terms with their vocabulary of at most limit terms; only counts are shuffled.

    Which terms are the most frequent is told by the counts of distinct words. Then whole Arrow batches of texts are read
    twice: for the texts that hold each of these terms, and for the weights of each text. No row a text and term is moved.
    """
    from lexloom.functions.text import normalise

    pieces = docs.select(key, F.split(normalise(F.col(text)), " ").alias("_w"))
    words = pieces.select(F.explode("_w").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    top = words.select("n", F.explode(_char_grams(low, high)).alias("term")).groupBy("term").agg(F.sum("n").alias("tf")).orderBy(F.desc("tf"), "term").limit(limit)
    terms = [r["term"] for r in top.select("term").collect()]
    at = {t: i for i, t in enumerate(terms)}

    def places() -> dict[str, list[int]]:
        """Of each word the places of its terms, with repetition; kept while there is room."""

        class Kept(dict):
            def __missing__(self, word: str) -> list[int]:
                p = f" {word} " if word else ""
                found = [at[g] for n in range(low, high + 1) for i in range(len(p) - n + 1) if (g := p[i : i + n]) in at]
                if len(self) > 200_000:
                    self.clear()
                self[word] = found
                return found

        return Kept()

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, df = places(), Counter()
        for b in batches:
            for ws in b.column(0).to_pylist():
                df.update(set().union(*(of[w] for w in set(ws or ()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int32()), pa.array(list(df.values()), pa.int64())], ["i", "df"])

    df = np.zeros(len(terms))
    for r in pieces.select("_w").mapInArrow(holding, "i int, df bigint").groupBy("i").agg(F.sum("df").alias("df")).collect():
        df[r["i"]] = r["df"]
    idf = np.log((1.0 + docs.count()) / (1.0 + df)) + 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names = places(), pa.array(terms, pa.string())
        for b in batches:
            found, tf, size = [], [], []
            for ws in b.column(1).to_pylist():
                own: dict[int, int] = {}
                for w in ws or ():
                    for i in of[w]:
                        own[i] = own.get(i, 0) + 1
                found.extend(own)
                tf.extend(own.values())
                size.append(len(own))
            if not found:
                continue
            row, i = np.repeat(np.arange(len(size)), size), np.array(found, np.int64)
            w = (1.0 + np.log(np.array(tf, np.float64))) * idf[i]
            norm = np.sqrt(np.bincount(row, w * w, len(size)))
            for s in range(0, len(i), 100_000):
                e = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[e])), names.take(pa.array(i[e])), pa.array(w[e] / norm[row[e]])], [key, "term", "weight"])

    return pieces.mapInArrow(weigh, f"{key} {docs.schema[key].dataType.simpleString()}, term string, weight double")


def max_abs_scaled(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column over its largest absolute value (1 where that is 0)."""
    top = df.agg(*(F.max(F.abs(c)).alias(f"_m{i}") for i, c in enumerate(columns))).first()
    return df.select(key, *(F.round(F.col(c) / F.lit(float(top[i] or 1.0)), 6).alias(c) for i, c in enumerate(columns)))
