"""Ranking of texts for phrases: BM25, cosine of TF-IDF vectors, and their sum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import normalise, split_tokens
from lexloom.operators.features import char_terms, tfidf, token_counts, vocabulary, word_terms
from lexloom.operators.skew import join_by_size
from lexloom.session import cut

K1, B = 1.5, 0.75


class Index:
    """The postings of a collection, cut once and read by every method: docs (doc, text).

    bm25_postings: (doc, token, n, dl); words and chars: (doc, term, weight) with their vocabularies (term, idf). Each is
    made when it is first asked for. At most 5000 word and 10000 character terms are kept, the most frequent, as the
    vectorisers have it.
    """

    LIMITS = {"word": (word_terms, 5000), "char": (char_terms, 10000)}

    def __init__(self, docs: DataFrame) -> None:
        self.docs = cut(docs.select("doc", normalise(F.col("text")).alias("text")))
        self.n = self.docs.count()
        self._kept: dict = {}

    def postings(self) -> DataFrame:
        if "bm25" not in self._kept:
            p = cut(self.docs.select("doc", F.explode(split_tokens(F.col("text"))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n")))
            self._kept["bm25"] = cut(p.join(p.groupBy("doc").agg(F.sum("n").alias("dl")), "doc"))
            total = p.agg(F.sum("n")).first()[0] or 0
            self.average = total / max(self.n, 1) or 1.0
            df = self._kept["bm25"].groupBy("token").agg(F.count("*").alias("df"), F.max(self.part()).alias("top"))
            self._kept["idf"] = cut(df.select("token", "df", "top", F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf")))
        return self._kept["bm25"]

    def part(self) -> Column:
        """What a posting adds to a score, but for the token's idf."""
        return F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("dl") / self.average))

    def idf(self) -> DataFrame:
        """(token, df, top, idf): top is the largest part of the token's postings."""
        self.postings()
        return self._kept["idf"]

    def vectors(self, kind: str) -> tuple[DataFrame, DataFrame]:
        if kind not in self._kept:
            terms, limit = self.LIMITS[kind]
            tf = cut(terms(self.docs, "doc", "text"))
            vocab = cut(vocabulary(tf, self.n, limit))
            self._kept[kind] = (cut(tfidf(tf, "doc", vocab)), vocab)
        return self._kept[kind]


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """queries (q, text) -> (q, doc, score): the sum over the phrase's token occurrences. Only pairs that share a token
    come up. Postings of tokens that nothing asks for are dropped by the join; those of a very frequent token are spread
    over salts with the phrases that ask for it, and sums for a pair are made before they are shuffled."""
    asked = cut(token_counts(queries, "q", "text").withColumnRenamed("n", "times").join(index.idf(), "token"))
    return _scored(index, asked)


def _scored(index: Index, asked: DataFrame) -> DataFrame:
    """asked (q, token, times, df, idf), cut -> (q, doc, score) over these tokens."""
    total = index.idf().agg(F.sum("df")).first()[0] or 0
    met = join_by_size(index.postings().select("doc", "token", index.part().alias("part")), asked.select("q", "token", "times", "df", "idf"), ["token"], "df", total)
    return met.groupBy("q", "doc").agg(F.sum(F.col("times") * F.col("idf") * F.col("part")).alias("score"))


#: Postings that phrases may meet before a search by bounds is the faster one. (At 40 million it takes six times as long.)
DIRECT = 1_000_000_000
#: Tokens of a phrase, those that may add most, whose scores give the first bound of its k best texts.
SEEDS = 3


def bm25_best(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(q, doc, score) as of bm25, but only of texts that may be among the k best of a phrase. Exact for the k best.

    The best texts by the few tokens that may add most are scored in full; the k-th of these scores is a lower bound of
    the k-th best score. Tokens whose largest possible additions together stay below that bound (the very frequent ones)
    bring no text up: their postings are only looked up for texts that another token brings up and that may still pass
    the bound.
    """
    asked = token_counts(queries, "q", "text").withColumnRenamed("n", "times").join(index.idf(), "token").withColumn("most", F.col("times") * F.col("idf") * F.col("top"))
    down, up = W.partitionBy("q").orderBy(F.desc("most"), "token"), W.partitionBy("q").orderBy("most", "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = cut(asked.withColumn("place", F.row_number().over(down)).withColumn("below", F.sum("most").over(up)))
    parts = index.postings().select("doc", "token", index.part().alias("part"))
    seeds = _scored(index, ranked.where(F.col("place") <= SEEDS))
    place = lambda name: F.row_number().over(W.partitionBy("q").orderBy(F.desc(name), "doc"))
    first = seeds.withColumn("r", place("score")).where(F.col("r") <= 2 * k).select("q", "doc")
    full = first.join(ranked.select("q", "token", (F.col("times") * F.col("idf")).alias("w")), "q").join(parts, ["doc", "token"]).groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    best = full.withColumn("r", place("score")).where(F.col("r") <= k)
    bound = best.groupBy("q").agg(F.count("*").alias("c"), (F.min("score") - 1e-5).alias("bound")).where(F.col("c") == k).select("q", "bound")
    split = cut(ranked.join(bound, "q", "left").withColumn("idle", F.coalesce(F.col("below") < F.col("bound"), F.lit(False))))
    idle = split.where("idle").groupBy("q").agg(F.collect_list(F.struct("token", (F.col("times") * F.col("idf")).alias("w"))).alias("left"), F.sum("most").alias("most"), F.first("bound").alias("bound"))
    brought = _scored(index, split.where("not idle")).join(idle, "q", "left").where("bound is null or score + most >= bound")
    brought = cut(brought.select("q", "doc", "score", "left"))
    more = brought.where("left is not null").select("q", "doc", F.explode("left").alias("x")).select("q", "doc", "x.token", "x.w")
    added = more.join(parts, ["doc", "token"]).groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("part")).alias("more"))
    return brought.join(added, ["q", "doc"], "left").select("q", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def cosine(index: Index, queries: DataFrame, kind: str) -> DataFrame:
    """(q, doc, score): cosine of word (1-2) or character (2-5) n-gram vectors of the normalised texts."""
    weights, vocab = index.vectors(kind)
    terms, _ = index.LIMITS[kind]
    q = tfidf(terms(queries.select("q", normalise(F.col("text")).alias("text")), "q", "text"), "q", vocab)
    return q.withColumnRenamed("weight", "wq").join(weights, "term").groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """vectors (id, v array<float>), queries (q, v) -> (q, rank, id, score): the k nearest other vectors by cosine, ties by
    id; exact. Queries go to the workers in blocks of a bounded number; every task keeps k a query, so at most k rows a
    query and task are shuffled. Null and zero vectors, and those of another length, have no cosine and don't come up."""
    held = queries.where("v is not null").select("q", "v").withColumn("_b", F.floor(F.monotonically_increasing_id() % (1 << 33) / block) * (1 << 20) + F.spark_partition_id())
    held = cut(held)
    out = None
    for b in [r["_b"] for r in held.select("_b").distinct().collect()]:
        rows = [r for r in held.where(F.col("_b") == b).collect() if any(r["v"]) and not any(x is None for x in r["v"])]
        for size in sorted({len(r["v"]) for r in rows}):
            own = [r for r in rows if len(r["v"]) == size]
            m = np.array([r["v"] for r in own], np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in own], np.int64), m))

            def near(batches: Iterator[pa.RecordBatch], shared=shared, size: int = size) -> Iterator[pa.RecordBatch]:
                qs, m = shared.value
                for batch in batches:
                    kept = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == size and None not in v and any(v)]
                    if not kept:
                        continue
                    ids, x = np.array([i for i, _ in kept], np.int64), np.array([v for _, v in kept], np.float64)
                    s = np.round(m @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                    s[qs[:, None] == ids[None, :]] = -np.inf
                    best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    r, score = np.repeat(np.arange(len(qs)), best.shape[1]), np.take_along_axis(s, best, 1).ravel()
                    ok = np.isfinite(score)
                    yield pa.RecordBatch.from_arrays([pa.array(qs[r[ok]]), pa.array(ids[best.ravel()[ok]]), pa.array(score[ok])], ["q", "id", "score"])

            found = vectors.select(F.col("id").cast("bigint"), "v").mapInArrow(near, "q bigint, id bigint, score double")
            out = found if out is None else out.union(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "q bigint, rank int, id bigint, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def combined(index: Index, queries: DataFrame) -> DataFrame:
    """(q, doc, score): both cosines plus BM25 over its best score for the phrase."""
    m = cut(bm25(index, queries))
    best = m.groupBy("q").agg(F.max("score").alias("best"))
    scaled = m.join(best, "q").select("q", "doc", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score")).alias("score"))
    return cosine(index, queries, "char").union(cosine(index, queries, "word")).union(scaled).groupBy("q", "doc").agg(F.sum("score").alias("score"))


METHODS = {"bm25": bm25, "word_tfidf": lambda i, q: cosine(i, q, "word"), "char_tfidf": lambda i, q: cosine(i, q, "char"), "combined": combined}


def search(index: Index, queries: DataFrame, k: int, method: str = "combined") -> DataFrame:
    """(q, rank, doc, score) by a method of METHODS; any other gives the first k texts at score 0. BM25 scores every pair
    of a phrase and a text that share a token while these meet in at most DIRECT postings, and searches by bounds beyond
    that; both are exact."""
    if method == "bm25":
        met = token_counts(queries, "q", "text").join(index.idf(), "token").agg(F.sum("df")).first()[0] or 0
        scores = bm25(index, queries) if met <= DIRECT else bm25_best(index, queries, k)
    elif method in METHODS:
        scores = METHODS[method](index, queries)
    else:
        scores = queries.select("q").join(index.docs.select("doc").limit(0), F.lit(False)).select("q", "doc", F.lit(0.0).alias("score"))
    return top_k(scores, index.docs, queries, k)


#: Postings of one block of texts, and how many pairs of a block of texts and a block of phrases there are at least.
CHUNK, PAIRED = 8_000_000, 24


def own_ranks(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries (q, text, doc) -> (q, doc, rank): where the phrase's own text stands among its k best by BM25, the rows that
    search() would have for it; other ranks are left out. Exact, and no ranking is made.

    The score of the own text bounds what has to be looked at: a token brings texts up only if it and those that may add
    less can reach that score together; of the others, only postings of texts that still may are looked up. Blocks of
    phrases meet blocks of texts, and only a count of better texts for each phrase comes back. As in top_k scores are
    rounded to 6 digits, ties go by doc, and the first k texts stand at score 0 if nothing else.
    """
    told = cut(index.idf().withColumn("tid", F.monotonically_increasing_id()))
    first = [r["doc"] for r in index.docs.select("doc").orderBy("doc").limit(k).collect()]
    held = index.postings().join(told.select("token", "tid"), "token").groupBy("doc").agg(F.first("dl").alias("dl"), F.collect_list("tid").alias("tids"), F.collect_list(F.col("n").cast("int")).alias("ns"))
    held = cut(held)
    asked = token_counts(queries, "q", "text").join(told, "token").select("q", F.struct((-F.col("n") * F.col("idf") * F.col("top")).alias("less"), "tid", (F.col("n") * F.col("idf")).alias("w")).alias("x"))
    phrases = asked.groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x")).select("q", F.col("x.tid").alias("asks"), F.col("x.w").alias("ws"), F.transform("x.less", lambda m: -m).alias("mosts"))
    n = lambda c: c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("dl") / index.average))
    has = F.map_from_arrays("tids", "ns")
    sure = F.aggregate(F.zip_with("asks", "ws", lambda t, w: F.coalesce(w * n(F.try_element_at(has, t)), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    scored = queries.select("q", "doc").join(phrases, "q", "left").join(held, "doc", "left").select("q", "doc", "asks", "ws", "mosts", sure.alias("s"), F.arrays_overlap("asks", "tids").alias("met"))
    met = F.coalesce("met", F.lit(False))
    wanted = cut(scored.where(met | F.col("doc").isin(first)).select("q", "doc", *(F.coalesce(c, F.array().cast("array<double>" if c != "asks" else "array<bigint>")).alias(c) for c in ("asks", "ws", "mosts")), F.when(met, F.floor(F.col("s") * 1e6 + 0.5)).otherwise(0).cast("bigint").alias("own")))
    total = held.agg(F.sum(F.size("tids"))).first()[0] or 0
    chunks = max(math.ceil(total / CHUNK), 1)
    blocks = max(PAIRED // chunks, 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = wanted.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("_b"), every(chunks).alias("_c"), "q", "doc", "asks", "ws", "mosts", "own")
    right = held.select(every(blocks).alias("_b"), F.pmod(F.xxhash64("doc"), F.lit(chunks)).cast("int").alias("_c"), "doc", "dl", "tids", "ns")
    average = index.average

    def count(phrases: pa.Table, texts: pa.Table) -> pa.Table:
        return _better(phrases, texts, average, first)

    kind = wanted.schema["q"].dataType.simpleString()
    better = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(count, f"q {kind}, better bigint")
    ranks = better.groupBy("q").agg((F.sum("better") + 1).cast("int").alias("rank")).where(F.col("rank") <= k)
    return wanted.select("q", "doc").join(ranks, "q").select("q", "doc", "rank")


def _better(phrases: pa.Table, texts: pa.Table, average: float, first: list) -> pa.Table:
    """(q, better): how many of these texts stand before each phrase's own one."""
    phrases, texts = phrases.combine_chunks(), texts.combine_chunks()
    flat = lambda t, c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t[c].chunks] or [np.array([])])
    sizes = lambda t, c: np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in t[c].chunks] or [np.array([], np.int64)]).astype(np.int64)
    doc, out = texts["doc"].to_numpy(), np.zeros(phrases.num_rows, np.int64)
    names = np.argsort(doc, kind="stable")
    doc = doc[names]
    place = np.empty(len(doc), np.int64)
    place[names] = np.arange(len(doc))
    of = np.repeat(place, sizes(texts, "tids"))
    n, dl = flat(texts, "ns").astype(np.float64), texts["dl"].to_numpy()[names]
    part = n * (K1 + 1) / (n + K1 * (1 - B + B * dl[of] / average))
    tids = flat(texts, "tids").astype(np.int64)
    order = np.lexsort((of, tids))
    tids, of, part = tids[order], of[order], part[order]
    keys, starts = np.unique(tids, return_index=True)
    starts = np.append(starts, len(tids)).astype(np.int64)
    filler = np.nonzero(np.isin(doc, np.array(first)))[0] if first else np.zeros(0, np.int64)

    asks, ws, mosts = flat(phrases, "asks").astype(np.int64), flat(phrases, "ws"), flat(phrases, "mosts")
    at = np.searchsorted(keys, asks)
    known = at < len(keys)
    known[known] = keys[at[known]] == asks[known]
    low = np.where(known, starts[np.minimum(at, len(keys))], 0).tolist()
    high = np.where(known, starts[np.minimum(at + 1, len(keys))], 0).tolist()
    ends = np.cumsum(sizes(phrases, "asks")).tolist()
    own, truth = phrases["own"].to_pylist(), np.searchsorted(doc, phrases["doc"].to_numpy())
    weight, most = ws.tolist(), mosts.tolist()
    acc, begin = np.zeros(len(doc)), 0
    for i, end in enumerate(ends):
        bound = (own[i] - 0.5) / 1e6 - 1e-7
        rest, stop = 0.0, end
        while stop > begin and rest + most[stop - 1] < bound:
            stop -= 1
            rest += most[stop]
        lists = []
        for j in range(begin, stop):
            d = of[low[j] : high[j]]
            acc[d] += weight[j] * part[low[j] : high[j]]
            lists.append(d)
        touched = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        a = acc[touched]
        kept = touched[a + rest >= bound]
        if own[i] <= 0:
            kept = np.concatenate((kept, filler))
        kept = np.unique(kept)
        score = acc[kept]
        acc[touched] = 0.0
        for j in range(stop, end):
            if not len(kept):
                break
            d = of[low[j] : high[j]]
            if len(d):
                p = np.minimum(np.searchsorted(d, kept), len(d) - 1)
                score = score + np.where(d[p] == kept, weight[j] * part[low[j] + p], 0.0)
        key = np.floor(score * 1e6 + 0.5)
        out[i] = np.count_nonzero((key > own[i]) | ((key == own[i]) & (kept < truth[i])))
        begin = end
    return pa.table({"q": phrases["q"], "better": pa.array(out)})


def own_metrics(index: Index, queries: DataFrame) -> DataFrame:
    """retrieval_metrics of the 5 best by BM25 for queries (q, text, doc)."""
    return retrieval_metrics(own_ranks(index, queries, 5), queries.select("q", "doc"))


def held_out(scores: DataFrame, own: DataFrame) -> DataFrame:
    """scores without those of the text that the phrase was taken from: own (q, doc)."""
    return scores.join(own.select("q", "doc"), ["q", "doc"], "left_anti")


def top_k(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, rank, doc, score): the k best of every phrase, ties by doc. A phrase with fewer hits gets the first texts at
    score 0, so that it has k rows. Scores are rounded to 6 digits first. The window keeps k rows a task and phrase."""
    first = [r["doc"] for r in docs.select("doc").orderBy("doc").limit(k).collect()]
    filler = queries.select("q", F.explode(F.array(*map(F.lit, first))).alias("doc"), F.lit(0.0).alias("score")) if first else None
    every = scores.select("q", "doc", F.round("score", 6).alias("score"))
    if filler is not None:
        every = every.union(filler).groupBy("q", "doc").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "doc", "score")


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """truth (q, doc) -> one row: share of phrases whose text is among the first k, and the mean reciprocal rank."""
    j = truth.join(ranked.select("q", "doc", "rank"), ["q", "doc"], "left")
    return j.agg(F.count("*").alias("n"), *(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"top{k}") for k in ks), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
