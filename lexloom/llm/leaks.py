"""Problem 8: evaluation texts that leak into training text, by suffix arrays over shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.words import PieceHash, U, word_hashes
from lexloom.session import spread, table

#: Words in succession that make a leak.
LEAST = 8
#: Words of a shard: a worker closes a shard at the first end of a text beyond it.
SHARD_WORDS = 1_000_000
#: (run, document, item) triples that are made distinct at once.
EXPANDED = 4_000_000
#: Bytes of test items that are sent to every worker at once; more items than that go in several blocks.
BLOCK_BYTES = 16_000_000


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes that start there, as far as depth words tell them apart (by doubling)."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while step < depth and rank.max(initial=0) < len(words):
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (len(words) + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def window_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """An exact number for every run of that many words: equal runs, and only those, have equal numbers. By doubling; a
    length that is no power of two is two overlapping runs of one."""
    rank, step = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while step < length:
        ahead = min(step, length - step)
        n = len(rank) - ahead
        if n <= 0:
            return np.zeros(0, np.int64)
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[ahead:], return_inverse=True)[1].astype(np.int64)
        step += ahead
    return rank


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1: words[at:] as far as length words against query[start:]; a shard that ends comes first."""
    out, live = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in range(length):
        i = at[live] + k
        end = i >= len(words)
        mine, its = words[np.minimum(i, len(words) - 1)], query[start[live] + k]
        out[live] = np.where(end | (mine < its), -1, np.where(mine > its, 1, 0))
        live = live[out[live] == 0]
    return out


def _search_order(words: np.ndarray, order: np.ndarray, query: np.ndarray, start: np.ndarray, length: int, after: bool) -> np.ndarray:
    """Binary search of query[start:start + length] among the suffixes: the first not below it, or, with after, the
    first above all that start with it."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        cmp = _compare(words, order[mid], query, start[open_], length)
        below = cmp <= 0 if after else cmp < 0
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


class Items:
    """Test items of a block: their words, each distinct run of ``least`` words once, and the items that hold it."""

    def __init__(self, ids: list[int], texts: list[str], least: int) -> None:
        self.ids, self.least = np.array(ids, np.int64), least
        self.query, at = word_hashes(texts, PieceHash())
        self.heads = np.searchsorted(at, np.arange(len(ids) + 1))
        rank = window_ranks(self.query, least)
        own = np.flatnonzero(at[: len(rank)] == at[least - 1 : least - 1 + len(rank)]) if len(rank) else np.zeros(0, np.int64)
        _, first, run = np.unique(rank[own], return_index=True, return_inverse=True)
        self.starts = own[first]
        pairs = np.unique(np.stack([run, at[own]]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
        self.items, self.bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(first) + 1))

    def words(self, item: int) -> np.ndarray:
        return self.query[self.heads[item] : self.heads[item + 1]]

    def found_in(self, words: np.ndarray, order: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """[2, n] distinct (item, document) of a shard. Each place of the shard starts one run, so the places of all
        distinct runs together are no more than the shard has; documents are made distinct before items are."""
        low = _search_order(words, order, self.query, self.starts, self.least, False)
        n = _search_order(words, order, self.query, self.starts, self.least, True) - low
        hit = np.flatnonzero(n)
        n, low = n[hit], low[hit]
        run = np.repeat(hit, n)
        doc = doc_of[order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]]
        seen = np.unique(np.stack([run, doc]), axis=1) if len(run) else np.zeros((2, 0), np.int64)
        out, many = np.zeros((2, 0), np.int64), np.diff(self.bounds)[seen[0]]
        ends = np.cumsum(many)
        at = 0
        while at < len(many):  # a few million at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, side="right")))
            m, r, d = many[at:to], seen[0, at:to], seen[1, at:to]
            item = self.items[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.bounds[r], m)]
            out = np.unique(np.concatenate([out, np.stack([item, np.repeat(d, m)])], axis=1), axis=1)
            at = to
        return out


def longest_match(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int]:
    """(words, place in doc, place in item) of the longest run both have, the first one in doc and there in item."""
    both, cut_ = np.concatenate([doc, item]), len(doc)

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank = window_ranks(both, n)
        a, b = rank[: cut_ - n + 1], rank[cut_:]
        return np.intersect1d(a, b), a, b

    low, high = least, min(len(doc), len(item))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(shared(mid)[0]) else (low, mid - 1)
    common, a, b = shared(low)
    at = int(np.flatnonzero(np.isin(a, common))[0])
    return low, at, int(np.flatnonzero(b == a[at])[0])


def leaked_passages(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, places: bool = True) -> DataFrame:
    """(item_id, doc_id, words int, doc_at int, item_at int): each document and item that share at least ``least`` words in
    succession, once, with the length of the longest such run and where it starts (in words) on both sides. Without
    places only the two ids.

    Words are those of TESTDATA.md, so case, line breaks and outer punctuation don't matter. Null, empty and short
    texts or items match nothing, null keys neither; repeated rows match each for itself; long texts are searched whole,
    in overlapping parts; other columns are ignored; empty tables give no row.

    Each worker cuts its documents into shards at text ends, builds a suffix array of each and searches every distinct
    run of every item in it, so the corpus is never shuffled and is read once. Items go to the workers in blocks of a
    bounded size, of which a worker holds one at a time.
    """
    spark = docs.sparkSession
    known = items.where(f"`{item_key}` is not null and `{item_text}` is not null").select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    volume = known.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    blocks = -(-volume // BLOCK_BYTES) or 1
    shared = []
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i").collect()
        shared.append(spark.sparkContext.broadcast(Items([r["i"] for r in own], [r["t"] for r in own], least)))
    names = ["item_id", "doc_id", *(["words", "doc_at", "item_at"] if places else [])]

    def search(texts: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        parts = [(k, x[i : i + SHARD_WORDS + least - 1]) for k, x in enumerate(texts) for i in range(0, max(1, len(x) - least + 1), SHARD_WORDS)]
        shards, size = [[]], 0
        for k, x in parts:
            if size >= SHARD_WORDS:
                shards.append([])
                size = 0
            shards[-1].append((k, np.append(x, U(0))))
            size += len(x) + 1
        arrays = []
        for shard in shards:
            words = np.concatenate([x for _, x in shard])
            arrays.append((words, suffix_array(words, least), np.repeat([k for k, _ in shard], [len(x) for _, x in shard])))
        for b in shared:
            held = b.value
            found = np.unique(np.concatenate([held.found_in(*a) for a in arrays], axis=1), axis=1)
            cols = [pa.array(held.ids[found[0]]), pa.array(np.array(keys, np.int64)[found[1]])]
            if places:
                told = [longest_match(texts[d], held.words(i), least) for i, d in found.T.tolist()]
                cols += [pa.array([x[j] for x in told], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names)
            if len(shared) > 1:
                del b._value  # it stays on the worker's disk and is read again for the next shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, kept, keys, size = PieceHash(), [], [], 0
        for b in batches:
            h, at = word_hashes(b.column(1).to_pylist(), pieces)
            counts = np.bincount(at, minlength=b.num_rows)
            for k, x in zip(b.column(0).to_pylist(), np.split(h, np.cumsum(counts)[:-1]), strict=True):
                if len(x) < least:
                    continue
                kept.append(x)
                keys.append(k)
                size += len(x) + 1
                if size >= SHARD_WORDS:
                    yield from search(kept, keys)
                    kept, keys, size = [], [], 0
        if kept:
            yield from search(kept, keys)

    chosen = docs.where(f"`{doc_key}` is not null and `{text}` is not null").select(F.col(doc_key).cast("bigint"), F.col(text))
    return chosen.mapInArrow(run, ", ".join(f"{n} {'bigint' if n.endswith('_id') else 'int'}" for n in names))


def without_leaks(docs: DataFrame, doc_key: str, leaks: DataFrame) -> DataFrame:
    """The documents that hold no item, in whole or in part; those without a key stay."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")


def _leaks(spark: SparkSession, sf_dir: str, places: bool) -> DataFrame:
    return leaked_passages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_passages").select("item_id", "text"), "item_id", "text", places=places)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, False)


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with the length and places of its longest passage."""
    return _leaks(spark, sf_dir, True)


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no item, in whole or in part."""
    return without_leaks(table(spark, sf_dir, "documents"), "doc_id", _leaks(spark, sf_dir, False))
