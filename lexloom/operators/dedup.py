"""Groups of equal and of similar short texts (Indel similarity)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import normalise
from lexloom.operators.components import connected_components
from lexloom.operators.numbering import number_rows
from lexloom.operators.skew import join_by_size
from lexloom.session import cut


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), with the LCS length by bit-parallel rows; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def exact_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group_key): the smallest key with the same normalised text. Null texts are left out.

    Texts are normalised once and stand for themselves by two 64-bit hashes, so 24 bytes a row are moved, never a text;
    two different texts agree in both with probability 2^-128. Only classes of several rows are joined.
    """
    n = F.col("_n")
    keyed = cut(rows.where(F.col(text).isNotNull()).select(key, normalise(F.col(text)).alias("_n")).select(key, F.xxhash64(n).alias("_a"), F.xxhash64(F.reverse(n), F.length(n)).alias("_b")))
    groups = cut(keyed.groupBy("_a", "_b").agg(F.min(key).alias("group_key"), F.count("*").alias("_c")).where("_c > 1"))
    total = groups.agg(F.sum("_c")).first()[0] or 0
    return join_by_size(keyed, groups, ["_a", "_b"], "_c", total, "left").select(key, F.coalesce("group_key", key).alias("group_key"))


def group_numbers(groups: DataFrame, key: str) -> DataFrame:
    """(key, group_key) plus group_no: groups numbered 0, 1, ... in the order of their first rows."""
    sizes = groups.groupBy("group_key").agg(F.count("*").alias("_c"))
    numbered = cut(number_rows(sizes, ["group_key"], "group_no"))
    return join_by_size(groups, numbered, ["group_key"], "_c", numbered.agg(F.sum("_c")).first()[0] or 0).select(key, "group_key", "group_no")


def similar_pairs(rows: DataFrame, text: str, threshold: int = 85) -> DataFrame:
    """(a, b, ratio), a < b: pairs of distinct normalised texts with an Indel ratio of at least the threshold. Exact.

    Texts are numbered by length and cut into blocks; blocks whose lengths allow the ratio meet in pairs (_met).
    """
    return _met(_texts(rows, text), threshold).select("a", "b", F.round("ratio", 6).alias("ratio"))


#: Least and most texts of a block, and into how many blocks texts are cut between these.
BLOCK, LARGEST, BLOCKS = 1000, 16384, 24
#: Columns of a table of letters, rows of it that meet a whole block at once, and pairs that are judged at once.
LETTERS, SLICE, PAIRS = 256, 512, 1 << 19


def _texts(rows: DataFrame, text: str) -> DataFrame:
    return cut(rows.select(normalise(F.col(text)).alias("v")).where("v <> ''").distinct())


def _met(texts: DataFrame, threshold: int, linked: bool = False) -> DataFrame:
    """texts (v), distinct -> (a, b, ratio). linked: only as many pairs of each two blocks as leave their texts as connected."""
    numbered = cut(number_rows(texts.withColumn("n", F.length("v")), ["n", "v"], "i"))
    size = min(max(numbered.count() // BLOCKS, BLOCK), LARGEST)
    blocks = cut(numbered.groupBy(F.floor(F.col("i") / size).alias("b")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list("v").alias("vs")))
    spans = blocks.select("b", "low", "high")
    x, y = (spans.select(*(F.col(c).alias(f"{c}{s}") for c in spans.columns)) for s in "xy")
    # the shorter text is the whole of what both share at best
    near = x.crossJoin(y).where((F.col("bx") <= F.col("by")) & (200 * F.least("highx", "lowy") >= threshold * (F.least("highx", "lowy") + F.col("lowy")))).select("bx", "by")
    both = near.join(blocks.select(F.col("b").alias("bx"), F.col("vs").alias("xs")), "bx").join(blocks.select(F.col("b").alias("by"), F.col("vs").alias("ys")), "by")
    spread = both.repartition(max(2 * texts.sparkSession.sparkContext.defaultParallelism, 48), F.xxhash64("bx", "by"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                xs, ys = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                same = batch.column(0)[k] == batch.column(1)[k]
                for i, j, ratio in _close(xs, ys, same, threshold, linked):
                    swap = [xs[p] > ys[q] for p, q in zip(i.tolist(), j.tolist(), strict=True)]
                    a = [ys[q] if s else xs[p] for p, q, s in zip(i.tolist(), j.tolist(), swap, strict=True)]
                    b = [xs[p] if s else ys[q] for p, q, s in zip(i.tolist(), j.tolist(), swap, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ratio)], ["a", "b", "ratio"])

    return spread.select("bx", "by", "xs", "ys").mapInArrow(judge, "a string, b string, ratio double")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, one row a text, padded by -1; and the lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.full((len(texts), int(n.max(initial=1))), -1, np.int64)
    codes[np.arange(codes.shape[1]) < n[:, None]] = flat
    return codes, n


def _letters(codes: np.ndarray, names: int) -> np.ndarray:
    """A row for each text with the counts of (letter, which occurrence of it); those of many letters share columns."""
    row, at = np.nonzero(codes >= 0)
    letter = codes[row, at]
    order = np.lexsort((letter, row))
    group = (row * names + letter)[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    nth = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    place = (nth * names + letter[order]) % LETTERS
    return np.bincount(row[order] * LETTERS + place, minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS).astype(np.float32)


def _close(xs: list[str], ys: list[str], same: bool, threshold: int, linked: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in xs, places in ys, ratio) of the pairs that reach the threshold; of one block each pair once.

    Letters that two texts have in common, with repetition, are no fewer than those of their longest common subsequence;
    one matrix product has them for all pairs of a slice and a block. Pairs that this bound leaves get the exact length by
    rows of bits, many at once; those of which both texts are longer than 64 letters one by one.
    """
    (cx, nx), (cy, ny) = _codes(xs), _codes(ys)
    names, flat = np.unique(np.concatenate([cx.ravel(), cy.ravel(), [-1]]), return_inverse=True)
    cx, cy = (flat[: cx.size].reshape(cx.shape) - 1), (flat[cx.size : -1].reshape(cy.shape) - 1)
    lx, ly, root = _letters(cx, len(names)), _letters(cy, len(names)).T.copy(), np.arange(len(xs) + (0 if same else len(ys)))
    shift = 0 if same else len(xs)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for s in range(0, len(xs), SLICE):
        need = (nx[s : s + SLICE, None] + ny[None, :]) * np.float32(threshold / 200) - np.float32(1e-3)
        i, j = np.nonzero(lx[s : s + SLICE] @ ly >= need)
        if same:
            i, j = i[i + s < j], j[i + s < j]
        short = nx[s : s + SLICE]
        bits = np.zeros((len(short), len(names)), np.uint64)
        for p in range(min(cx.shape[1], 64)):
            has = np.nonzero(short > p)[0]
            bits[has, cx[s + has, p]] |= np.uint64(1 << p)
        for c in range(0, len(i), PAIRS):
            a, b = i[c : c + PAIRS], j[c : c + PAIRS]
            lcs, long = np.zeros(len(a), np.int64), short[a] > 64
            p, q = a[~long], b[~long]
            v = np.full(len(p), ~np.uint64(0))
            for at in range(int(ny[q].max(initial=0))):
                letter = cy[q, at]
                u = np.where(letter >= 0, bits[p, letter], np.uint64(0)) & v
                v = (v + u) | (v - u)
            low = np.where(short[p] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(short[p], 63).astype(np.uint64)) - np.uint64(1))
            lcs[~long] = np.bitwise_count(~v & low)
            total = short[a] + ny[b]
            ratio = 200.0 * lcs / total
            for k in np.nonzero(long)[0]:
                ratio[k] = indel_ratio(xs[s + a[k]], ys[b[k]])
            kept = np.nonzero(ratio >= threshold)[0]
            if linked:
                new = []
                for k in kept.tolist():
                    g, h = top(int(a[k]) + s), top(int(b[k]) + shift)
                    if g != h:
                        root[g] = h
                        new.append(k)
                kept = np.array(new, np.int64)
            if len(kept):
                yield a[kept] + s, b[kept], ratio[kept]


def similar_groups(rows: DataFrame, key: str, text: str, threshold: int = 85) -> DataFrame:
    """(key, group_key): rows of equal or similar texts, directly or through others, with the smallest key."""
    n = cut(rows.where(F.col(text).isNotNull()).select(key, normalise(F.col(text)).alias("_n")))
    reps = n.groupBy("_n").agg(F.min(key).alias("rep"), F.count("*").alias("_c"))
    pairs = _met(_texts(rows, text), threshold, linked=True)
    links = pairs.join(reps.select(F.col("_n").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("_n").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = connected_components(links)
    of = cut(reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("_n", "_c", F.coalesce("root", "rep").alias("group_key")))
    return join_by_size(n, of, ["_n"], "_c", of.agg(F.sum("_c")).first()[0] or 0).select(key, "group_key")
