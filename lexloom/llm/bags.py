"""Overlap joins of texts on their pairs of neighbouring words: shared by the near-duplicate operators.

A text is a *bag*: every pair of neighbouring words, with its number of occurrence in the text, as one 64-bit element.
So the overlap of two texts (shared pairs with repetition, over those of the text with more) is the overlap of two sets.
Texts of one bag form a *class* (a 64-bit hash of the bag, the sum of its mixed elements). The steps:

1. `parse` reads every text once and keeps its class, and each class's bag (once a task, however many copies it has);
2. a signature turns each bag into bucket keys. Every element counts the same in its minima, as it does in the overlap,
   however common its words are;
3. runs of equal keys give candidate pairs of classes, but for those whose sketches already rule the overlap out. The
   classes of runs beyond RUN take an exact way instead: a prefix join over their rarest elements (`hot_pairs`), in blocks
   of RUN classes, each pair once;
4. candidates meet the bags of their classes, no others, and the overlap is counted exactly (`verify`);
5. pairs of classes, and classes of several rows, are unfolded to rows only where a result asks for pairs of rows, in
   blocks of BLOCK rows (`row_pairs`).

Null keys, null texts and texts of fewer than MIN_WORDS words take no part. Long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import REMEMBERED, PieceHash, U, mix, word_hashes
from lexloom.operators.skew import join_by_size
from lexloom.session import cut

MIN_WORDS = 20
#: Least overlap of a pair, as TESTDATA.md has it.
OVERLAP = 0.6
#: Classes of one bucket that are paired within it; the classes of larger buckets take the exact way.
RUN = 400
#: Classes that are broadcast, with two or three numbers each; a list of more is shuffled.
FEW = 1_000_000
#: Rows of one class that are unfolded together.
BLOCK = 1000
#: A bag's sketch: the places of its elements among 64 * SKETCH bits. Elements of a bag at places that another bag lacks
#: are not shared, so the sketches bound the overlap from above, exactly, and the more tightly the shorter the texts are.
SKETCH = 4
_S = [f"s{i}" for i in range(SKETCH)]
#: Sides of a row: a pair needs one row that may stand left and one that may stand right.
LEFT, RIGHT = 1, 2

Signature = Callable[[np.ndarray, np.ndarray], np.ndarray]


def elements(texts: list[str | None], pieces: PieceHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements by text, start of each text's elements, index of each text that takes part), whole batch at once."""
    h, at = word_hashes(texts, pieces)
    words = np.bincount(at, minlength=len(texts)) if len(at) else np.zeros(len(texts), int)
    ok = words >= MIN_WORDS
    keep = ok[at]
    h, at = h[keep], at[keep]
    if not len(h):
        return np.zeros(0, U), np.zeros(0, int), np.zeros(0, int)
    same = at[1:] == at[:-1]
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> U(32))))[same]
    at = at[:-1][same]
    order = np.lexsort((pair, at))
    pair, at = pair[order], at[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])
    pos = np.arange(len(pair))
    nth = pos - np.maximum.accumulate(np.where(fresh, pos, 0))
    e = np.where(nth > 0, mix(pair + nth.astype(U) * U(0xD6E8FEB86659FD93)), pair)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return e, starts, at[starts]


def class_ids(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mix(e ^ U(0xA5A5A5A5C3C3C3C3)), starts) if len(starts) else np.zeros(0, U)


def min_hashes(e: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minima of each bag, [bag, n]; two bags agree in one as often as their Jaccard similarity."""
    rng = np.random.default_rng(seed)
    xor, mul = rng.integers(1, 2**63, n, dtype=np.int64).view(U), rng.integers(1, 2**63, n, dtype=np.int64).view(U) | U(1)
    out = np.empty((len(starts), n), U)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((e ^ xor[i]) * mul[i], starts)
    return out


def sketches(e: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    place = mix(e ^ U(0x3C6EF372FE94F82B)) % U(64 * SKETCH)
    bit = U(1) << (place & U(63))
    return [np.bitwise_or.reduceat(np.where(place >> U(6) == i, bit, U(0)), starts) for i in range(SKETCH)]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parse(rows: DataFrame, key: str, text: str, side: Column) -> DataFrame:
    """What all later steps read, cut: a row (key, class, meta) for every text that takes part, meta being its side, and
    a row (class, meta, bag, sketch) with whole = true for every class and side of a task, meta being 4 * elements + side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = PieceHash(), set()
        names = ["whole", "key", "class", "meta", "bag", *_S]
        for b in batches:
            e, starts, who = elements(b.column(1).to_pylist(), pieces)
            if not len(starts):
                continue
            ids, n, ends = class_ids(e, starts), len(starts), np.append(starts, len(e))
            sides = b.column(2).to_numpy(zero_copy_only=False)[who].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), b.column(0).take(pa.array(who)), _i64(ids), pa.array(sides), pa.nulls(n, pa.list_(pa.int64())), *[pa.nulls(n, pa.int64())] * SKETCH], names)
            new = []
            for k, x in enumerate(zip(ids.tolist(), sides.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    new.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            if new:
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _i64(e)).take(pa.array(new))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(new), bool)), pa.nulls(len(new), pa.int64()), _i64(ids[new]), pa.array(sides[new] + 4 * np.diff(ends)[new]), lists, *(_i64(x[new]) for x in sketches(e, starts))], names)

    taken = rows.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), side.cast("tinyint").alias("s")).where("k is not null and t is not null and s > 0")
    return cut(taken.mapInArrow(run, "whole boolean, key bigint, class bigint, meta bigint, bag array<bigint>, " + ", ".join(f"{x} bigint" for x in _S)))


def members_of(parsed: DataFrame) -> DataFrame:
    """(key, class, side) of every text that takes part."""
    return parsed.where("not whole").select("key", "class", F.col("meta").alias("side"))


def bags_of(parsed: DataFrame, classes: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """classes (class, ..., cut) plus bag and more, one row a class, cut. Up to FEW classes are sent to the bags, so that
    no other bag moves; more than that meet them in a shuffle."""
    rest = [c for c in classes.columns if c != "class"]
    few = F.broadcast(classes) if classes.count() <= FEW else classes
    found = parsed.where("whole").select("class", "bag", *more).join(few, "class")
    return cut(found.groupBy("class").agg(*(F.first(c).alias(c) for c in ("bag", *more, *rest))))


def _merged(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (key, class, meta, ...) sorted by (key, class), each class once a key with all its sides."""
    k, c, meta = cols[:3]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(first)
    return [k[at], c[at], np.bitwise_or.reduceat(meta, at) if len(at) else meta, *(x[at] for x in cols[3:])]


_BUCKET = ["bucket", "class", "meta", *_S]


def bucket_rows(parsed: DataFrame, signature: Signature) -> DataFrame:
    """(bucket, class, meta, sketch) of every class. The sketch goes along, so that candidates are judged where buckets
    meet, in one shuffle that grows with the texts and not with the pairs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bags = b.column(0)
                keys = signature(bags.flatten().to_numpy(zero_copy_only=False).view(U), bags.offsets.to_numpy()[:-1] - bags.offsets[0].as_py())
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([_i64(keys.ravel()), *(pa.array(np.repeat(x.to_numpy(zero_copy_only=False), n)) for x in b.columns[1:])], _BUCKET)

    return parsed.where("whole").select("bag", "class", "meta", *_S).mapInArrow(sign, ", ".join(f"{x} bigint" for x in _BUCKET))


def shared_buckets(parsed: DataFrame, signature: Signature) -> DataFrame:
    """The rows of bucket_rows in buckets that hold several classes, and both sides, cut."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, passed = [np.zeros(0, np.int64)] * len(_BUCKET), None

        def out(cols, ok):
            return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in cols], _BUCKET)

        def good(k, s):
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(head, len(k)))
            return np.repeat((size > 1) & (np.bitwise_or.reduceat(s, head) & 3 == LEFT | RIGHT), size)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _merged([np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)])
            at = int(np.searchsorted(cols[0], cols[0][-1]))
            done, rest = [x[:at] for x in cols], [x[at:] for x in cols]
            if at:
                yield out(done, good(done[0], done[2]) | (done[0] == passed if passed is not None else False))
            if len(rest[0]) > RUN or rest[0][0] == passed:  # a long run goes on as it comes, but for the class that may go on
                passed = int(rest[0][0])
                yield out(rest, np.arange(len(rest[0])) < len(rest[0]) - 1)
                rest = [x[-1:] for x in rest]
        if len(rest[0]):
            yield out(rest, good(rest[0], rest[2]) | (rest[0] == passed if passed is not None else False))

    return cut(bucket_rows(parsed, signature).repartition("bucket").sortWithinPartitions("bucket", "class").mapInArrow(keep, ", ".join(f"{x} bigint" for x in _BUCKET)))


def _joinable(x: np.ndarray, y: np.ndarray, t: list[np.ndarray], overlap: float) -> np.ndarray:
    """Whether the classes in these places stand on two sides, in two groups (or none), and may reach the overlap by size
    and by sketch. t: class, meta, sketch and group of every place."""
    c, meta, *sketch, g = t
    s, r = meta[x], meta[y]
    crossed = ((s & LEFT) & ((r & RIGHT) >> 1)) | (((s & RIGHT) >> 1) & (r & LEFT))
    n, m = s // 4, r // 4
    ok = crossed.astype(bool) & (c[x] != c[y]) & ((g[x] != g[y]) | (g[x] == 0)) & (np.minimum(n, m) >= overlap * np.maximum(n, m))
    at = np.flatnonzero(ok)
    x, y, n, m = x[at], y[at], n[at], m[at]
    only_x, only_y = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for w in sketch:
        only_x += np.bitwise_count((w[x] & ~w[y]).view(U))
        only_y += np.bitwise_count((w[y] & ~w[x]).view(U))
    ok[at] = np.minimum(n - only_x, m - only_y) >= overlap * np.maximum(n, m)
    return ok


def _runs(k: np.ndarray, t: list[np.ndarray], overlap: float, thin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes within runs of equal keys; input sorted by (key, class), each class once a key. thin: only each
    class with the first of its run and with the one before it."""
    a, b = [], []
    idx = np.arange(len(k))
    if thin:
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else idx
        first = np.repeat(head, np.diff(np.append(head, len(k))))
        steps = [(first, idx), (np.maximum(idx - 1, first), idx)]
    else:
        steps, j = [], 1
        while len(idx):
            idx = idx[idx + j < len(k)]
            idx = idx[k[idx] == k[idx + j]]
            steps.append((idx, idx + j))
            j += 1
    for x, y in steps:
        ok = _joinable(x, y, t, overlap)
        a.append(t[0][x[ok]])
        b.append(t[0][y[ok]])
    none = np.zeros(0, np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def run_pairs(buckets: DataFrame, overlap: float, thin: bool = False) -> DataFrame:
    """(a, b, meta): candidate pairs a < b with meta 0; a class of a bucket over RUN as (a, a, its meta), unless thin.

    buckets (bucket, class, meta, sketch, g): g is a group within which no pair is asked for, 0 for none. A long run is
    never held: it is passed on as it comes, and with thin only its first and last class are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, np.int64)] * (4 + SKETCH)
        rest, hot = empty, None

        def out(cols, passed=None):
            k, t = cols[0], cols[1:]
            hc, hm = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not thin and len(k):
                head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                size = np.diff(np.append(head, len(k)))
                long = np.repeat(size, size) > RUN
                if passed is not None:
                    long |= k == passed
                hc, hm, k, t = t[0][long], t[1][long], k[~long], [x[~long] for x in t]
            a, b = _runs(k, t, overlap, thin)
            p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0], hc])), pa.array(np.concatenate([p[1], hc])), pa.array(np.concatenate([np.zeros(p.shape[1], np.int64), hm]))], ["a", "b", "meta"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _merged([np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)])
            k = cols[0]
            at = int(np.searchsorted(k, k[-1]))
            if thin and len(k) - at > RUN:
                yield out(cols)
                rest = [x[[at, len(k) - 1]] for x in cols]
                continue
            if at:
                yield out([x[:at] for x in cols], hot)
            rest = [x[at:] for x in cols]
            if not thin and (len(rest[0]) > RUN or rest[0][0] == hot):
                hot = int(rest[0][0])
                yield out(rest, hot)
                rest = empty
        if len(rest[0]):
            yield out(rest, hot)

    return buckets.select(*_BUCKET, "g").repartition("bucket").sortWithinPartitions("bucket", "class").mapInArrow(run, "a bigint, b bigint, meta bigint")


def _block_pairs(t: list[np.ndarray], own: np.ndarray, diagonal: bool, lower: pa.ListArray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the classes of one block pair that share no element of lower rank, so that each pair comes up once."""
    c, flat, off = t[0], lower.flatten().to_numpy(zero_copy_only=False), lower.offsets.to_numpy()
    of = np.repeat(np.arange(len(c)), np.diff(off))
    _, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n > 1
    column = np.cumsum(often) - 1
    keep = often[inv]
    of, inv, width = of[keep], column[inv[keep]], int(often.sum())
    a, b = [], []
    for top in range(0, len(c), 512):
        rows = np.arange(top, min(top + 512, len(c)))
        before = np.zeros((len(rows), len(c)), np.float32)
        for left in range(0, width, 4096):
            m = np.zeros((len(c), min(4096, width - left)), np.float32)
            some = (inv >= left) & (inv < left + 4096)
            m[of[some], inv[some] - left] = 1
            before += m[rows] @ m.T
        x, y = np.nonzero((before == 0) & (rows[:, None] < np.arange(len(c))[None, :]))
        x = rows[x]
        ok = _joinable(x, y, t, overlap)
        if not diagonal:
            ok &= own[x] != own[y]
        a.append(c[x[ok]])
        b.append(c[y[ok]])
    return np.concatenate(a), np.concatenate(b)


def hot_pairs(hot: DataFrame, overlap: float) -> DataFrame:
    """(a, b), a < b: all pairs of classes (class, meta, g, bag, sketch) that may reach the overlap, each once. Exact.

    Two bags with that overlap share one of the n - ceil(overlap * n) + 1 rarest elements of each, in any order that is
    the same for all; ordering by frequency keeps the shared keys rare. The classes of an element that many share are cut
    into blocks of about RUN, and each pair of blocks is a key of its own, so no task gets them all; a pair counts only
    at the first element that both prefixes share. Elements whose classes are all of one group g are left out.
    """
    each = hot.select("class", "meta", "g", *_S, F.size("bag").alias("n"), F.explode("bag").alias("e"))
    df = cut(each.groupBy("e").agg(F.count("*").alias("df")))
    total = df.agg(F.sum("df")).first()[0] or 0
    ranked = join_by_size(each, df, ["e"], "df", total).groupBy("class").agg(F.first("meta").alias("meta"), F.first("g").alias("g"), F.first("n").alias("n"), *(F.first(x).alias(x) for x in _S), F.array_sort(F.collect_list(F.struct("df", "e"))).alias("r"))
    prefix = F.transform(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * overlap) + 1).cast("int")), lambda x: x["e"])
    short = cut(ranked.select("class", "meta", "g", *_S, prefix.alias("p")))
    keyed = short.select("class", "meta", "g", *_S, "p", F.posexplode("p").alias("at", "e")).select("class", "meta", "g", *_S, "e", F.slice("p", F.lit(1), F.col("at")).alias("lower"))
    split = (F.min("g") != F.max("g")) | (F.min("g") == 0)
    sizes = cut(short.select("class", "g", F.explode("p").alias("e")).groupBy("e").agg(F.count("*").alias("f"), split.alias("split")).where("f > 1 and split").select("e", "f", F.ceil(F.col("f") / RUN).cast("bigint").alias("blocks")))
    total = sizes.agg(F.sum("f")).first()[0] or 0
    blocks = join_by_size(keyed, sizes, ["e"], "f", total).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    spread = blocks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = spread.select(F.xxhash64("e", F.least("own", "j"), F.greatest("own", "j")).alias("k"), "class", "meta", "g", *_S, "own", (F.col("own") == F.col("j")).alias("diagonal"), "lower")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def out(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            k = t.column("k").to_numpy()
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(head.tolist(), np.append(head[1:], len(k)).tolist(), strict=True):
                if j - i > 1:
                    part = t.slice(i, j - i).combine_chunks()
                    cols = [part.column(x).to_numpy() for x in ("class", "meta", *_S, "g")]
                    own = part.column("own").to_numpy()
                    diagonal = bool(part.column("diagonal")[0].as_py())
                    lower = pa.concat_arrays(part.column("lower").chunks)
                    x, y = _block_pairs(cols, own, diagonal, lower, overlap)
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = t.column("k").to_numpy()
            at = int(np.searchsorted(k, k[-1]))
            if at:
                yield out(t.slice(0, at))
            rest = t.slice(at)
        if rest is not None:
            yield out(rest)

    return rows.repartition("k").sortWithinPartitions("k", "class").mapInArrow(run, "a bigint, b bigint")


def candidates(parsed: DataFrame, buckets: DataFrame, overlap: float, groups: DataFrame | None = None) -> DataFrame:
    """(a, b), cut: candidate pairs of the buckets, each once; with groups (class, g) only pairs of classes of two groups."""
    of_group = lambda df: df.withColumn("g", F.lit(0).cast("bigint")) if groups is None else df.join(groups, "class")
    found = cut(run_pairs(of_group(buckets), overlap).groupBy("a", "b").agg(F.bit_or("meta").alias("meta")))
    pairs, hot = found.where("a <> b").select("a", "b"), found.where("a = b").select(F.col("a").alias("class"), "meta")
    if hot.isEmpty():
        return pairs
    return cut(pairs.union(hot_pairs(bags_of(parsed, cut(of_group(hot)), tuple(_S)), overlap)).distinct())


def verify(parsed: DataFrame, pairs: DataFrame, overlap: float) -> DataFrame:
    """(a, b, overlap), cut: the pairs of at least that overlap. Only bags of their classes are moved; a class of very
    many pairs is spread by join_by_size."""
    degree = cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n")))
    total = degree.agg(F.sum("n")).first()[0] or 0
    bags = bags_of(parsed, degree)
    side = lambda x: bags.select(F.col("class").alias(x), F.col("bag").alias(f"bag_{x}"), F.col("n").alias("n"))
    left = join_by_size(pairs, side("a"), ["a"], "n", total // 2).drop("n")
    both = join_by_size(left, side("b"), ["b"], "n", total // 2).drop("n")
    share = F.size(F.array_intersect("bag_a", "bag_b")) / F.greatest(F.size("bag_a"), F.size("bag_b"))
    return cut(both.select("a", "b", share.alias("overlap")).where(F.col("overlap") >= overlap))


def class_pairs(parsed: DataFrame, signature: Signature, overlap: float = OVERLAP) -> DataFrame:
    """(a, b, overlap): pairs of different classes, one with a LEFT and one with a RIGHT row, of at least that overlap."""
    return verify(parsed, candidates(parsed, bucket_rows(parsed, signature), overlap), overlap)


def row_pairs(members: DataFrame, verified: DataFrame) -> DataFrame:
    """(key_a, key_b), smaller key first: all pairs of a LEFT and a RIGHT row of one class or of two verified classes.

    Rows of a class are gathered in blocks of about BLOCK keys, and links meet blocks, so that neither a class that holds
    a third of all rows nor one with very many links is unfolded in one task.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    ends = verified.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("degree"))
    known = cut(sizes.join(ends, "class", "left").where("n > 1 or degree is not null").select("class", "n", (F.coalesce("degree", F.lit(0)) + 1).alias("degree")))
    top = known.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("degree").alias("degree")).first()
    parts = -(-(top["most"] or 1) // BLOCK)
    own = join_by_size(members, known, ["class"], "n", top["n"] or 0)
    blocks = own.groupBy("class", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("block")).agg(F.collect_list(F.struct("key", "side")).alias("ks"), F.first("degree").alias("degree"))
    if parts > 1 or not known.where("degree > 1000").isEmpty():
        blocks = cut(blocks)
    links = verified.select("a", "b").union(known.where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
    side = lambda x: blocks.select(F.col("class").alias(x), F.col("block").alias(f"block_{x}"), F.col("ks").alias(f"ks_{x}"), "degree")
    left = join_by_size(links, side("a"), ["a"], "degree", top["degree"] or 0).drop("degree")
    both = join_by_size(left, side("b"), ["b"], "degree", top["degree"] or 0).drop("degree").where("a <> b or block_a <= block_b")
    if parts > 1:
        both = both.repartition("a", "b", "block_a", "block_b")
    each = both.select("a", "b", F.col("block_a") == F.col("block_b"), F.explode("ks_a").alias("x"), "ks_b").toDF("a", "b", "same", "x", "ks_b").select("a", "b", "same", "x", F.explode("ks_b").alias("y"))
    sa, sb = F.col("x.side"), F.col("y.side")
    crossed = (sa.bitwiseAND(LEFT) > 0) & (sb.bitwiseAND(RIGHT) > 0) | (sa.bitwiseAND(RIGHT) > 0) & (sb.bitwiseAND(LEFT) > 0)
    once = (F.col("a") != F.col("b")) | ~F.col("same") | (F.col("x.key") < F.col("y.key"))
    return each.where(crossed & once).select(F.least("x.key", "y.key").alias("key_a"), F.greatest("x.key", "y.key").alias("key_b"))
