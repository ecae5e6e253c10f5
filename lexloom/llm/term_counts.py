"""Problem 1: occurrences and records of every distinct term, by burst tries merged along adaptive prefixes."""

from __future__ import annotations

import os.path
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.words import REMEMBERED, strip_word
from lexloom.session import cut, table

#: Terms of a container before it bursts into one container for each next character.
BURST = 4096
#: Terms a worker holds before it sends its tries off and starts anew.
HELD = 1_000_000
#: A prefix is split further while more than one in ROUTES of the (partial) terms start with it, and more than LEAST.
#: So at most ROUTES prefixes of each length are known to the driver and to every worker. Prefixes up to DEEPEST characters
#: are counted at once; longer ones, and those above which workers did not burst, in rounds that skip what all terms of a
#: prefix share.
ROUTES, LEAST, DEEPEST = 1024, 2048, 24


class Container:
    """A compact leaf: the rest of each term behind the prefix, with its occurrences and records."""

    __slots__ = ("counts", "prefix")

    def __init__(self, prefix: str) -> None:
        self.prefix, self.counts = prefix, {}


class Node:
    """A burst container: one child for each next character, and the counts of the term that ends here."""

    __slots__ = ("end", "kids", "prefix")

    def __init__(self, prefix: str) -> None:
        self.prefix, self.kids, self.end = prefix, {}, None


class BurstTrie:
    def __init__(self) -> None:
        self.root, self.size = Container(""), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        self._add(self.root, None, 0, term, occurrences, records)

    def _add(self, at: Node | Container, above: Node | None, i: int, term: str, occurrences: int, records: int) -> None:
        while type(at) is Node:
            if i == len(term):
                if at.end is None:
                    at.end = [0, 0]
                    self.size += 1
                at.end[0] += occurrences
                at.end[1] += records
                return
            kid = at.kids.get(term[i])
            if kid is None:
                kid = at.kids[term[i]] = Container(term[: i + 1])
            above, at, i = at, kid, i + 1
        self._put(at, term[i:], occurrences, records)
        self._split(at, above)

    def _put(self, c: Container, rest: str, occurrences: int, records: int) -> None:
        found = c.counts.get(rest)
        if found is None:
            c.counts[rest] = [occurrences, records]
            self.size += 1
        else:
            found[0] += occurrences
            found[1] += records

    def _split(self, c: Container, above: Node | None) -> None:
        if len(c.counts) > BURST:
            node = self._burst(c)
            if above is None:
                self.root = node
            else:
                above.kids[c.prefix[-1]] = node

    def graft(self, prefix: str, rests: Iterator[tuple[str, int, int]]) -> None:
        """Merges a container of another trie with the subtree of the same prefix: found once, then leaf into leaf, or,
        where this trie has burst there, into the subtrees below."""
        at, above, i = self.root, None, 0
        while type(at) is Node and i < len(prefix):
            kid = at.kids.get(prefix[i])
            if kid is None:
                kid = at.kids[prefix[i]] = Container(prefix[: i + 1])
            above, at, i = at, kid, i + 1
        if type(at) is Node:
            for rest, occurrences, records in rests:
                self._add(at, above, i, prefix + rest, occurrences, records)
            return
        head = prefix[i:]
        for rest, occurrences, records in rests:
            self._put(at, head + rest, occurrences, records)
        self._split(at, above)

    @staticmethod
    def _burst(c: Container) -> Node:
        node = Node(c.prefix)
        for rest, n in c.counts.items():
            if not rest:
                node.end = n
                continue
            kid = node.kids.get(rest[0])
            if kid is None:
                kid = node.kids[rest[0]] = Container(c.prefix + rest[0])
            kid.counts[rest[1:]] = n
        return node

    def containers(self) -> Iterator[Container]:
        stack = [self.root]
        while stack:
            at = stack.pop()
            if type(at) is Node:
                if at.end is not None:
                    c = Container(at.prefix)
                    c.counts[""] = at.end
                    yield c
                stack.extend(at.kids.values())
            elif at.counts:
                yield at


def pack(counts: dict[str, list[int]]) -> bytes:
    """Terms in order, each without what it shares with the one before; lengths and counts as 32 and 64 bit numbers."""
    terms = sorted(counts)
    shared, tails, last = [], [], ""
    for t in terms:
        k, most = 0, min(len(t), len(last))
        while k < most and t[k] == last[k]:
            k += 1
        shared.append(k)
        tails.append(t[k:])
        last = t
    text = "".join(tails).encode("utf-8", "surrogatepass")
    n = np.array([len(terms)], np.uint32)
    heads = np.array([shared, [len(t) for t in tails]], np.uint32)
    return n.tobytes() + heads.tobytes() + np.array([counts[t] for t in terms], np.int64).tobytes() + text


def unpack(data: bytes) -> Iterator[tuple[str, int, int]]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    heads = np.frombuffer(data, np.uint32, 2 * n, 4).reshape(2, n).tolist()
    counts = np.frombuffer(data[4 + 8 * n : 4 + 24 * n], np.int64).reshape(n, 2).tolist()
    text, at, last = data[4 + 24 * n :].decode("utf-8", "surrogatepass"), 0, ""
    for k, m, (a, b) in zip(*heads, counts, strict=True):
        last = last[:k] + text[at : at + m]
        at += m
        yield last, a, b


class Pieces(dict):
    """White-space piece -> its word."""

    def __missing__(self, piece: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        w = self[piece] = strip_word(piece)
        return w


def _words(texts: list[str | None], memory: Pieces, occ: Counter, rec: Counter) -> None:
    get = memory.__getitem__
    for t in texts:
        if t is not None:
            ws = list(map(get, t.lower().split()))
            occ.update(ws)
            rec.update(set(ws))
    occ.pop("", None)


def _whole(texts: list[str | None], memory: Pieces, occ: Counter, rec: Counter) -> None:
    ws = [w for t in texts if t is not None and (w := t.lower().strip())]
    occ.update(ws)
    rec.update(ws)


SPLITTERS: dict[str, Callable] = {"words": _words, "whole": _whole}


def _partial_tries(rows: DataFrame, column: str, terms: str) -> DataFrame:
    """(prefix string, n int, packed binary): the containers of each worker's tries."""
    split = SPLITTERS[terms]

    def send(trie: BurstTrie) -> pa.RecordBatch:
        found = list(trie.containers())
        return pa.RecordBatch.from_arrays([pa.array([c.prefix for c in found], pa.string()), pa.array([len(c.counts) for c in found], pa.int32()), pa.array([pack(c.counts) for c in found], pa.binary())], ["prefix", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memory = BurstTrie(), Pieces()
        for b in batches:
            occ, rec = Counter(), Counter()
            split(b.column(0).to_pylist(), memory, occ, rec)
            for t, n in occ.items():
                trie.add(t, n, rec[t])
            if trie.size > HELD:
                yield send(trie)
                trie = BurstTrie()
        yield send(trie)

    return rows.select(F.col(column).alias("t")).where("t is not null").mapInArrow(run, "prefix string, n int, packed binary")


def route_of(term: str, split: dict[str, int]) -> tuple[str, bool]:
    """(route, whole): the shortest prefix that isn't split further, and true; the term itself, and false, where the term
    ends above that. split: prefix -> the length that all terms behind it share; the next character parts them."""
    r = ""
    while r in split:
        k = split[r] + 1
        if k > len(term):
            return term, False
        r = term[:k]
    return r, True


def _split_prefixes(parts: DataFrame, limit: int) -> dict[str, int]:
    """The prefixes of more than limit terms, each with the length that is shared behind it."""
    deep = F.explode(F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(DEEPEST)))).alias("k")
    below = parts.select("prefix", "n", deep).groupBy(F.expr("substring(prefix, 1, k)").alias("p")).agg(F.sum("n").alias("n"))
    split = {r["p"]: len(r["p"]) for r in below.where(F.col("n") > limit).select("p").collect()}
    fresh = any(len(p) == DEEPEST for p in split) or any(r["prefix"] in split for r in parts.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("prefix").collect())
    while fresh:

        def routes(batches: Iterator[pa.RecordBatch], split: dict[str, int] = split) -> Iterator[pa.RecordBatch]:
            for b in batches:
                told: dict[str, list] = {}
                for p, n, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    route, whole = route_of(p, split)
                    # a container above its route is told apart by its terms
                    for r, k, t in [(route, n, p)] if whole else ((r, 1, p + rest) for rest, _, _ in unpack(packed) for r, whole in [route_of(p + rest, split)] if whole):
                        x = told.setdefault(r, [0, t, t])
                        told[r] = [x[0] + k, min(x[1], t), max(x[2], t)]
                yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), *(pa.array([x[i] for x in told.values()], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))], ["r", "n", "low", "high"])

        found = parts.select("prefix", "n", "packed").mapInArrow(routes, "r string, n bigint, low string, high string").groupBy("r").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        fresh = found.where(F.col("n") > limit).collect()
        split = split | {r["r"]: len(os.path.commonprefix([r["low"], r["high"]])) for r in fresh}
    return split


def count_terms(rows: DataFrame, column: str, terms: str = "words") -> DataFrame:
    """(term string, occurrences bigint, records bigint) of every distinct term of a column.

    terms: ``words`` (the words of the text) or ``whole`` (the whole value in lower case, without white space at its
    ends). Null, empty and blank values hold no term; repeated rows count each time; long texts are read whole; other
    columns are not read. An empty table gives no terms.

    Each worker counts into a burst trie and sends its containers, keyed by prefix. How many terms stand below each
    prefix decides where prefixes are split, so that no route has more than a bounded share of the terms, however long
    the prefixes are that they share; containers that straddle a split are cut along it, all others go as they are, and
    each route grafts the matching subtrees of all workers onto one trie. A term that holds a third of all occurrences
    arrives once from each worker.
    """
    parts = cut(_partial_tries(rows, column, terms))
    total = parts.agg(F.sum("n")).first()[0] or 0
    split = _split_prefixes(parts, max(total // ROUTES, LEAST))

    def reroute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for prefix, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                route, whole = route_of(prefix, split)
                if whole:
                    out.append((route, prefix, packed))
                    continue
                parts: dict[str, dict[str, tuple[int, int]]] = {}
                for rest, occ, rec in unpack(packed):
                    own = route_of(prefix + rest, split)[0]
                    parts.setdefault(own, {})[(prefix + rest)[len(own) :]] = (occ, rec)
                out += [(r, r, pack(c)) for r, c in parts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())], ["route", "prefix", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
            for c in trie.containers():
                yield pa.RecordBatch.from_arrays([pa.array([c.prefix + rest for rest in c.counts], pa.string()), pa.array([x[0] for x in c.counts.values()], pa.int64()), pa.array([x[1] for x in c.counts.values()], pa.int64())], ["term", "occurrences", "records"])

        at, trie = None, BurstTrie()
        for b in batches:
            for route, prefix, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if route != at:
                    yield from out(trie)
                    at, trie = route, BurstTrie()
                trie.graft(prefix, unpack(packed))
        yield from out(trie)

    routed = parts.select("prefix", "packed").mapInArrow(reroute, "route string, prefix string, packed binary")
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(merge, "term string, occurrences bigint, records bigint")


def mark_terms(counted: DataFrame, n_rows: int, min_records: int | None, max_per_mille: int | None) -> DataFrame:
    """counted plus mark: rare (in fewer than min_records records), else common (in more than max_per_mille of a
    thousand of all n_rows rows), else null. A limit that is null marks nothing."""
    rare = F.when(F.col("records") < F.lit(min_records), "rare")
    return counted.withColumn("mark", rare.when(F.col("records") * 1000 > F.lit(max_per_mille) * F.lit(n_rows), "common"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {r["field"]: r for r in table(spark, sf_dir, "term_limits").where("field in ('text', 'headword')").collect()}
    out = []
    for field, name, terms in (("text", "genre_documents", "words"), ("headword", "lexicon_entries", "whole")):
        rows, limit = table(spark, sf_dir, name), limits.get(field)
        marked = mark_terms(count_terms(rows, field, terms), rows.count(), *((limit["min_records"], limit["max_per_mille"]) if limit else (None, None)))
        out.append(marked.select(F.lit(field).alias("field"), "term", "occurrences", "records", "mark"))
    return out[0].union(out[1])


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("field", "term", "mark")
