"""Problem 7: token ids of a public byte-level BPE vocabulary, merged in length-bucketed numpy matrices."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import spread, table

#: The public tokenizer's file; a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how byte-level BPE splits a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per worker, and the bytes from which a piece is merged in a matrix of its own.
REMEMBERED, LONG = 300_000, 256
NO_RANK = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: printable Latin-1 bytes stand for themselves, the
    others for the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Pairs of ids -> (rank, merged id), in an open-addressing hash table of numpy arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in _byte_letters().items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.rank, self.merged = np.full(size, 2**64 - 1, np.uint64), np.full(size, NO_RANK), np.zeros(size, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):  # every round the first of each free slot takes it, the others move on
            self.probes += 1
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[todo], return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            t = todo[take]
            self.keys[at[t]], self.rank[at[t]], self.merged[at[t]] = key[t], t, merged[t]
            todo = todo[~take]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, merged ids) of pairs; NO_RANK where the pair isn't merged. A negative id is padding."""
        shape = a.shape
        key = ((a.astype(np.int64) << 32) | b.astype(np.int64)).view(np.uint64).ravel()
        rank, merged = np.full(len(key), NO_RANK), np.zeros(len(key), np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(key[todo])
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(todo):
                break
        return rank.reshape(shape), merged.reshape(shape)

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a padded matrix (padding -1). Every round each row merges its leftmost pair of least
        rank and is closed up by one column; rows without a pair leave the matrix."""
        out: list = [None] * len(ids)
        row = np.arange(len(ids))
        rank, merged = self.look_up(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), int)
            live = rank[np.arange(len(row)), best] != NO_RANK if rank.shape[1] else np.zeros(len(row), bool)
            for r, i in zip(row[~live].tolist(), ids[~live], strict=True):
                out[r] = i[i >= 0]
            row, ids, rank, merged, best = row[live], ids[live], rank[live], merged[live], best[live]
            if not len(row):
                break
            n = np.arange(len(row))
            ids[n, best] = merged[n, best]
            keep = np.ones(ids.shape, bool)
            keep[n, best + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, bool)
            keep[n, best] = False
            rank, merged = rank[keep].reshape(len(row), -1), merged[keep].reshape(len(row), -1)
            if rank.shape[1]:
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < rank.shape[1])
                    r, c = n[ok], side[ok]
                    rank[r, c], merged[r, c] = self.look_up(ids[r, c], ids[r, c + 1])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The ids of one long piece. A round merges all places of the least pair, from the left without overlap: until
        they are merged no other pair can have a lower rank, as what is merged has only higher ones."""
        rank, merged = self.look_up(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NO_RANK:
            at = np.flatnonzero(rank == low)
            run = np.cumsum(np.concatenate(([1], np.diff(at) != 1)))
            first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            ids[at] = merged[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            near = np.zeros(len(keep), bool)
            near[at] = True
            near = np.flatnonzero(near[keep])
            fixed, fixed_ids = np.full(len(ids) - 1, NO_RANK), np.zeros(len(ids) - 1, np.int32)
            if len(ids) > 1:
                fixed, fixed_ids = rank[keep[:-1]][: len(ids) - 1], merged[keep[:-1]][: len(ids) - 1]
                todo = np.unique(np.concatenate([near, near - 1]))
                todo = todo[(todo >= 0) & (todo < len(ids) - 1)]
                if len(fixed) < len(ids) - 1:
                    fixed, fixed_ids = np.append(fixed, NO_RANK), np.append(fixed_ids, np.int32(0))
                    todo = np.unique(np.append(todo, len(ids) - 2))
                fixed[todo], fixed_ids[todo] = self.look_up(ids[todo], ids[todo + 1])
            rank, merged = fixed, fixed_ids
        return ids

    def pieces(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Pieces of a power-of-two range of lengths share a matrix."""
        out: list = [None] * len(texts)
        buckets = defaultdict(list)
        for i, t in enumerate(texts):
            buckets[len(t) if len(t) <= 16 else 1 << (len(t) - 1).bit_length()].append(i)
        for width, members in buckets.items():
            if width > LONG:
                for i in members:
                    out[i] = self.merge_long(self.of_byte[np.frombuffer(texts[i], np.uint8)])
                continue
            lengths = np.array([len(texts[i]) for i in members])
            ids = np.full((len(members), width), -1, np.int32)
            ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(texts[i] for i in members), np.uint8)]
            for i, x in zip(members, self.merge_matrix(ids), strict=True):
                out[i] = x
        return out


def encode(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row: its text's token ids, without special tokens (their names are plain text).

    A null and an empty text have the empty list; a blank text has its ids. Repeated rows come out each; long texts and
    long pieces are encoded whole; other columns are ignored; an empty table gives an empty one. The vocabulary (under
    2 MB, whatever the data) is read by the driver and broadcast. No shuffle: each worker merges each distinct piece
    once, as far as it remembers it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(MergeTable(vocabulary))
    keyed = rows.select(F.col(key), F.col(text).alias("t"))
    kind = keyed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, merges, memory = regex.compile(SPLIT), shared.value, {}
        for b in batches:
            found = [split.findall(t) if t else () for t in b.column(1).to_pylist()]
            if len(memory) > REMEMBERED:
                memory = {}
            new = [p for p in set(chain.from_iterable(found)) if p not in memory]
            for p, ids in zip(new, merges.pieces([p.encode() for p in new]), strict=True):
                memory[p] = ids.tolist()
            get = memory.__getitem__
            lists = [list(chain.from_iterable(map(get, ps))) for ps in found]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return keyed.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
