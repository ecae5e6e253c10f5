"""Words of a text as 64-bit hashes, in whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex
import xxhash

#: A character that stays at the end of a word.
KEPT = regex.compile(r"[\p{L}\p{M}\p{N}_'\-]")
#: Pieces remembered per worker; beyond it the memory is emptied and filled again, so it is bounded.
REMEMBERED = 500_000

U = np.uint64


def strip_word(piece: str) -> str:
    """Drops what is no letter, mark, digit, ``_``, ``'`` or ``-`` from both ends. Takes time linear in the piece."""
    if piece.isalnum():
        return piece
    first = KEPT.search(piece)
    if first is None:
        return ""
    return piece[first.start() : len(piece) - KEPT.search(piece[::-1]).start()]


def words_of(text: str | None) -> list[str]:
    """The words of a text; none for a null text."""
    return [w for p in (text or "").lower().split() if (w := strip_word(p))]


class PieceHash(dict):
    """White-space piece -> 64-bit hash of its word, 0 where no word is left."""

    def __missing__(self, piece: str) -> int:
        word = strip_word(piece)
        h = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = h
        return h


def word_hashes(texts: Iterable[str | None], pieces: PieceHash) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, text index of each word)."""
    flat: list[int] = []
    counts: list[int] = []
    get, extend = pieces.__getitem__, flat.extend
    for t in texts:
        if t is None:
            counts.append(0)
            continue
        ps = t.lower().split()
        extend(map(get, ps))
        counts.append(len(ps))
    h = np.array(flat, dtype=U)
    at = np.repeat(np.arange(len(counts)), counts)
    keep = h != 0
    return h[keep], at[keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))
