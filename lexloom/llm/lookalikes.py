"""Problem 3: text that looks right but is built from other characters, brought to one form with vocabulary tries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.term_counts import count_terms
from lexloom.llm.words import strip_word
from lexloom.operators.skew import join_by_size
from lexloom.session import cut, table

#: Letters of other alphabets that look like a Latin letter, most likely reading first.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "li", "к": "k",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "Il", "Ј": "J", "Ӏ": "Il", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "uv", "ϲ": "c", "ϳ": "j", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o", "ѵ": "v", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}
#: Forms of ordinary characters that compatibility normalisation names: ranges of code points.
FORMS = ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0x2100, 0x214F), (0x24B6, 0x24E9), (0x1F130, 0x1F149))
#: Signs of the script ranges above that are signs of their own.
OWN_SIGNS = "℃℉№℠™℡℻℀℁℅℆Ω"
#: A row without any of these characters is ordinary as it stands.
UNUSUAL = r"[^\t\n\r\x20-\x7E¡-¬®-İĲ-žƀ-ɏḀ-ỿ‐-‧‰-⁞]"
#: Letters that one look-alike may stand for share a class, so that a term and all its readings have one route.
READINGS = str.maketrans({"v": "u", "l": "i"})
#: The automaton's budget of edits, for terms of at least so many letters; the routes hold for one edit.
BUDGET, LEAST_LETTERS = 1, 4
_ODD, _CONTROL, _SPACES = re.compile(UNUSUAL), re.compile("[\x00-\x08\x0e-\x1b\x7f]"), re.compile(r"[^\S \t\n\r]")


@lru_cache(maxsize=65536)
def readings(ch: str) -> tuple[str, ...] | None:
    """What a character may stand for, most likely first; ('',) if it isn't seen; None if it is ordinary."""
    o = ord(ch)
    if 0x20 <= o < 0x7F or ch in "\t\n\r":
        return None
    if ch in LOOKALIKES:
        return tuple(LOOKALIKES[ch])
    kind = unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp"):
        return (" ",)
    if kind == "Cc":
        return (" ",) if ch.isspace() else ("",)
    if (kind == "Cf" and not (0x600 <= o <= 0x8FF or o == 0x110BD)) or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return ("",)
    if any(a <= o <= b for a, b in FORMS) and ch not in OWN_SIGNS:
        plain = unicodedata.normalize("NFKC", ch)
        return (plain,) if plain != ch and plain.isascii() else None
    return None


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0]


def _foreign(piece: str) -> bool:
    """A word wholly in Greek or in Cyrillic."""
    scripts = {_script(c) for c in piece if c.isalpha()}
    return scripts in ({"GREEK"}, {"CYRILLIC"})


def slots(piece: str) -> list[tuple[tuple[str, ...], bool]]:
    """For every character that is seen: (its readings, whether it is a variant). An accent apart joins its letter."""
    foreign, out = _foreign(piece), []
    for i, ch in enumerate(piece):
        r = None if foreign and ch.isalpha() and _script(ch) in ("GREEK", "CYRILLIC") else readings(ch)
        if r == ("",) and ch in "‌‍" and 0 < i < len(piece) - 1 and all(not c.isascii() and _script(c) != "LATIN" and readings(c) is None for c in (piece[i - 1], piece[i + 1])):
            r = None  # joins letters or signs of scripts that need it
        if unicodedata.category(ch) == "Mn" and out and any(x[-1:].isalpha() and (_script(x[-1]) == "LATIN" or foreign) for x in out[-1][0]):
            out[-1] = (tuple(unicodedata.normalize("NFC", x + ch) for x in out[-1][0]), True)
        else:
            out.append(((ch,) if r is None else r, r is not None))
    return out


def is_variant(piece: str) -> bool:
    """Whether a piece of text holds a character that stands for another, isn't seen, or is an accent apart."""
    return not piece.isascii() and any(v for _, v in slots(piece)) or any(c < " " and c not in "\t\n\r" or c == "\x7f" for c in piece)


def by_table(piece: str) -> str:
    """The piece with every variant replaced by its most likely reading."""
    return unicodedata.normalize("NFC", "".join(r[0] for r, _ in slots(piece)))


class VocabularyTrie:
    """Words with their records, one level a letter."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, records: int) -> None:
        at = self.root
        for ch in word:
            at = at.setdefault(ch, {})
        at[""] = (records, word)

    def canonical(self, term: str, budget: int = 0) -> tuple[int, int, int, str, str] | None:
        """(cost, -records, rank, word, reading) of the vocabulary word that the term can be read as at the least cost up
        to budget, then of most records, then with the likeliest readings.

        A weighted edit automaton runs down the trie: a character matches any of its readings, and one that isn't seen
        matches nothing, at no cost (rank counts how unlikely the readings are); replacing, dropping or adding a letter
        costs 1. reading is the term in the letters that the way through the trie chose: it is the word itself at cost
        0; beyond that the word only decides between readings, and no other letter of the term is changed.
        """
        parts = [r for r, _ in slots(term)]
        states, best = {(id(self.root), 0): (0, 0, "", self.root)}, None
        for i in range(len(parts) + 1):
            reached: dict = {}
            todo = list(states.values())
            while todo:
                cost, rank, read, node = todo.pop()
                if cost < budget:  # a letter that the term lacks
                    for ch, kid in node.items():
                        if ch and ((key := (id(kid), i)) not in states or (cost + 1, rank, read) < states[key][:3]):
                            states[key] = (cost + 1, rank, read, kid)
                            todo.append(states[key])
                if i == len(parts):
                    if "" in node:
                        found = (cost, -node[""][0], rank, node[""][1], read)
                        best = found if best is None or found < best else best
                    continue
                ways = []
                for k, r in enumerate(parts[i]):
                    plain = r.lower()
                    if (kid := self._walk(node, plain)) is not None:
                        ways.append((cost, rank + k, read + plain, kid))
                    if cost < budget:
                        ways += [(cost + 1, rank + k, read + plain, kid) for kid in [node, *(x for ch, x in node.items() if ch)]]
                for way in ways:
                    key = (id(way[3]), i + 1)
                    if key not in reached or way[:3] < reached[key][:3]:
                        reached[key] = way
            states = reached
        return best

    @staticmethod
    def _walk(node: dict, letters: str) -> dict | None:
        for ch in letters:
            node = node.get(ch)
            if node is None:
                return None
        return node


def _route(half: str, size: int, letters: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{half}{size}:{letters}".encode("utf-8", "surrogatepass")) - 2**63


def word_routes(word: str) -> list[int]:
    """Where a vocabulary word stands: by its first and by its last half, in classes of letters."""
    w = word.translate(READINGS)
    n, h = len(w), len(w) // 2
    return [_route("first", n, w[:h]), _route("last", n, w[h:])]


def asked_routes(plain: str) -> list[int]:
    """Where a term, in its likeliest reading, finds all words within one edit: an edit leaves one half as it is."""
    w, n = plain.translate(READINGS), len(plain)
    out = []
    for size in (n - 1, n, n + 1):
        if size > 0:
            h = size // 2
            out += [_route("first", size, w[:h]), _route("last", size, w[-(size - h) :])]
    return out


def spell(piece: str, reading: str | None) -> tuple[str, bool]:
    """(the piece in ordinary characters, whether it took one of another kind): its core by the reading that the tries
    gave, else by table, what stands around it by table."""
    if piece.isspace():
        return " ", True
    core = strip_word(piece)
    before, _, after = piece.partition(core) if core else (piece, "", "")
    plain = by_table(core)
    if reading is not None and reading != plain.lower():
        plain = "".join(b.upper() if a.isupper() else b for a, b in zip(plain, reading, strict=True)) if len(reading) == len(plain) else reading.upper() if plain.isupper() else reading.capitalize() if plain[:1].isupper() else reading
    return by_table(before) + plain + by_table(after), is_variant(piece)


def spellings(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pieces (piece, n), vocabulary (term, records) -> (piece, n, plain, affected) of every piece.

    Words and pieces meet in routes (half words), where the automaton takes each piece down the trie of the words there;
    the best of all its routes is its canonical spelling. A piece is affected if its way to the spelling took a
    character at no cost; one that no word is near takes the table.
    """

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, t, n) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not is_variant(t) for r in word_routes(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int64())], ["route", "kind", "text", "n"])

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, p) for p in b.column(0).to_pylist() if (core := strip_word(p)) for r in asked_routes(by_table(core).lower())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([x[1] for x in rows], pa.string()), pa.array([0] * len(rows), pa.int64())], ["route", "kind", "text", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, asked, trie = None, [], VocabularyTrie()

        def out() -> list[tuple]:
            if not trie.root:
                return []
            found = []
            for p in asked:
                core = strip_word(p)
                best = trie.canonical(core, BUDGET if len(core) >= LEAST_LETTERS else 0)
                if best is not None:
                    found.append((p, *best))
            return found

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = {"piece": pa.string(), "cost": pa.int32(), "less": pa.int64(), "rank": pa.int32(), "word": pa.string(), "reading": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

        for b in batches:
            rows = []
            for r, kind, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != route:
                    rows += out()
                    route, asked, trie = r, [], VocabularyTrie()
                if kind == 0:
                    asked.append(t)
                elif asked:  # pieces come before words, so words of routes that nothing asks for are passed over
                    trie.add(t, n)
            yield batch(rows)
        yield batch(out())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [spell(p, r) for p, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.bool_())], ["piece", "n", "plain", "affected"])

    schema = "route bigint, kind int, text string, n bigint"
    asked = pieces.select("piece").mapInArrow(of_pieces, schema)
    words = vocabulary.select("term", "records").mapInArrow(of_words, schema).join(asked.select("route").distinct(), "route", "left_semi")
    met = asked.unionByName(words.select("route", "kind", "text", "n"))
    found = met.repartition("route").sortWithinPartitions("route", "kind").mapInArrow(match, "piece string, cost int, less bigint, rank int, word string, reading string")
    best = found.groupBy("piece").agg(F.min(F.struct("cost", "less", "rank", "word", "reading")).alias("x"))
    return pieces.join(best, "piece", "left").select("piece", "n", F.col("x.reading").alias("reading")).mapInArrow(finish, "piece string, n bigint, plain string, affected boolean")


def _odd_pieces(text: str) -> set[str]:
    """The white-space pieces of a text with an unusual character, and its unusual spaces."""
    return {p for p in text.split() if not p.isascii() and _ODD.search(p) or _CONTROL.search(p)} | set(_SPACES.findall(text))


def rewrite(text: str, plain: dict[str, str]) -> str:
    """The text with every piece replaced that plain has. Ordinary spaces and line breaks stay."""
    return "".join(_SPACES.sub(lambda m: plain.get(m[0], " "), part) if part.isspace() else plain.get(part, part) for part in re.split(r"(\s+)", text))


def _asked(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, h, piece) of all rows with an unusual piece, cut, and (piece, n, plain, affected) of the pieces, cut.

    h is a hash of the text, so that rows of one key, or without a key, are told apart."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(k, p) for k, t in enumerate(b.column(2).to_pylist()) for p in _odd_pieces(t)]
            which = pa.array([k for k, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array([p for _, p in pairs], pa.string())], ["row_id", "h", "piece"])

    asked = cut(rows.where(F.col("t").rlike(UNUSUAL)).select("row_id", F.xxhash64("t").alias("h"), "t").mapInArrow(ask, f"row_id {kind}, h bigint, piece string"))
    pieces = cut(asked.groupBy("piece").agg(F.count("*").alias("n")))
    return asked, cut(spellings(pieces, count_terms(rows, "t")))


def _answers(asked: DataFrame, spelled: DataFrame) -> DataFrame:
    """(row_id, h, piece, plain) of the affected pieces; one that stands in a third of all rows is salted."""
    told = spelled.where("affected")
    return join_by_size(asked, told, ["piece"], "n", told.agg(F.sum("n")).first()[0] or 0).select("row_id", "h", "piece", "plain")


def affected_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id): the rows whose text is built from other characters, once a key; see canonical_texts."""
    kind = rows.schema[key].dataType.simpleString()
    return _answers(*_asked(rows.select(F.col(key).alias("row_id"), F.col(text).alias("t")), kind)).select("row_id").distinct()


def canonical_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, plain, affected): every row's text in its ordinary form, and whether it was built from other characters.

    The vocabulary is every word of the column that has no variant; a word with variants takes the vocabulary word that
    it can be read as at no cost; one that no word equals takes the readings that lead to a word one edit away, and else
    the most likely reading of each character. Null stays null and empty stays empty, both unaffected; repeated rows
    come out each, null keys too; long texts are rewritten whole; other columns are ignored; an empty table gives an
    empty one. Words wholly in Greek or Cyrillic are ordinary.

    Only rows with an unusual character (one JVM pattern) reach Python, and only their unusual pieces are joined.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(key).alias("row_id"), F.col(text).alias("t"))
    by_row = _answers(*_asked(rows, kind)).groupBy("row_id", "h").agg(F.collect_set(F.struct("piece", "plain")).alias("x"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [t if a is None else rewrite(t, dict(zip(a, c, strict=True))) for t, a, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string()), pa.array([x is not None for x in b.column(2).to_pylist()], pa.bool_())], ["row_id", "plain", "affected"])

    r, x = rows.withColumn("h", F.xxhash64("t")).alias("r"), by_row.alias("x")
    told = r.join(x, F.col("r.row_id").eqNullSafe(F.col("x.row_id")) & (F.col("r.h") == F.col("x.h")), "left").select("r.row_id", "r.t", F.col("x.x.piece").alias("a"), F.col("x.x.plain").alias("c"))
    return told.where("a is not null").mapInArrow(write, f"row_id {kind}, plain string, affected boolean").union(told.where("a is null").select("row_id", F.col("t").alias("plain"), F.lit(False)))


_TABLES = (("genre_documents", "gdoc_key", "text"), ("lexicon_entries", "entry_id", "headword"))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both columns in one form, row by row."""
    a, b = (canonical_texts(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("tab"), "row_id", "plain", "affected") for name, key, text in _TABLES)
    return a.union(b)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (affected_rows(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("tab"), "row_id") for name, key, text in _TABLES)
    return a.union(b)
