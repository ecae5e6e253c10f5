"""Text normalisation, tokens and spelling variants as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, spelled out so that Java and RE2 agree.
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What a token keeps at its ends.
EDGE = r"[^\p{L}\p{N}_'-]"

#: Old spellings and the modern form of each.
KNOWN_VARIANTS = {
    "cararag": "kararag", "caasi": "kaasi", "cuna": "kuna", "cadagiti": "kadagiti", "cadatayo": "kadatayo", "cadacayo": "kadakayo", "cadacami": "kadakami", "cadacuada": "kadakuada",
    "cas": "kas", "casta": "kasta", "coma": "koma", "canayon": "kanayon", "caniac": "kaniak", "cantaen": "kantaen", "canenyo": "kanenyo", "cangatoan": "kangatoan",
    "comulgar": "komulgar", "copa": "kopa", "calpasan": "kalpasan", "cucuam": "kukuam", "cuam": "kuam", "cunana": "kunana", "cuncunana": "kunkunana", "cunaen": "kunaen",
    "cunaenmi": "kunaenmi", "caanoman": "kaanoman", "caasiannacami": "kaasiannakami", "caasyannac": "kaasiannak", "cabaelanmi": "kabaelanmi", "cabusormi": "kabusormi", "cadi": "kadi", "cayatmo": "kayatmo",
    "cayo": "kayo", "collect": "kollek", "creda": "kreda", "cristiana": "kristiana", "cristo": "kristo", "cruz": "krus", "cuaresma": "kuaresma", "cuma": "kuma",
    "dacami": "dakami", "dacayo": "dakayo", "siac": "siak", "bagic": "bagik", "ipudnoc": "ipudnok", "basbasolco": "basbasolko", "lablabsingco": "lablabsingko", "apoc": "apok",
    "rebbengco": "rebbengko", "kinunac": "kinunak", "bigbigec": "bigbigek", "dawatec": "dawatek", "saadco": "saadko", "paglabsingac": "paglabsingak", "ipacdaarco": "ipakdaarko", "panaglagidingitco": "panaglagidingitko",
}

#: The rules old -> modern, each applied to the word itself: (name, Java pattern, replacement).
MODERN_RULES = (
    ("c_before_aou", "c(?=[aou])", "k"),
    ("c_before_consonant", r"c(?=[^aeiou\s])", "k"),
    ("qu_before_ei", "qu(?=[ei])", "k"),
    ("medial_c", "(?<=[aeiou])c(?=[aou])", "k"),
    ("gu_before_ei", "gu(?=[ei])", "g"),
    ("n_tilde", "ñ", "ny"),
    ("final_c", "(?<=.)c$", "k"),
)
#: The rules modern -> old.
OLD_RULES = (("k_before_aou", "k(?=[aou])", "c"), ("k_before_ei", "k(?=[ei])", "qu"), ("final_k", "(?<=.)k$", "c"))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: A value without any of these characters is NFC as it is: none of them combines with another or stands for another.
_NOT_PLAIN = r"[\x{300}-\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{3000}-\x{10ffff}]"


def nfc(c: Column) -> Column:
    """NFC. Spark has no such function. Python is handed only the values that may need it, nulls for all others, since a
    Python function under a condition runs for every row."""
    odd = c.rlike(_NOT_PLAIN)
    return F.when(odd, _nfc(F.when(odd, c))).otherwise(c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalise(c: Column) -> Column:
    """NFC, lower case, straight quotes, plain hyphens, single spaces, no space at the ends. Punctuation stays."""
    quoted = F.translate(F.lower(nfc(c)), "‘’`´–—―", "''''---")
    return F.trim(F.regexp_replace(quoted, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Array of tokens: the normalised text split at spaces, without outer punctuation; empty for a blank text."""
    return split_tokens(normalise(c))


def split_tokens(normalised: Column) -> Column:
    """The tokens of a text that is normalised already."""
    return F.filter(F.transform(F.split(normalised, " "), bare), lambda x: x != "")


def bare(word: Column) -> Column:
    """A word of a normalised text without outer punctuation."""
    return F.regexp_replace(F.regexp_replace(word, f"^{EDGE}+", ""), f"{EDGE}+$", "")


def whitespace_tokens(c: Column) -> Column:
    """How many pieces white space leaves."""
    return F.size(F.filter(F.split(c, f"{SPACE}+"), lambda x: x != ""))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def modern_candidates(word: Column) -> Column:
    """Array of (rule, ord, candidate): the word itself (ord 0), its known modern form, and each rule's outcome where it
    differs. Rules are applied to the word, not to one another's outcome."""
    found = [F.struct(F.lit("itself").alias("rule"), F.lit(0).alias("ord"), word.alias("candidate")), F.struct(F.lit("known").alias("rule"), F.lit(1).alias("ord"), F.try_element_at(_map(KNOWN_VARIANTS), word).alias("candidate"))]
    for i, (name, pattern, by) in enumerate(MODERN_RULES):
        found.append(F.struct(F.lit(name).alias("rule"), F.lit(i + 2).alias("ord"), F.regexp_replace(word, pattern, by).alias("candidate")))
    return F.filter(F.array(*found), lambda x: x["candidate"].isNotNull() & ((x["ord"] == 0) | (x["candidate"] != word)))


def old_candidates(word: Column) -> Column:
    """Array of (rule, ord, candidate), modern -> old; ord goes on behind the modern ones."""
    found = [F.struct(F.lit("itself").alias("rule"), F.lit(0).alias("ord"), word.alias("candidate")), F.struct(F.lit("known").alias("rule"), F.lit(20).alias("ord"), F.try_element_at(_map({m: o for o, m in KNOWN_VARIANTS.items()}), word).alias("candidate"))]
    for i, (name, pattern, by) in enumerate(OLD_RULES):
        found.append(F.struct(F.lit(name).alias("rule"), F.lit(21 + i).alias("ord"), F.regexp_replace(word, pattern, by).alias("candidate")))
    return F.filter(F.array(*found), lambda x: x["candidate"].isNotNull() & ((x["ord"] == 0) | (x["candidate"] != word)))


def is_heading(line: Column) -> Column:
    """A line of capitals: at least 3 characters, and without what stands in parentheses at least 3 letters, 80 % of
    them upper case."""
    bare = F.regexp_replace(stripped(line), r"\([^)]*\)", "")
    letters, upper = F.length(F.regexp_replace(bare, r"[^\p{L}]", "")), F.length(F.regexp_replace(bare, r"[^\p{Lu}]", ""))
    return (F.length(stripped(line)) >= 3) & (letters >= 3) & (upper >= 0.8 * letters)


def speaker_of(line: Column) -> Column:
    """The speaker that a line begins with, or null."""
    return F.nullif(F.regexp_extract(line, r"^(Pastor|Gimong|Amin)[\t\n\x0b\f\r ]*:", 1), F.lit(""))


#: Known section titles and their types, in the order of the rules.
KNOWN_SECTIONS = (
    ("URNOS TI PANAGDAYDAYAW", "liturgical_prose"), ("GLORIA PATRI", "canticle"), ("TI KYRIE", "canticle"), ("TI GLORIA EXCELSIS", "canticle"), ("TI INTROITA", "rubric"), ("CREDA NICIA", "prayer"), ("TI SERMON", "rubric"),
    ("URNOS TI CEREMONIA TI COMULGAR", "liturgical_prose"), ("TI CARARAG NGA AMAMI", "prayer"), ("TI PAX DOMINI", "liturgical_prose"), ("TI AGNUS DEI", "canticle"), ("TI PANAGIWARAS", "liturgical_prose"), ("TI NUNC DIMITTIS", "canticle"), ("TI PAMMENDICION", "liturgical_prose"),
)
#: Words of titles and beginnings that tell a canticle or a prayer.
CANTICLE_WORDS = ("GLORIA", "KYRIE", "AGNUS", "NUNC", "DIMITTIS", "SANTO, SANTO")
PRAYER_WORDS = ("CREDA", "CARARAG", "AMAMI", "MAMATIAC")


def unit_type(title: Column, text: Column, speaker: Column) -> Column:
    """The type of a unit by ordered rules: a known section in the title or the title in one, a hymn reference, words of
    the title, words at the beginning of the text, the speaker; else prose. A null title counts as an empty one, which
    every known section contains."""
    t = F.upper(stripped(F.coalesce(title, F.lit(""))))
    rule = None
    for known, kind in KNOWN_SECTIONS:
        hit = t.contains(known) | F.lit(known).contains(t)
        rule = F.when(hit, kind) if rule is None else rule.when(hit, kind)
    rule = rule.when(text.contains("Cantaen ti Himno"), "rubric")
    for w in CANTICLE_WORDS:
        rule = rule.when(t.contains(w), "canticle")
    head = F.substring(F.upper(text), 1, 100)
    for w in PRAYER_WORDS:
        rule = rule.when(t.contains(w) | head.contains(w), "prayer")
    return rule.when(speaker == "Amin", "canticle").otherwise("liturgical_prose")
