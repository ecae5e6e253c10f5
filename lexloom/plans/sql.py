"""Fragments of the DuckDB SQL that checks the queries."""

from __future__ import annotations

from lexloom.functions.text import CANTICLE_WORDS, EDGE, KNOWN_SECTIONS, KNOWN_VARIANTS, PRAYER_WORDS, SPACE

_EDGE = EDGE.replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    quoted = f"translate(lower(nfc_normalize({x})), '‘’`´–—―', '''''''''---')"
    return f"trim(regexp_replace({quoted}, '{SPACE}+', ' ', 'g'))"


def toks(x: str) -> str:
    bare = f"list_transform(string_split({norm(x)}, ' '), lambda t: regexp_replace(regexp_replace(t, '^{_EDGE}+', ''), '{_EDGE}+$', ''))"
    return f"list_filter({bare}, lambda t: t <> '')"


def heading(x: str) -> str:
    bare = f"regexp_replace({strip(x)}, '\\([^)]*\\)', '', 'g')"
    return f"(length({strip(x)}) >= 3 AND length(regexp_replace({bare}, '[^\\p{{L}}]', '', 'g')) >= 3 AND length(regexp_replace({bare}, '[^\\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace({bare}, '[^\\p{{L}}]', '', 'g')))"


def speaker(x: str) -> str:
    return f"nullif(regexp_extract({x}, '^(Pastor|Gimong|Amin)[\\t\\n\\x0b\\f\\r ]*:', 1), '')"


def unit_type(title: str, text: str, spk: str) -> str:
    t = f"upper({strip(f'coalesce({title}, {chr(39) * 2})')})"
    rules = [f"WHEN contains({t}, '{k}') OR contains('{k}', {t}) THEN '{v}'" for k, v in KNOWN_SECTIONS]
    rules.append(f"WHEN contains({text}, 'Cantaen ti Himno') THEN 'rubric'")
    rules += [f"WHEN contains({t}, '{w}') THEN 'canticle'" for w in CANTICLE_WORDS]
    rules += [f"WHEN contains({t}, '{w}') OR contains(substring(upper({text}), 1, 100), '{w}') THEN 'prayer'" for w in PRAYER_WORDS]
    return "CASE " + " ".join(rules) + f" WHEN {spk} = 'Amin' THEN 'canticle' ELSE 'liturgical_prose' END"


KNOWN = "known(old, modern) AS (VALUES " + ", ".join(f"('{o}', '{m}')" for o, m in KNOWN_VARIANTS.items()) + ")"

#: RE2 has no look-around: what is looked at is captured, and replaced twice where captures may overlap.
_TWICE = "regexp_replace(regexp_replace(w, '{p}', '{r}', 'g'), '{p}', '{r}', 'g')"
MODERN = [
    ("c_before_aou", "regexp_replace(w, 'c([aou])', 'k\\1', 'g')"),
    ("c_before_consonant", _TWICE.format(p="c([^aeiou\\s])", r="k\\1")),
    ("qu_before_ei", "regexp_replace(w, 'qu([ei])', 'k\\1', 'g')"),
    ("medial_c", _TWICE.format(p="([aeiou])c([aou])", r="\\1k\\2")),
    ("gu_before_ei", "regexp_replace(w, 'gu([ei])', 'g\\1', 'g')"),
    ("n_tilde", "replace(w, 'ñ', 'ny')"),
    ("final_c", "regexp_replace(w, '(.)c$', '\\1k')"),
]
OLD = [("k_before_aou", "regexp_replace(w, 'k([aou])', 'c\\1', 'g')"), ("k_before_ei", "regexp_replace(w, 'k([ei])', 'qu\\1', 'g')"), ("final_k", "regexp_replace(w, '(.)k$', '\\1c')")]


def candidates(types: str, modern: bool = True, old: bool = True) -> str:
    """SELECT w, rule, ord, candidate over a table types(w)."""
    out = [f"SELECT w, 'itself' AS rule, 0 AS ord, w AS candidate FROM {types}"]
    if modern:
        out.append(f"SELECT w, 'known', 1, modern FROM {types} JOIN known ON old = w")
        out += [f"SELECT w, '{n}', {i + 2}, {e} FROM {types} WHERE {e} <> w" for i, (n, e) in enumerate(MODERN)]
    if old:
        out.append(f"SELECT w, 'known', 20, old FROM {types} JOIN known ON modern = w")
        out += [f"SELECT w, '{n}', {21 + i}, {e} FROM {types} WHERE {e} <> w" for i, (n, e) in enumerate(OLD)]
    return " UNION ALL ".join(out)


#: Lines of all units, of raw_text where lines is null: lines(unit_key, unit_type, line_no, line).
LINES = "lines AS (SELECT unit_key, unit_type, i - 1 AS line_no, ls[i] AS line FROM (SELECT unit_key, unit_type, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT unit_key, unit_type, coalesce(lines, string_split(raw_text, chr(10))) AS ls FROM liturgical_units)))"
#: Token types of all unit lines.
TYPES = f"{LINES}, types AS (SELECT DISTINCT unnest({toks('line')}) AS w FROM lines)"
#: The whole lexicon: the house list and the entries, by (tier, ord).
LEX = """lex AS (SELECT lower(trim(word)) AS headword, 'house_list' AS source, lower(trim(normalized_ilocano)) AS normalised_form, upos_tag AS pos, english_translation AS gloss, number::BIGINT AS ord, 0 AS tier FROM house_lexicon WHERE lower(trim(word)) NOT IN ('', 'nan')
 UNION ALL SELECT lower(trim(headword)), source, lower(trim(normalised_form)), pos, gloss, entry_id, 1 FROM lexicon_entries WHERE lower(trim(headword)) NOT IN ('', 'nan'))"""
LEX_KEYS = "keys AS (SELECT DISTINCT headword AS key, 0 AS kind FROM lex UNION SELECT DISTINCT normalised_form, 1 FROM lex WHERE normalised_form <> '')"
CASCADE = f"cand AS ({candidates('types')}), best AS (SELECT w, min(ord * 2 + kind) AS priority FROM cand JOIN keys ON candidate = key GROUP BY w), found AS (SELECT types.w, priority FROM types LEFT JOIN best ON types.w = best.w)"
UNIT_TEXT = "coalesce(array_to_string(lines, chr(10)), raw_text)"
