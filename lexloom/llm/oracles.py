"""DuckDB SQL with the rows of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from lexloom.plans.sql import SPACE, UNIT_TEXT, strip

_OUTER = r"[^\p{L}\p{M}\p{N}_''-]+"


def words(x: str) -> str:
    bare = f"list_transform(regexp_split_to_array(lower({x}), '{SPACE}+'), lambda t: regexp_replace(regexp_replace(t, '^{_OUTER}', ''), '{_OUTER}$', ''))"
    return f"list_filter({bare}, lambda t: t <> '')"


# Problem 1
_TERMS = f"""each AS (SELECT 'text' AS field, gdoc_key AS k, unnest({words('text')}) AS term FROM genre_documents WHERE text IS NOT NULL
 UNION ALL SELECT 'headword', entry_id, {strip('lower(headword)')} FROM lexicon_entries WHERE {strip('lower(headword)')} <> ''),
 counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT k) AS records FROM each GROUP BY field, term),
 sizes AS (SELECT 'text' AS field, count(*) AS n FROM genre_documents UNION ALL SELECT 'headword', count(*) FROM lexicon_entries),
 marked AS (SELECT field, term, occurrences, records, CASE WHEN records < min_records THEN 'rare' WHEN records * 1000 > max_per_mille * n THEN 'common' END AS mark FROM counted JOIN sizes USING (field) LEFT JOIN term_limits USING (field))"""

# Problem 2
_BARE = SPACE[:-1] + r"\p{P}]+"
_SAME = " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE length(regexp_replace({f}, '{_BARE}', '', 'g')) || '=' || lower(regexp_replace({f}, '{_BARE}', '', 'g')) END" for f in ("headword", "normalised_form", "source"))
_ENTRIES = f"""entries AS (SELECT entry_id, headword, normalised_form, source FROM lexicon_entries UNION ALL SELECT entry_id, json_extract_string(payload, '$.headword'), json_extract_string(payload, '$.normalised_form'), json_extract_string(payload, '$.source') FROM lexicon_raw),
 keyed AS (SELECT *, {_SAME} AS k FROM entries), classed AS (SELECT *, min(entry_id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS copies FROM keyed)"""

# Problems 4 and 6
_GRAMS = f"""worded AS (SELECT tab, key, side, split, by_, {words('text')} AS ws FROM texts WHERE text IS NOT NULL),
 gram AS (SELECT tab, key, side, len(ws) - 1 AS total, g, count(*) AS c FROM (SELECT tab, key, side, ws, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM worded WHERE len(ws) >= 20)) GROUP BY ALL)"""


def _pairs(where: str) -> str:
    return f"SELECT a.tab AS tab, a.key AS a, b.key AS b FROM gram a JOIN gram b ON a.tab = b.tab AND a.g = b.g AND {where} GROUP BY a.tab, a.key, b.key, a.total, b.total HAVING sum(least(a.c, b.c)) >= 0.6 * greatest(a.total, b.total)"


_SIDES = "CASE WHEN split = 'train' THEN 1 WHEN split IN ('validation', 'test') THEN 2 END"
_SPLIT = f"""texts AS (SELECT 'genre_documents' AS tab, gdoc_key AS key, {_SIDES} AS side, split, source AS by_, text FROM genre_documents UNION ALL SELECT 'liturgical_units', unit_key, {_SIDES}, split, unit_type, {UNIT_TEXT} FROM liturgical_units),
 {_GRAMS}, crossed AS ({_pairs('a.side = 1 AND b.side = 2')})"""
_UNITS = f"texts AS (SELECT 'u' AS tab, unit_key AS key, 3 AS side, NULL AS split, NULL AS by_, {UNIT_TEXT} AS text FROM liturgical_units), {_GRAMS}, near AS ({_pairs('a.key < b.key')})"

# Problem 5: components over the tie values, by their closure
_TIED = """tie AS (SELECT gdoc_key, CASE WHEN unit_id IS NOT NULL THEN 'u' || unit_id END AS u, CASE WHEN genre <> '' AND source <> '' THEN 's' || genre || ':' || source END AS s FROM genre_documents),
 edge AS (SELECT DISTINCT u AS a, s AS b FROM tie WHERE u IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT s, u FROM tie WHERE u IS NOT NULL AND s IS NOT NULL),
 reach AS (SELECT DISTINCT v AS v, v AS w FROM (SELECT u AS v FROM tie UNION SELECT s FROM tie) WHERE v IS NOT NULL UNION SELECT reach.v, edge.b FROM reach JOIN edge ON reach.w = edge.a),
 root AS (SELECT v, min(w) AS r FROM reach GROUP BY v),
 grouped AS (SELECT gdoc_key, min(gdoc_key) OVER (PARTITION BY coalesce(r, 'k' || gdoc_key)) AS group_key FROM tie LEFT JOIN root ON v = coalesce(u, s))"""

# Problem 8
_RUNS = f"""iw AS (SELECT item_id, {words('text')} AS ws FROM eval_passages WHERE text IS NOT NULL), dw AS (SELECT doc_id, {words('text')} AS ws FROM documents WHERE text IS NOT NULL),
 ir AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS r FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM iw WHERE len(ws) >= 8)),
 dr AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS r FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM dw WHERE len(ws) >= 8)),
 leak AS (SELECT DISTINCT item_id, doc_id FROM ir JOIN dr USING (r))"""

_LONGEST = """leak_words AS (SELECT item_id, doc_id, i, j, j - i AS shift FROM leak JOIN (SELECT item_id, i, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM iw)) USING (item_id) JOIN (SELECT doc_id, j, ws[j] AS w2 FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM dw WHERE doc_id IN (SELECT doc_id FROM leak))) USING (doc_id) WHERE w = w2),
 run AS (SELECT item_id, doc_id, count(*) AS n, min(j) - 1 AS doc_at, min(i) - 1 AS item_at FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, doc_id, shift ORDER BY i) AS g FROM leak_words) GROUP BY item_id, doc_id, shift, g)"""

ORACLES: dict[str, str] = {
    "p1_terms": f"WITH {_TERMS} SELECT field, term, occurrences, records, mark FROM marked",
    "p1_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_found": f"WITH {_ENTRIES} SELECT first AS id_a, entry_id AS id_b FROM classed WHERE entry_id <> first",
    "p2_entries": f"WITH {_ENTRIES} SELECT entry_id, headword, normalised_form, source, copies FROM classed WHERE entry_id = first",
    "p4_found": f"WITH {_SPLIT} SELECT tab, least(a, b) AS key_a, greatest(a, b) AS key_b FROM crossed",
    "p4_report": f"WITH {_SPLIT}, n AS (SELECT tab, b AS key, count(*) AS n FROM crossed GROUP BY ALL) SELECT tab, split, by_ AS source, sum(n)::BIGINT AS n_pairs, count(*) AS n_records FROM worded JOIN n USING (tab, key) GROUP BY tab, split, by_",
    "p5_found": f"WITH RECURSIVE {_TIED} SELECT group_key, gdoc_key FROM grouped WHERE gdoc_key <> group_key",
    "p6_found": f"WITH {_UNITS} SELECT a AS key_a, b AS key_b FROM near",
    "p6_groups": f"WITH RECURSIVE {_UNITS}, both_ AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT unit_key AS k, unit_key AS r FROM liturgical_units UNION SELECT k, b FROM reach JOIN both_ ON r = a), g AS (SELECT k AS unit_key, min(r) AS group_key FROM reach GROUP BY k) SELECT unit_key, group_key, count(*) OVER (PARTITION BY group_key) AS size FROM g",
    "p8_found": f"WITH {_RUNS} SELECT item_id, doc_id FROM leak",
    "p8_matches": f"WITH {_RUNS}, {_LONGEST} SELECT item_id, doc_id, n::INT AS words, doc_at::INT AS doc_at, item_at::INT AS item_at FROM run QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, doc_at, item_at) = 1",
    "p8_clean": f"WITH {_RUNS} SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leak)",
}
