"""Queries on text, segments, statistics and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import is_heading, modern_candidates, normalise, old_candidates, speaker_of, stripped, tokens, unit_type, whitespace_tokens
from lexloom.operators import lexicon as lx
from lexloom.operators import segments as sg
from lexloom.operators.numbering import number_rows
from lexloom.plans import base, sql
from lexloom.session import cut, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@query("normalise_lines", f"WITH {sql.LINES} SELECT unit_key, line_no, {sql.norm('line')} AS norm FROM lines")
def _(spark: SparkSession, d: str) -> DataFrame:
    return base.lines(spark, d).select("unit_key", "line_no", normalise(F.col("line")).alias("norm"))


@query("tokenise_docs", f"SELECT gdoc_key, i - 1 AS pos, ts[i] AS token FROM (SELECT gdoc_key, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT gdoc_key, {sql.toks('text')} AS ts FROM genre_documents WHERE text IS NOT NULL))")
def _(spark, d):
    return table(spark, d, "genre_documents").where("text is not null").select("gdoc_key", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


@query("variant_candidates", f"WITH {sql.KNOWN}, {sql.TYPES} SELECT w AS token, rule, candidate FROM ({sql.candidates('types', old=False)})")
def _(spark, d):
    return base.types(spark, d).select("token", F.explode(modern_candidates(F.col("token"))).alias("x")).select("token", "x.rule", "x.candidate")


@query("old_candidates", f"WITH {sql.KNOWN}, {sql.TYPES} SELECT w AS token, rule, candidate FROM ({sql.candidates('types', modern=False)})")
def _(spark, d):
    return base.types(spark, d).select("token", F.explode(old_candidates(F.col("token"))).alias("x")).select("token", "x.rule", "x.candidate")


@query("variant_rule_hits", f"WITH {sql.KNOWN}, {sql.TYPES} SELECT rule, count(*) AS n_types FROM ({sql.candidates('types', old=False)}) WHERE ord > 0 GROUP BY rule")
def _(spark, d):
    each = base.types(spark, d).select(F.explode(modern_candidates(F.col("token"))).alias("x"))
    return each.where("x.ord > 0").groupBy("x.rule").agg(F.count("*").alias("n_types"))


_RAW = "concat('front matter', chr(10), repeat('=', 80), chr(10), 'PAGE ', page, chr(10), repeat('=', 80), chr(10), raw_text)"


@query("page_split", f"SELECT unit_key, page, {sql.strip('raw_text')} AS content FROM liturgical_units WHERE page IS NOT NULL AND raw_text IS NOT NULL")
def _(spark, d):
    raw = table(spark, d, "liturgical_units").where("page is not null and raw_text is not null")
    bar = "=" * 80
    return sg.split_pages(raw.select("unit_key", F.concat(F.lit(f"front matter\n{bar}\nPAGE "), F.col("page").cast("string"), F.lit(f"\n{bar}\n"), F.col("raw_text")).alias("text")), "unit_key", "text")


_PAGES = f"pages AS (SELECT unit_key AS page, concat_ws(chr(10), title, {sql.UNIT_TEXT}) AS content FROM liturgical_units)"
_PLINES = f"{_PAGES}, plines AS (SELECT * FROM (SELECT page, i - 1 AS line_no, {sql.strip('ls[i]')} AS line FROM (SELECT page, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page, string_split(content, chr(10)) AS ls FROM pages))) WHERE line <> '')"


@query("heading_lines", f"WITH {_PLINES} SELECT page, line_no, line FROM plines WHERE {sql.heading('line')}")
def _(spark, d):
    return sg.page_lines(base.pages(spark, d)).where(is_heading(F.col("line")))


@query("speaker_lines", f"WITH {_PLINES} SELECT page, line_no, {sql.speaker('line')} AS speaker FROM plines WHERE {sql.speaker('line')} IS NOT NULL")
def _(spark, d):
    return sg.page_lines(base.pages(spark, d)).select("page", "line_no", speaker_of(F.col("line")).alias("speaker")).where("speaker is not null")


@query("unit_classify", f"SELECT unit_key, {sql.unit_type('title', sql.UNIT_TEXT, 'speaker')} AS kind FROM liturgical_units")
def _(spark, d):
    return table(spark, d, "liturgical_units").select("unit_key", unit_type(F.col("title"), base.unit_text(), F.col("speaker")).alias("kind"))


_HEADED = f"""{_PLINES}, marked AS (SELECT *, {sql.heading('line')} AND length(line) > 5 AS head FROM plines),
 blocks AS (SELECT *, sum(head::INT) OVER (PARTITION BY page ORDER BY line_no) AS block FROM marked),
 grouped AS (SELECT page, block, max(CASE WHEN head THEN line END) AS heading, count(*) FILTER (NOT head) AS n_lines,
   arg_min({sql.speaker('line')}, CASE WHEN NOT head AND {sql.speaker('line')} IS NOT NULL THEN line_no END) AS speaker,
   string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head) AS text FROM blocks GROUP BY page, block HAVING count(*) FILTER (NOT head) > 0),
 h0 AS (SELECT row_number() OVER (ORDER BY page, block) - 1 AS unit_id, page, coalesce(heading, 'Page ' || page || ' block') AS title, n_lines, speaker, text FROM grouped),
 headed AS (SELECT *, {sql.unit_type('title', 'text', 'speaker')} AS unit_type FROM h0)"""
_BLANK = f"""b0 AS (SELECT page, i AS block, list_filter(list_transform(string_split(bs[i], chr(10)), lambda x: {sql.strip('x')}), lambda x: x <> '') AS ls FROM (SELECT page, bs, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT page, regexp_split_to_array(content, '\\n[\\t\\x0b\\f\\r\\n ]*\\n') AS bs FROM pages))),
 b1 AS (SELECT row_number() OVER (ORDER BY page, block) - 1 AS unit_id, page, ls FROM b0 WHERE len(ls) > 0),
 b2 AS (SELECT unit_id, page, CASE WHEN {sql.heading('ls[1]')} THEN ls[1] ELSE 'Block ' || unit_id END AS title, len(ls) AS n_lines, list_filter(list_transform(ls, lambda x: {sql.speaker('x')}), lambda x: x IS NOT NULL)[1] AS speaker, array_to_string(ls, chr(10)) AS text FROM b1),
 blank AS (SELECT *, {sql.unit_type('title', 'text', 'speaker')} AS unit_type FROM b2)"""


@query("units_by_heading", f"WITH {_HEADED} SELECT unit_id, page, title, n_lines, speaker, text, unit_type FROM headed")
def _(spark, d):
    return sg.by_headings(base.pages(spark, d))


@query("units_by_blank", f"WITH {_PAGES}, {_BLANK} SELECT unit_id, page, title, n_lines, speaker, text, unit_type FROM blank")
def _(spark, d):
    return sg.by_blank_lines(base.pages(spark, d))


@query("units_by_regex", f"WITH {_PAGES}, p AS (SELECT page, i - 1 AS unit_id, {sql.strip('ps[i]')} AS text FROM (SELECT page, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page, regexp_split_to_array(content, '[.!?]+[ \\n]+') AS ps FROM pages))) SELECT page, unit_id, substring(string_split(text, chr(10))[1], 1, 60) AS title, text FROM p WHERE text <> ''")
def _(spark, d):
    return sg.by_pattern(base.pages(spark, d), r"[.!?]+[ \n]+")


def _score(name: str, src: str) -> str:
    return f"""SELECT '{name}' AS method, n AS n_units, round(a, 6) AS avg_lines, k AS n_types, round(CASE WHEN n > 0 THEN 0.3 * (CASE WHEN n BETWEEN 5 AND 30 THEN 1.0 WHEN n BETWEEN 3 AND 50 THEN 0.6 ELSE 0.2 END) + 0.3 * (CASE WHEN a BETWEEN 3 AND 30 THEN 1.0 WHEN a BETWEEN 1 AND 50 THEN 0.5 ELSE 0.2 END)
 + 0.2 * least(k / 3.0, 1.0) + 0.2 * greatest(1 - tiny / greatest(n, 1), 0.0) ELSE 0.0 END::DOUBLE, 6) AS score FROM (SELECT count(*) AS n, avg(n_lines) AS a, count(DISTINCT unit_type) AS k, count(*) FILTER (n_lines <= 1) AS tiny FROM {src})"""


_SCORES = f"WITH {_HEADED}, {_BLANK}, scores AS ({_score('headings', 'headed')} UNION ALL {_score('blank_lines', 'blank')})"


def _scores(spark, d):
    p = base.pages(spark, d)
    return sg.plausibility(sg.by_headings(p), "headings").union(sg.plausibility(sg.by_blank_lines(p), "blank_lines"))


@query("boundary_score", f"{_SCORES} SELECT * FROM scores")
def _(spark, d):
    return _scores(spark, d)


@query("boundary_best", f"{_SCORES} SELECT * FROM scores ORDER BY score DESC, CASE WHEN method = 'headings' THEN 0 ELSE 1 END LIMIT 1")
def _(spark, d):
    return sg.best_method(_scores(spark, d))


@query("detected_units", f"{_SCORES}, best AS (SELECT method FROM scores ORDER BY score DESC, CASE WHEN method = 'headings' THEN 0 ELSE 1 END LIMIT 1) SELECT unit_id, page, title, n_lines, speaker, text, unit_type, 'headings' AS heuristic FROM headed WHERE (SELECT method FROM best) = 'headings' UNION ALL SELECT unit_id, page, title, n_lines, speaker, text, unit_type, 'blank_lines' FROM blank WHERE (SELECT method FROM best) = 'blank_lines'")
def _(spark, d):
    return sg.detect_units(base.pages(spark, d))


@query("manual_slices", f"WITH {sql.LINES}, n AS (SELECT row_number() OVER (ORDER BY unit_key, line_no) - 1 AS n, line FROM lines), b AS (SELECT i, 'slice ' || (i // 2) AS title, CASE WHEN i % 3 = 0 THEN 'hymn' END AS unit_type, (i // 2) * 37 AS s, (i // 2) * 37 + 5 + i % 2 AS e FROM range(0, 200) t(i)) SELECT any_value(title) AS title, any_value(unit_type) AS unit_type, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS text FROM b JOIN n ON n >= s AND n < e GROUP BY i")
def _(spark, d):
    numbered = number_rows(base.lines(spark, d).select("unit_key", "line_no", "line"), ["unit_key", "line_no"], "n")
    start = F.floor(F.col("id") / 2) * 37
    bounds = spark.range(200).select(F.concat(F.lit("slice "), F.floor(F.col("id") / 2).cast("string")).alias("title"), start.alias("start_line"), (start + 5 + F.col("id") % 2).alias("end_line"), F.when(F.col("id") % 3 == 0, "hymn").alias("unit_type"))
    return sg.manual_slices(numbered.select("n", "line"), bounds)


_WS = f"len(list_filter(regexp_split_to_array(line, '{sql.SPACE}+'), lambda x: x <> ''))"


@query("corpus_stats", f"WITH {sql.LINES}, t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(line), '{sql.SPACE}+'), lambda x: x <> '')) AS t FROM lines) SELECT (SELECT count(*) FROM liturgical_units) AS n_units, (SELECT count(*) FROM lines) AS n_lines, (SELECT count(*) FROM t) AS n_tokens, (SELECT count(DISTINCT t) FROM t) AS n_types, (SELECT count(DISTINCT unit_type) FROM liturgical_units) AS n_unit_types, (SELECT min(page) FROM liturgical_units) AS first_page, (SELECT max(page) FROM liturgical_units) AS last_page")
def _(spark, d):
    units, ls = table(spark, d, "liturgical_units"), base.lines(spark, d)
    toks = ls.select(F.explode(F.filter(F.split(F.lower("line"), f"{sql.SPACE}+"), lambda x: x != "")).alias("t"))
    a = units.agg(F.count("*").alias("n_units"), F.count_distinct("unit_type").alias("n_unit_types"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    b, c = ls.agg(F.count("*").alias("n_lines")), toks.groupBy("t").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_types"))
    one = F.lit(1).alias("k")
    return a.select("*", one).join(b.select("*", one), "k").join(c.select("*", one), "k").select("n_units", "n_lines", "n_tokens", "n_types", "n_unit_types", "first_page", "last_page")


@query("duplicate_lines", f"WITH {sql.LINES} SELECT {sql.strip('lower(line)')} AS line, count(*) AS n FROM lines WHERE {sql.strip('line')} <> '' GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return base.lines(spark, d).select(stripped(F.lower("line")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


_FREQ = f"{sql.LINES}, freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({sql.toks('line')}) AS token FROM lines) GROUP BY token)"


def _freq(spark, d):
    return base.lines(spark, d).select(F.explode(tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("token_frequencies", f"WITH {_FREQ} SELECT token, n FROM freq")
def _(spark, d):
    return _freq(spark, d)


@query("zipf_ranks", f"WITH {_FREQ} SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM freq")
def _(spark, d):
    f = _freq(spark, d).withColumn("down", -F.col("n"))
    return number_rows(f, ["down", "token"], "rank").select((F.col("rank") + 1).alias("rank"), "token", "n")


@query("unit_type_counts", "SELECT unit_type, count(*) AS n_units FROM liturgical_units GROUP BY unit_type")
def _(spark, d):
    return table(spark, d, "liturgical_units").groupBy("unit_type").agg(F.count("*").alias("n_units"))


@query("unit_titles", "SELECT unit_key, coalesce(title, 'Song ' || unit_key) AS title FROM liturgical_units")
def _(spark, d):
    units = table(spark, d, "liturgical_units").select("unit_key", "title")
    return base.with_titles(units.select("unit_key"), "unit_key", units.where("title is not null"))


@query("unit_stats", f"SELECT unit_key, unit_type, len(ls) AS n_lines, coalesce(list_sum(list_transform(ls, lambda line: {_WS})), 0)::BIGINT AS n_tokens FROM (SELECT unit_key, unit_type, coalesce(lines, string_split(raw_text, chr(10))) AS ls FROM liturgical_units)")
def _(spark, d):
    n = F.aggregate(F.transform("lines", whitespace_tokens), F.lit(0), lambda a, x: a + x)
    return table(spark, d, "liturgical_units").withColumn("lines", base.unit_lines()).select("unit_key", "unit_type", F.size("lines").alias("n_lines"), n.cast("bigint").alias("n_tokens"))


@query("missing_ranges", f"WITH {sql.LINES}, types AS (SELECT DISTINCT unnest({sql.toks('line')}) AS w FROM lines WHERE unit_type = 'rubric'), m AS (SELECT DISTINCT number::BIGINT AS n FROM house_lexicon WHERE number IS NOT NULL AND lower(trim(word)) NOT IN (SELECT w FROM types)), r AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM m) SELECT min(n) AS low, max(n) AS high, CASE WHEN min(n) = max(n) THEN min(n)::VARCHAR ELSE min(n) || '-' || max(n) END AS label FROM r GROUP BY g")
def _(spark, d):
    """The numbers of the house list whose words no rubric has, as ranges."""
    house = table(spark, d, "house_lexicon").select("number", lx.clean_word("word").alias("token")).where("token is not null")
    own = base.lines(spark, d).where("unit_type = 'rubric'").select(F.explode(tokens(F.col("line"))).alias("token")).distinct()
    return lx.number_ranges(house.join(own, "token", "left_anti"), "number")


@query("unique_word_coverage", f"WITH {sql.TYPES}, h AS (SELECT DISTINCT lower(trim(word)) AS w FROM house_lexicon WHERE lower(trim(word)) NOT IN ('', 'nan')) SELECT (SELECT count(*) FROM h) AS n_words, (SELECT count(*) FROM h WHERE w IN (SELECT w FROM types)) AS in_corpus, (SELECT count(*) FROM types WHERE w NOT IN (SELECT w FROM h)) AS corpus_only")
def _(spark, d):
    h = base.house(spark, d).select(F.col("headword").alias("token"), F.lit(1).alias("h")).distinct()
    j = h.join(base.types(spark, d).withColumn("c", F.lit(1)), "token", "full")
    return j.agg(F.count("h").alias("n_words"), F.count_if(F.expr("h = 1 and c = 1")).alias("in_corpus"), F.count_if(F.expr("h is null")).alias("corpus_only"))


@query("lexicon_dedupe", f"WITH {sql.LEX} SELECT headword, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY headword ORDER BY tier, ord) AS r FROM lex) WHERE r = 1")
def _(spark, d):
    return lx.first_entries(base.combined(spark, d), ["tier", "ord"]).select("headword", "source", "ord")


@query("lexicon_merge_conflicts", f"WITH {sql.LEX} SELECT headword, count(DISTINCT source) AS n_sources, count(*) AS n_entries FROM lex GROUP BY headword HAVING count(DISTINCT source) > 1")
def _(spark, d):
    return lx.conflicts(base.combined(spark, d))


@query("duplicate_headwords", "WITH h AS (SELECT lower(trim(word)) AS headword, number, min(number) OVER (PARTITION BY lower(trim(word))) AS first FROM house_lexicon WHERE lower(trim(word)) NOT IN ('', 'nan')) SELECT headword, first AS first_number, number AS other_number FROM h WHERE number <> first")
def _(spark, d):
    h = base.house(spark, d).select("headword", F.col("ord").cast("int").alias("other_number"))
    return h.join(h.groupBy("headword").agg(F.min("other_number").alias("first_number")), "headword").where("first_number <> other_number").select("headword", "first_number", "other_number")


@query("lookup_direct", f"WITH {sql.TYPES}, {sql.LEX} SELECT w AS token, count(*) AS n_entries FROM types JOIN lex ON headword = w GROUP BY w")
def _(spark, d):
    return lx.lookup_direct(base.types(spark, d), base.combined(spark, d))


@query("lookup_cascade", f"WITH {sql.KNOWN}, {sql.TYPES}, {sql.LEX}, {sql.LEX_KEYS}, {sql.CASCADE} SELECT w AS token, priority FROM found")
def _(spark, d):
    return lx.lookup_cascade(base.types(spark, d), base.combined(spark, d)).select("token", "priority")


def _change(lex: str, where: str = "true") -> str:
    return f"cand AS ({sql.candidates('types', old=False)}), heads AS (SELECT DISTINCT headword FROM {lex} WHERE {where}), hit AS (SELECT w, min(ord) AS o FROM cand JOIN heads ON candidate = headword GROUP BY w), a AS (SELECT count(*) AS n, count(*) FILTER (o = 0) AS b, count(o) AS c FROM types LEFT JOIN hit ON types.w = hit.w)"


@query("coverage_before_after", f"WITH {sql.KNOWN}, {sql.TYPES}, {sql.LEX}, {_change('lex')} SELECT n AS n_types, b AS before, c AS after, round(100.0 * b / greatest(n, 1), 6) AS before_pct, round(100.0 * c / greatest(n, 1), 6) AS after_pct, c - b AS gain FROM a")
def _(spark, d):
    return lx.coverage_change(base.types(spark, d), base.combined(spark, d))


@query("coverage_total", f"WITH {sql.KNOWN}, {sql.TYPES}, {sql.LEX}, {sql.LEX_KEYS}, {sql.CASCADE} SELECT count(*) AS n_types, count(*) FILTER (priority = 0) AS direct, count(*) FILTER (priority > 0) AS variant, count(*) FILTER (priority IS NULL) AS oov, round(100.0 * count(priority) / greatest(count(*), 1), 6) AS total_pct FROM found")
def _(spark, d):
    return lx.coverage_total(base.types(spark, d), base.combined(spark, d))


@query("token_lexicon_features", f"""WITH {sql.KNOWN}, {sql.TYPES}, {sql.LEX}, {sql.LEX_KEYS}, cand AS ({sql.candidates('types')}), h AS (SELECT w, candidate, min(ord) * 2 AS o FROM cand GROUP BY w, candidate),
 f AS (SELECT w, arg_min(candidate, (o + kind, candidate)) AS key, min(o + kind) AS p FROM h JOIN keys ON candidate = key GROUP BY w),
 told AS (SELECT headword AS k, 0 AS kind, pos, gloss FROM lex UNION ALL SELECT normalised_form, 1, pos, gloss FROM lex WHERE normalised_form <> ''), by_key AS (SELECT k, kind, count(pos) AS np, count(gloss) AS ng, count(DISTINCT pos) AS n_pos FROM told GROUP BY k, kind)
 SELECT types.w AS token, (coalesce(p, 1) = 0)::INT AS in_lexicon, (coalesce(p, 0) > 0)::INT AS in_lexicon_variant, (coalesce(np, 0) > 0)::INT AS has_pos, (coalesce(ng, 0) > 0)::INT AS has_gloss, coalesce(n_pos, 0) AS n_pos FROM types LEFT JOIN f ON types.w = f.w LEFT JOIN by_key ON k = f.key AND kind = p % 2""")
def _(spark, d):
    return lx.token_features(base.types(spark, d), base.combined(spark, d))


#: Tags of the one-hot features.
TAGS = ("NOUN", "VERB", "ADJ", "ADV", "ADP", "PRON", "PROPN", "NUM", "PART", "INTJ")


@query("token_pos_features", f"""WITH {sql.KNOWN}, {sql.TYPES}, {sql.LEX}, {sql.LEX_KEYS}, cand AS ({sql.candidates('types')}), h AS (SELECT w, candidate, min(ord) * 2 AS o FROM cand GROUP BY w, candidate),
 f AS (SELECT w, arg_min(candidate, (o + kind, candidate)) AS key, min(o + kind) AS p FROM h JOIN keys ON candidate = key GROUP BY w),
 told AS (SELECT headword AS k, 0 AS kind, pos FROM lex UNION ALL SELECT normalised_form, 1, pos FROM lex WHERE normalised_form <> ''), by_key AS (SELECT k, kind, list(DISTINCT pos) FILTER (pos IS NOT NULL) AS ps FROM told GROUP BY k, kind)
 SELECT types.w AS token, {", ".join(f"coalesce(list_contains(ps, '{t}'), false)::INT AS pos_{t}" for t in TAGS)} FROM types LEFT JOIN f ON types.w = f.w LEFT JOIN by_key ON k = f.key AND kind = p % 2""")
def _(spark, d):
    return lx.token_pos(base.types(spark, d), base.combined(spark, d), TAGS)


def _condition(name: str, best: str) -> str:
    return f"SELECT '{name}' AS condition, count(*) AS n_types, count(*) FILTER ({best} = 0) AS direct, count(*) FILTER ({best} > 0) AS variant, count(*) FILTER ({best} IS NULL) AS oov, round(100.0 * count(*) FILTER ({best} = 0) / greatest(count(*), 1), 6) AS direct_pct, round(100.0 * count({best}) / greatest(count(*), 1), 6) AS total_pct FROM types LEFT JOIN best USING (w)"


_TIERED = f"""{sql.KNOWN}, {sql.TYPES}, {sql.LEX}, keyed AS (SELECT key, kind, max(h) AS h, max(e) AS e FROM (SELECT headword AS key, 0 AS kind, (tier = 0)::INT AS h, (tier = 1)::INT AS e FROM lex UNION ALL SELECT normalised_form, 1, (tier = 0)::INT, (tier = 1)::INT FROM lex WHERE normalised_form <> '') GROUP BY key, kind),
 best AS (SELECT w, min(ord * 2 + kind) AS c, min(CASE WHEN h = 1 THEN ord * 2 + kind END) AS h, min(CASE WHEN e = 1 THEN ord * 2 + kind END) AS e FROM ({sql.candidates('types')}) JOIN keyed ON candidate = key GROUP BY w)"""


@query("coverage_by_condition", f"WITH {_TIERED} {_condition('none', 'NULL::INT')} UNION ALL {_condition('house', 'h')} UNION ALL {_condition('existing', 'e')} UNION ALL {_condition('combined', 'c')}")
def _(spark, d):
    return lx.condition_coverage(base.types(spark, d), base.combined(spark, d), {"house": F.expr("tier = 0"), "existing": F.expr("tier = 1"), "combined": F.expr("true")})


@query("oov_tokens", f"WITH {sql.TYPES}, {sql.LEX} SELECT w AS token FROM types WHERE w NOT IN (SELECT headword FROM lex)")
def _(spark, d):
    return base.types(spark, d).join(base.combined(spark, d).select(F.col("headword").alias("token")), "token", "left_anti")


@query("json_entries", "SELECT entry_id, json_extract_string(payload, '$.headword') AS headword, json_extract_string(payload, '$.pos') AS pos, json_extract_string(payload, '$.gloss') AS gloss FROM lexicon_raw")
def _(spark, d):
    j = F.from_json("payload", "headword string, pos string, gloss string")
    return table(spark, d, "lexicon_raw").select("entry_id", j.alias("j")).select("entry_id", "j.headword", "j.pos", "j.gloss")


@query("genre_counts", "SELECT genre, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM (SELECT genre, source FROM genre_documents UNION ALL SELECT genre, source FROM documents) GROUP BY genre")
def _(spark, d):
    both = table(spark, d, "genre_documents").select("genre", "source").unionByName(table(spark, d, "documents").select("genre", "source"))
    return both.groupBy("genre").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"))


@query("genre_pairs", "WITH g AS (SELECT DISTINCT genre FROM genre_documents WHERE genre IS NOT NULL) SELECT a.genre AS genre_a, b.genre AS genre_b FROM g a JOIN g b ON a.genre < b.genre")
def _(spark, d):
    names = table(spark, d, "genre_documents").where("genre is not null").agg(F.sort_array(F.collect_set("genre")).alias("g"))
    a = names.select("g", F.posexplode("g").alias("i", "genre_a"))
    return a.select("genre_a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("genre_b"))


_SUNG = f"sung AS (SELECT DISTINCT {sql.norm('line')} AS line, unit_key FROM lines WHERE unit_type IN ('hymn', 'canticle'))"


def _sung(spark, d):
    songs = base.lines(spark, d).where(F.col("unit_type").isin(*base.SONG_TYPES))
    return songs.select(normalise(F.col("line")).alias("line"), "unit_key").where("line is not null").distinct()


@query("shared_refrains", f"WITH {sql.LINES}, {_SUNG} SELECT line, count(*) AS n_units, min(unit_key) AS first_unit FROM sung WHERE line IS NOT NULL GROUP BY line HAVING count(*) > 1")
def _(spark, d):
    """Lines that several songs share."""
    return _sung(spark, d).groupBy("line").agg(F.count("*").alias("n_units"), F.min("unit_key").alias("first_unit")).where("n_units > 1")


@query("shared_refrain_units", f"WITH {sql.LINES}, {_SUNG} SELECT line, unit_key FROM sung WHERE line IN (SELECT line FROM sung GROUP BY line HAVING count(*) > 1)")
def _(spark, d):
    """The songs of each shared line, a row each, so that a line that very many share is no single row."""
    return base.shared_by(cut(_sung(spark, d)), "line", "unit_key")
