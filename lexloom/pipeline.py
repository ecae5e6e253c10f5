"""The whole run over a corpus folder: units, statistics, lexicon conditions, tasks, error analysis, report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import normalise, tokens
from lexloom.operators import errors, experiments, lexicon, metrics, models, refrains, retrieval, segments
from lexloom.operators.experiments import Config
from lexloom.operators.numbering import number_rows
from lexloom.plans.base import SONG_TYPES, shared_by, with_titles
from lexloom.session import cut
from lexloom.sources import loaders


def corpus_units(spark: SparkSession, config: Config) -> DataFrame:
    """The units of the raw corpus by the configured way: manual bounds, a pattern, or the more plausible of two."""
    raw = loaders.raw_corpus(spark, config.paths["raw_corpus"]).withColumn("k", F.lit(0))
    pages = segments.split_pages(raw, "k", "text").select(F.col("page").cast("bigint").alias("page"), "content")
    manual, lines = None, None
    file = config.manual_boundary_file
    if config.method == "manual" and file and Path(file).exists():
        manual = loaders.boundaries(spark, file)
        lines = raw.select(F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return cut(segments.detect_units(pages, manual, lines, config.regex_pattern if config.method == "regex" else None))


def lexicons(spark: SparkSession, config: Config) -> dict[str, DataFrame | None]:
    """Conditions from the lexicon folders that exist."""
    found, at = [], config.paths
    folder = Path(at.get("lexicon_external_dir", ""))
    if at.get("lexicon_external_dir") and folder.is_dir():
        found += [loaders.dictionary_jsonl(spark, str(f)) for f in sorted(folder.glob("*.jsonl"))]
        found += [loaders.expressions_json(spark, str(f)) for f in sorted(folder.glob("*.json"))]
    if at.get("user_supplied_dir"):
        found.append(loaders.user_lexicon(spark, at["user_supplied_dir"]))
    house = loaders.house_lexicon(spark, at["lexicon_house_dir"]) if at.get("lexicon_house_dir") else None
    return {c: None if x is None else cut(x) for c, x in experiments.conditions(house, found).items()}


def songs_of(units: DataFrame) -> DataFrame:
    """Hymns and canticles; where there are none, every unit but rubrics."""
    songs = units.where(F.col("unit_type").isin(*SONG_TYPES))
    return units.where("unit_type <> 'rubric'") if songs.isEmpty() else songs


def run(spark: SparkSession, config: Config, out: str) -> dict[str, DataFrame]:
    """Every result table by name; all are written below out as CSV folders, with a report beside them. A task that can't
    run for lack of data has no table."""
    units, lex = corpus_units(spark, config), lexicons(spark, config)
    songs = cut(songs_of(units))
    lines = cut(number_rows(units.select("unit_id", "unit_type", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), ["unit_id", "line_no"], "key"))
    toks = lines.select(F.explode(tokens(F.col("line"))).alias("token"))
    frequencies = cut(toks.groupBy("token").agg(F.count("*").alias("n")))
    types = frequencies.select("token")
    results: dict[str, DataFrame] = {
        "corpus_units": units.select("unit_id", "page", "title", "unit_type", "speaker", "n_lines", "heuristic"),
        "token_frequencies": frequencies.orderBy(F.desc("n"), "token"),
        "corpus_stats": units.agg(F.count("*").alias("n_units"), F.sum("n_lines").alias("n_lines"), F.min("page").alias("first_page"), F.max("page").alias("last_page")),
        "unit_types": units.groupBy("unit_type").agg(F.count("*").alias("n")),
    }
    some = {c: x for c, x in lex.items() if x is not None}
    if some:
        coverage = None
        for c, x in some.items():
            one = lexicon.coverage_change(types, x).select(F.lit(c).alias("condition"), "*")
            coverage = one if coverage is None else coverage.union(one)
        results["lexicon_coverage"] = coverage
    song_lines = cut(lines.join(songs.select("unit_id", "title"), "unit_id").where(F.size(tokens(F.col("line"))) >= 2))
    texts = songs.select(F.col("unit_id").alias("doc"), "text")
    qs = song_lines.select(F.col("key").alias("q"), F.col("unit_id").alias("doc"), F.col("line").alias("text"))
    index = retrieval.Index(texts)
    results["task_c_retrieval"] = retrieval.retrieval_metrics(retrieval.search(index, qs.select("q", "text"), max(config.top_k)), qs.select("q", "doc"), tuple(config.top_k))
    labelled = song_lines.select("key", F.col("line").alias("text"), F.col("unit_id").cast("string").alias("song"))
    c = experiments.task_c(labelled, "key", "text", "song", lex, config)
    if c is not None:
        results["task_c_classification"] = c
        results["leakage_inflation"] = experiments.leakage_inflation(labelled, "key", "text", "song", lex, config)
        results |= _explained(labelled, song_lines, songs, some.get("combined"), config)
        k = experiments.splits.fold_count(config.folds, experiments.smallest(labelled, "song"))
        if some:
            results["lexicon_ablation"] = experiments.ablation(models.Dataset(labelled, "key", "text", "song", k, config.seed, some))
            if not some["combined"].isEmpty():
                results["coverage_masking"] = experiments.masking(labelled, "key", "text", "song", some["combined"], config)
    genres = loaders.genres(spark, config.paths.get("genres_dir", ""), songs.select("unit_id", F.split("text", "\n").alias("lines")))
    if loaders.positive_only(genres):
        proxy = experiments.proxy_task_a(lines.where(F.size(tokens(F.col("line"))) >= 2), "key", "line", "unit_id", "unit_type", lex, config)
        if proxy is not None:
            results["PROXY_task_a_hymn_vs_prose"] = proxy
    else:
        each = genres.select("doc_id", "genre", F.posexplode("lines").alias("i", "text")).where(F.size(tokens(F.col("text"))) >= 2)
        a = experiments.task_a(each.withColumn("key", F.concat_ws(":", "doc_id", F.col("i").cast("string"))), "key", "text", "genre", lex, config)
        if a is not None:
            results["task_a_song_detection"] = a
    for name, df in results.items():
        loaders.write_csv(df, f"{out}/{name}")
    shared = song_lines.select(normalise(F.col("line")).alias("line"), F.col("unit_id").alias("unit_key")).where("line <> ''").distinct()
    loaders.write_refrains(shared_by(cut(shared), "line", "unit_key"), f"{out}/shared_refrains")
    Path(out, "REPORT.md").write_text(report(results), encoding="utf-8")
    return results


def _explained(labelled: DataFrame, song_lines: DataFrame, songs: DataFrame, lex: DataFrame | None, config: Config) -> dict[str, DataFrame]:
    """The out-of-fold errors of the best model with their tags, and the songs it confuses, by title."""
    k = experiments.splits.fold_count(config.folds, experiments.smallest(labelled, "song"))
    model = "hybrid_logreg" if lex is not None else "tfidf_logreg"
    data = models.Dataset(labelled, "key", "text", "song", k, config.seed, {"combined": lex} if lex is not None else {})
    p = cut(models.predict(data, model, "combined" if lex is not None else None, whole=True))
    wrong = p.where("y <> yhat").join(song_lines.select("key", "line"), "key").select("key", "line", normalise(F.col("line")).alias("norm"), tokens(F.col("line")).alias("ts"), "y", "yhat", "score")
    texts = songs.select(F.col("unit_id").alias("key"), normalise(F.col("text")).alias("text"))
    refs = refrains.shared(wrong.select(F.col("norm").alias("line")), texts)
    types = song_lines.select(F.explode(tokens(F.col("line"))).alias("token")).distinct()
    empty = types.limit(0).select(F.col("token").alias("headword"), F.col("token").alias("normalised_form"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("gloss"))
    tagged = errors.tagged_lines(wrong, errors.told_types(types, lex if lex is not None else empty), refs)
    titles = songs.select(F.col("unit_id").cast("string").alias("song"), "title")
    pairs = metrics.confused_pairs(p)
    for side in ("a", "b"):
        named = with_titles(pairs.withColumnRenamed(side, "song"), "song", titles)
        pairs = named.withColumnRenamed("song", side).withColumnRenamed("title", f"title_{side}")
    return {f"misclassified_{model}_combined": errors.exported(tagged, model, "combined").drop("key"), "confused_song_pairs": pairs.select("title_a", "title_b", "n").orderBy(F.desc("n"), "title_a", "title_b")}


#: Headings of the report and the tables under them.
SECTIONS = {
    "Dataset": ("corpus_stats", "unit_types"),
    "Lexicon coverage": ("lexicon_coverage",),
    "Song identification": ("task_c_retrieval", "task_c_classification", "leakage_inflation", "confused_song_pairs"),
    "Ablation and masking": ("lexicon_ablation", "coverage_masking"),
    "Song detection": ("task_a_song_detection", "PROXY_task_a_hymn_vs_prose"),
}


def report(results: dict[str, DataFrame], rows: int = 50) -> str:
    """Markdown of the result tables, the first rows of each; what has no table is named as not benchmarked."""
    out = ["# Report", ""]
    for heading, names in SECTIONS.items():
        out += [f"## {heading}", ""]
        for name in names:
            out += [f"### {name}", "", loaders.markdown_table(results[name], rows) if name in results else "Not benchmarked: no data for it.", ""]
    return "\n".join(out)
