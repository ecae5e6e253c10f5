import inspect
import random

from conftest import SF
from pyspark.sql import functions as F

from lexloom.operators import lexicon, numbering, refrains, skew, splits
from lexloom.operators.components import connected_components
from lexloom.sources import loaders
from lexloom.streaming.coverage import windowed_coverage

LEX = "headword string, source string, normalised_form string, pos string, gloss string, ord bigint"


def lex(spark, *words):
    return spark.createDataFrame([(w, "s", None, "NOUN", "g", i) for i, w in enumerate(words)], LEX)


def test_lexicon(spark):
    types = spark.createDataFrame([("hello",), ("world",), ("missing",), ("cararag",)], "token string")
    l = lex(spark, "hello", "world", "kararag")
    r = lexicon.coverage_total(types, l).first()
    assert (r["n_types"], r["direct"], r["variant"], r["oov"]) == (4, 2, 1, 1)
    assert {x["token"]: x["key"] for x in lexicon.lookup_cascade(types, l).collect()}["cararag"] == "kararag"
    both = l.unionByName(lex(spark, "hello").withColumn("source", F.lit("t")))
    assert [tuple(x) for x in lexicon.conflicts(both).collect()] == [("hello", 2, 2)]
    assert lexicon.coverage_total(types.where("false"), l).first()["total_pct"] == 0


def test_ranges(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9, 10, None)], "n int")
    assert [r["label"] for r in lexicon.number_ranges(df, "n").orderBy("low").collect()] == ["1-3", "7", "9-10"]


def test_numbers_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [(r["v"], r["n"]) for r in numbering.number_rows(df, ["v"], "n").orderBy("v").collect()] == [(i, i) for i in range(1000)]
    got = {r["v"]: r["t"] for r in numbering.running_sums(df, ["v"], {"t": "v"}).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(1000)}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(7000, 7001 + i) for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in list(parent)}
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
    assert connected_components(df.where("false")).count() == 0


def test_join_by_size(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m")).where("k <> 7")
    got = skew.join_by_size(rows, classes, ["k"], "n", 9000)
    assert got.count() == rows.where("k <> 7").count()
    assert skew.join_by_size(rows, classes, ["k"], "n", 9000, "left").count() == 9000


def test_folds(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], i // 4) for i in range(101)], "k bigint, y string, g int")
    counts = splits.stratified_folds(rows, "k", "y", 5, 42).groupBy("y", "fold").count().collect()
    for y in "ab":
        n = [r["count"] for r in counts if r["y"] == y]
        assert max(n) - min(n) <= 1 and len(n) == 5
    g = splits.group_folds(rows, "k", "g", "y", 4).groupBy("g").agg(F.count_distinct("fold").alias("n"))
    assert g.where("n > 1").count() == 0


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Number,Word,Normalized Ilocano,Root,UPOS,English,Context\n1,Amen,amen,amen,INTJ,amen,\"x, y\"\n2,nan,,,,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Word,UPOS_Tag\nAmen,X\nNi\xf1o,NOUN\n".encode("latin-1"))
    house = {r["headword"]: r["pos"] for r in loaders.house_lexicon(spark, str(tmp_path)).collect()}
    assert house == {"amen": "INTJ", "niño": "NOUN"}
    assert loaders.house_lexicon(spark, str(tmp_path / "none")).count() == 0
    j = tmp_path / "d.jsonl"
    j.write_text('{"word": "Apo", "pos": "noun", "senses": [{"glosses": ["lord", "sir"]}, {"glosses": ["x"]}]}\nbad\n{"word": "B"}\n')
    assert sorted((r["headword"], r["gloss"]) for r in loaders.dictionary_jsonl(spark, str(j)).collect()) == [("apo", "lord; sir; x"), ("b", None)]
    p = tmp_path / "p.json"
    p.write_text('{"result": [{"txt": "Uno"}, {"word": "dos"}, "tres", {"txt": " "}]}')
    assert sorted(r["headword"] for r in loaders.expressions_json(spark, str(p)).collect()) == ["dos", "tres", "uno"]
    w = tmp_path / "w.txt"
    w.write_text("1. A\n2. amen\n\nyeg\n")
    assert [r["word"] for r in loaders.unique_words(spark, str(w)).orderBy("idx").collect()] == ["a", "amen", "yeg"]
    (tmp_path / "g" / "poetry").mkdir(parents=True)
    (tmp_path / "g" / "poetry" / "s.txt").write_text("a\nb\n\n\n\nc")
    songs = spark.createDataFrame([(3, ["x"])], "unit_id int, lines array<string>")
    got = loaders.genres(spark, str(tmp_path / "g"), songs)
    assert sorted(r["doc_id"] for r in got.collect()) == ["poetry_s_0", "poetry_s_2", "song_3"] and not loaders.positive_only(got)
    loaders.write_csv(got.select("doc_id"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    assert loaders.markdown_table(got.select("genre").limit(1)).startswith("| genre |")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "Hello there"), ("2024-01-01 00:20:00", "hello"), ("2024-01-01 02:00:00", "x")], "ts string, line string").select(F.to_timestamp("ts").alias("ts"), "line")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, line string").parquet(str(tmp_path / "in"))
    q = windowed_coverage(stream, lex(spark, "hello"), "ts", "line").writeStream.outputMode("complete").format("memory").queryName("cov").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n_tokens"], r["covered"]) for r in spark.table("cov").orderBy("start").collect()] == [(3, 2), (1, 0)]


def test_contained_lines(spark):
    texts = [(1, "o amen dios apo a naimbag, dayawen"), (2, "dakkel ti dios apo ti amin"), (3, "amenos dios apo a naimbag, dayawenna ngamin"), (4, ""), (5, None)]
    lines = ["amen", "ti dios", "dios apo", "s apo t", "dios apo a naimbag, dayawen", "os apo a naim", "apo dios", "ti dios apo ti amin", "", None, "none of these words at all"]
    got = refrains.shared(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame(texts, "key bigint, text string"))
    keys = {x: [k for k, t in texts if t is not None and x in t] for x in lines if x is not None}
    assert {r["line"]: (r["lo"], r["hi"]) for r in got.collect()} == {x: (min(k), max(k)) for x, k in keys.items() if len(k) > 1}


def test_refrain_within_longer_text(spark, tmp_path):
    from lexloom.plans import catalog

    units = [(1, ["naimbag nga aldaw"], None), (2, ["O naimbag nga", "aldaw kadakayo"], None), (3, None, "sabali a linia\nken naimbag nga aldaw")]
    spark.createDataFrame([(k, "hymn", x, r) for k, x, r in units], "unit_key bigint, unit_type string, lines array<string>, raw_text string").write.parquet(f"{tmp_path}/liturgical_units.parquet")
    spark.createDataFrame([], "number int, word string, normalized_ilocano string, upos_tag string, english_translation string").write.parquet(f"{tmp_path}/house_lexicon.parquet")
    spark.createDataFrame([], "entry_id bigint, headword string, source string, normalised_form string, pos string, gloss string").write.parquet(f"{tmp_path}/lexicon_entries.parquet")
    tags = {(r["unit_key"], r["line_no"]): r["tags"] for r in catalog.QUERIES["error_tags"](spark, str(tmp_path)).collect()}
    assert "shared_refrain" in tags[1, 0] and "shared_refrain" not in tags[2, 0]
    assert [tuple(r) for r in catalog.QUERIES["refrain_containment"](spark, str(tmp_path)).collect()] == [("naimbag nga aldaw", 1, 3)]


def test_units_of_raw_text_only(spark, tmp_path):
    from lexloom.plans import base, catalog

    units = [(1, "hymn", ["a b", "c"], "a b\nc"), (2, "prayer", None, "d e\nf"), (3, "rubric", [], "g")]
    spark.createDataFrame(units, "unit_key bigint, unit_type string, lines array<string>, raw_text string").write.parquet(f"{tmp_path}/liturgical_units.parquet")
    got = [tuple(r) for r in base.lines(spark, str(tmp_path)).orderBy("unit_key", "line_no").collect()]
    assert got == [(1, "hymn", 0, "a b"), (1, "hymn", 1, "c"), (2, "prayer", 0, "d e"), (2, "prayer", 1, "f")]
    stats = {r["unit_key"]: (r["n_lines"], r["n_tokens"]) for r in catalog.QUERIES["unit_stats"](spark, str(tmp_path)).collect()}
    assert stats == {1: (2, 3), 2: (2, 3), 3: (0, 0)}


def test_registered_model_parameters(spark, monkeypatch):
    from lexloom.operators import metrics, models
    from lexloom.plans import catalog

    of = {k: models._classifier(k, 10, 42) for k in ("logreg", "svm", "rf")}
    assert of["logreg"].getMaxIter() == 1000 and of["svm"].getClassifier().getMaxIter() == 2000 and (of["rf"].getNumTrees(), of["rf"].getMaxDepth()) == (100, 30)
    seen = []

    def note(f, *names):
        sig = inspect.signature(f)

        def run(*a, **kw):
            args = sig.bind(*a, **kw)
            args.apply_defaults()
            seen.append(tuple(args.arguments[n] for n in names))

        return run

    monkeypatch.setattr(models, "cross_validate", note(models.cross_validate, "k"))
    monkeypatch.setattr(metrics, "bootstrap_ci", note(metrics.bootstrap_ci, "draws"))
    monkeypatch.setattr(models, "score", lambda *a: None)
    for name in ("cv_logreg", "cv_cnb", "cv_rf", "cv_svm_ovr", "hybrid_logreg", "bootstrap_ci"):
        catalog.QUERIES[name](spark, SF)
    assert seen == [(5,)] * 5 + [(1000,)]


def test_heavy_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HEAVY", 10)
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    got = skew.join_by_size(rows, classes, ["k"], "n", 9000).withColumn("p", F.spark_partition_id())
    assert got.count() == 9000 and got.columns == ["k", "id", "n", "m", "p"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got.where("k = 0").select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoint_folder(spark):
    from lexloom.session import cut, drop_cut

    df = cut(spark.range(5))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    assert df.count() == 5
    drop_cut(df)
    drop_cut(spark.range(3))
    import pathlib

    assert not pathlib.Path(path.removeprefix("file:")).exists()


def test_char_tfidf_moves_no_row_a_text_and_term(spark):
    """The weights of char_terms and tfidf, from texts that are read in place."""
    from lexloom.operators import features

    texts = ["Kararag ti ama", "ama  AMA namin", "x", "", None, "\U0001f600b kararag — kararag"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    terms = features.char_terms(docs, "k", "t")
    for limit in (12, 1000):
        want = {(r["k"], r["term"]): r["weight"] for r in features.tfidf(terms, "k", features.vocabulary(terms, docs.count(), limit)).collect()}
        out = features.char_tfidf(docs, "k", "t", limit)
        got = {(r["k"], r["term"]): r["weight"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_own_ranks_are_those_of_the_search(spark, monkeypatch):
    import random

    from lexloom.operators import retrieval

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(words[: rnd.choice((3, 10, 30))]) for _ in range(n))
    docs = [(i, text(12)) for i in range(80)]
    docs += [(i + 100, t) for i, t in docs[:20]]
    own = [(f"{i}:{k}", " ".join(t.split()[k : k + 2 + k]), i) for i, t in docs for k in (0, 3)] + [("a", "zzz", 1), ("b", "zzz", 90), ("c", "", 0), ("d", "w1 zzz", 999), ("e", "w29 w28", 2)]
    qs = spark.createDataFrame(own, "q string, text string, doc bigint")
    for chunk in (10**6, 300):
        monkeypatch.setattr(retrieval, "CHUNK", chunk)
        index = retrieval.Index(spark.createDataFrame(docs, "doc bigint, text string"))
        ranked = retrieval.search(index, qs.select("q", "text"), 5, "bm25")
        want = {(r["q"], r["rank"]) for r in ranked.join(qs.select("q", "doc"), ["q", "doc"]).collect()}
        assert {(r["q"], r["rank"]) for r in retrieval.own_ranks(index, qs, 5).collect()} == want and len(want) > 60
        assert retrieval.own_metrics(index, qs).first() == retrieval.retrieval_metrics(ranked, qs.select("q", "doc")).first()


def test_contained_lines_are_found_either_way(spark, monkeypatch):
    """error_tags, refrain_containment: lines of all lengths, with few of them broadcast or none; candidates come by runs of
    three inner words, so a pair that all texts hold makes none."""
    import random

    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(("ti", "apo", f"w{rnd.randrange(9)}", f"dios{rnd.randrange(3)}x")) for _ in range(n))
    texts = [(i, text(40)) for i in range(30)]
    cuts = [(x, t, rnd.randrange(len(t) - 60), rnd.randrange(1, 60)) for _ in range(300) for x, t in [rnd.choice(texts)]]
    lines = sorted({t[at : at + n].strip() for _, t, at, n in cuts} | {text(k) for k in range(1, 9)})
    want = {x: (min(k), max(k)) for x in lines for k in [[i for i, t in texts if x in t]] if len(k) > 1}
    assert all(any(len(x.split(" ")) == k for x in want) for k in (1, 2, 3, 4, 5))
    for few in (refrains.FEW, 0):
        monkeypatch.setattr(refrains, "FEW", few)
        got = refrains.shared(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame(texts, "key bigint, text string"))
        assert {r["line"]: (r["lo"], r["hi"]) for r in got.collect()} == want
