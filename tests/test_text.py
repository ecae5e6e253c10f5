from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import dedup, metrics, segments


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    toks = lambda t: one(spark, t, tx.tokens)
    assert toks("Amami nga addaca sadi langit") == ["amami", "nga", "addaca", "sadi", "langit"]
    assert toks("talna't awanan-tulaw") == ["talna't", "awanan-tulaw"]
    assert toks("") == [] and toks("  \n ") == []
    assert toks("Amen! Amen! Amen!") == ["amen"] * 3
    assert toks("«ñandu»! “x”") == ["ñandu", "x"]


def test_normalise(spark):
    assert one(spark, "  A‘b’   c—d é ", tx.normalise) == "a'b' c-d é"
    again = one(spark, "a'b' c-d é", tx.normalise)
    assert again == "a'b' c-d é"


def test_variants(spark):
    new = lambda w: {x["candidate"] for x in one(spark, w, tx.modern_candidates)}
    assert "kararag" in new("cararag") and "keso" in new("queso") and "kadagiti" in new("cadagiti")
    for w in ("amen", "cararag", "x"):
        assert w in new(w)
    assert "cararag" in {x["candidate"] for x in one(spark, "kararag", tx.old_candidates)}


def test_heading_and_speaker(spark):
    head = lambda t: one(spark, t, tx.is_heading)
    assert head("GLORIA PATRI") and head("TI KYRIE (x)") and not head("Small text") and not head("a")
    assert one(spark, "Pastor: x", tx.speaker_of) == "Pastor" and one(spark, "x Pastor:", tx.speaker_of) is None


def test_pages_and_units(spark):
    bar = "=" * 80
    raw = f"lost\n{bar}\nPAGE 1\n{bar}\nGLORIA PATRI\nGimong: a b\n{bar}\nPAGE 2\n{bar}\nTI KYRIE\nAmin: c\nTI SERMON\n"
    pages = segments.split_pages(spark.createDataFrame([(0, raw)], "k int, text string"), "k", "text")
    assert [r["page"] for r in pages.orderBy("page").collect()] == [1, 2]
    units = segments.by_headings(pages.selectExpr("cast(page as bigint) page", "content")).orderBy("unit_id").collect()
    assert [(u["title"], u["unit_type"], u["speaker"]) for u in units] == [("GLORIA PATRI", "canticle", "Gimong"), ("TI KYRIE", "canticle", "Amin")]
    empty = pages.where("false").selectExpr("cast(page as bigint) page", "content")
    assert segments.plausibility(segments.by_headings(empty), "headings").first()["score"] == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_indel_ratio():
    words = ["", "a", "abcd", "abdc", "hello world", "helo wrld", "xyz", "aaaa", "aa"]
    for a in words:
        for b in words:
            want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
            assert abs(dedup.indel_ratio(a, b) - want) < 1e-9 and dedup.indel_ratio(a, b) == dedup.indel_ratio(b, a)


def test_similar_groups(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (3, "different text"), (4, "hello wrld"), (5, None)], "k bigint, t string")
    got = {r["k"]: r["group_key"] for r in dedup.similar_groups(rows, "k", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_similar_pairs_exact(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/liturgical_units.parquet").select("unit_key", "title")
    texts = sorted({" ".join(r["title"].lower().split()) for r in rows.where("title is not null").collect()} - {""})
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if dedup.indel_ratio(a, b) >= 85}
    assert {(r["a"], r["b"]) for r in dedup.similar_pairs(rows, "title").collect()} == want


def test_binary_metrics(spark):
    right = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1)], "y int, yhat int, score double")
    m = metrics.binary_metrics(right).first()
    assert m["accuracy"] == m["f1"] == m["mcc"] == 1
    assert metrics.binary_metrics(right.selectExpr("y", "1 - yhat yhat", "score")).first()["accuracy"] == 0
    a = metrics.ranking_areas(right).first()
    assert a["roc_auc"] == 1 and a["pr_auc"] == 1


def test_p_values():
    assert abs(metrics.t_p_value(2.228, 10) - 0.05) < 1e-3 and metrics.t_p_value(0, 5) == 1
    assert metrics.wilcoxon_p_value([1, 2, 3, 4, 5, 6], 0) == 2 / 64


def test_similar_pairs_of_short_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "BLOCK", 7)
    rnd = random.Random(4)
    texts = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 16))) for _ in range(120)}
    texts |= {t[: rnd.randrange(len(t) + 1)] + "c" + t[rnd.randrange(len(t) + 1) :] for t in list(texts)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for threshold in (85, 60):
        want = {(a, b) for a in texts for b in texts if a < b and dedup.indel_ratio(a, b) >= threshold}
        got = [(r["a"], r["b"]) for r in dedup.similar_pairs(df, "t", threshold).collect()]
        assert set(got) == want and len(got) == len(want) and want


def test_one_letter_words_keep_their_c(spark):
    assert {x["candidate"] for x in one(spark, "c", tx.modern_candidates)} == {"c"} and "ak" in {x["candidate"] for x in one(spark, "ac", tx.modern_candidates)}
    assert {x["candidate"] for x in one(spark, "k", tx.old_candidates)} == {"k"}


def test_nfc_of_all_kinds(spark):
    import unicodedata

    for t in ("éx", "plain", "“q” – …", "Å", "각", "ạ̇", "Ω ½"):
        assert one(spark, t, tx.nfc) == unicodedata.normalize("NFC", t)


def test_similar_pairs_of_long_texts_and_many_letters(spark, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "BLOCK", 20)
    monkeypatch.setattr(dedup, "SLICE", 3)
    rnd = random.Random(6)
    letters = [*"abc", *(chr(0x4E00 + i) for i in range(400)), "\U0001f600", "\U0001f601"]
    texts = {"".join(rnd.choice(letters if k % 2 else "abc") for _ in range(rnd.choice((5, 40, 63, 64, 65, 90)))) for k in range(60)}
    texts |= {t[:p] + rnd.choice(("", "d", "dc")) + t[p + 1 :] for t in list(texts) for p in (rnd.randrange(len(t)),)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {(a, b) for a in texts for b in texts if a < b and dedup.indel_ratio(a, b) >= 85}
    got = [(r["a"], r["b"]) for r in dedup.similar_pairs(df, "t").collect()]
    assert set(got) == want and len(got) == len(want) >= 40


def test_similar_groups_need_few_pairs(spark):
    """Numbered titles are all similar to one another; groups take one link a title, not all pairs."""
    rows = spark.createDataFrame([(i, f"the very same page {i} block of titles") for i in range(300)], "k bigint, t string")
    assert dedup._met(dedup._texts(rows, "t"), 85, linked=True).count() == 299
    assert {r["group_key"] for r in dedup.similar_groups(rows, "k", "t").collect()} == {0}


def test_tags_run_on_parts_that_are_cut(spark):
    """error_tags, error_export: what is looked up and shared is cut, so the driver holds no plan of all parts."""
    from lexloom.operators import errors, refrains

    lines = spark.createDataFrame([(1, "a b c d", ["a", "b", "c", "d"]), (2, "a", ["a"])], "key int, norm string, ts array<string>")
    told = lines.selectExpr("explode(ts) as token").distinct().selectExpr("token", "int(token = 'd') as oov", "0 as mapped", "0 as varied")
    shared = refrains.shared(lines.selectExpr("norm as line"), spark.createDataFrame([(1, "a b c d"), (2, "x a b c d")], "key int, text string"))
    assert shared._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"
    out = errors.tagged_lines(lines, told, shared)
    assert {r["key"]: (r["oov_tokens"], r["tags"]) for r in out.collect()} == {1: ("d", "shared_refrain"), 2: ("", "short_phrase,shared_refrain")}
    assert "Generate" not in str(out.select("key", "tags")._jdf.queryExecution().analyzed()).replace("Generate posexplode", "")


def test_words_of_lines_are_not_shuffled(spark, monkeypatch):
    """error_tags, error_export: few word types are broadcast and lines are cut without their tokens; the same tags either way."""
    from lexloom.operators import errors, refrains

    texts = ["a b, c 'd' — e", "a ", "", "gloria gloria b", "c, c", None]
    lines = spark.createDataFrame(list(enumerate(texts)), "key int, norm string").withColumn("ts", tx.split_tokens(F.col("norm")))
    told = lines.selectExpr("explode(ts) as token").distinct().selectExpr("token", "int(token = 'c') as oov", "int(token = 'b') as mapped", "0 as varied")
    shared = refrains.shared(lines.selectExpr("norm as line"), spark.createDataFrame([(1, "c, c gloria gloria"), (2, "x gloria gloria b c, c")], "key int, text string"))
    found = []
    for few in (errors.FEW, 0):
        monkeypatch.setattr(errors, "FEW", few)
        out = errors.tagged_lines(lines, told, shared)
        found.append({r["key"]: (r["ts"], r["oov_tokens"], r["variant_mapped_tokens"], r["tags"]) for r in out.collect()})
        assert ("hashpartitioning(word" in out.select("key", "tags")._jdf.queryExecution().executedPlan().toString()) == (few == 0)
    assert found[0] == found[1] and found[0][0] == (["a", "b", "c", "'d'", "e"], "c", "b", "unknown")
    assert found[0][4] == (["c", "c"], "c;c", "", "short_phrase,high_oov,shared_refrain") and found[0][5] == (None, "", "", "short_phrase") and found[0][3][3] == "short_phrase,loanword_heavy"
