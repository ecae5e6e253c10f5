"""The training-data operators against brute force on small tables, with nulls, blanks, ties, long texts and odd columns."""

import collections
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexloom.llm import bags, bpe, format_duplicates, grouped_splits, leaks, lookalikes, near_duplicates, split_overlap, term_counts, truncation
from lexloom.llm.words import words_of

EXTRA = ", count bigint, bucket string, `class` string, side int, row_id string"


def overlap(a, b):
    a, b = (words_of(x) for x in (a, b))
    if min(len(a), len(b)) < 20:
        return 0
    x, y = (collections.Counter(zip(w, w[1:])) for w in (a, b))
    return sum((x & y).values()) / max(sum(x.values()), sum(y.values()))


def pages(n, seed):
    """Texts with copies, small edits, short ones, nulls and a repetitive long one."""
    rnd, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(300)]
    for i in range(n):
        if out and rnd.random() < 0.5:
            ws = (rnd.choice(out) or "").split(" ")
            for _ in range(rnd.randrange(4)):
                if ws:
                    ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
            out.append(" ".join(ws).upper() if rnd.random() < 0.3 else "\n".join(ws))
        else:
            out.append(" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 19, 25, 40, 60]))))
    return [*out, None, "", "  ", "la " * 5000, "la " * 4000, "la " * 2000]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, ["train", "validation", "test", "train", None][i % 5], 1, "x", "y", 3, "z") for i, t in enumerate(pages(160, 1))]
    return spark.createDataFrame(rows, "k bigint, t string, split string" + EXTRA), rows


def want_pairs(rows, crossed):
    side = {"train": 1, "validation": 2, "test": 2}
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            ok = not crossed or side.get(a[2], 0) + side.get(b[2], 0) == 3
            if ok and a[1] and b[1] and overlap(a[1], b[1]) >= 0.6:
                out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("run", [bags.RUN, 2])
def test_near_duplicates(spark, texts, run, monkeypatch):
    monkeypatch.setattr(bags, "RUN", run)  # at 2 almost all goes the exact way of large buckets
    df, rows = texts
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "k", "t").collect()}
    want = want_pairs(rows, False)
    assert len(want) > 15 and got == want


def formula_rows(n):
    """A formula of 60 words in a third of the rows, each with words of its own beside it: overlap 0.66."""
    formula = [f"f{i}" for i in range(60)]
    return [(i, " ".join((formula if i % 3 == 0 else [f"r{i}x{j}" for j in range(60)]) + [f"o{i}x{j}" for j in range(30)]), ["train", "test"][i // 3 % 2]) for i in range(n)]


def test_common_formula(spark):
    rows = formula_rows(300)
    df = spark.createDataFrame(rows, "k bigint, t string, split string")
    want = {(a, b) for a in range(0, 300, 3) for b in range(a + 3, 300, 3)}
    assert overlap(rows[0][1], rows[3][1]) >= 0.6 > overlap(rows[0][1], rows[1][1])
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "k", "t").collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    crossed = {(a, b) for a, b in want if (a // 3 + b // 3) % 2}
    got = {tuple(r) for r in split_overlap.cross_split_pairs(df, "k", "t", "split").collect()}
    assert got <= crossed and len(got) >= 0.98 * len(crossed)


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        p, q = find(x), find(y)
        parent[max(p, q)] = min(p, q)
    return find


@pytest.mark.parametrize("run", [bags.RUN, 2])
def test_groups(spark, texts, run, monkeypatch):
    monkeypatch.setattr(bags, "RUN", run)
    df, rows = texts
    got = {r["key"]: (r["group_key"], r["size"]) for r in near_duplicates.near_duplicate_groups(df, "k", "t").collect()}
    find, keys = components(want_pairs(rows, False)), [r[0] for r in rows if len(words_of(r[1])) >= 20]
    sizes = collections.Counter(map(find, keys))
    assert got == {k: (find(k), sizes[find(k)]) for k in keys}
    assert near_duplicates.near_duplicate_groups(df.where("false"), "k", "t").count() == 0


def test_hot_class_and_cluster(spark, monkeypatch):
    """A text that a third of the rows share, and a cluster of edited copies: no key holds them all."""
    monkeypatch.setattr(bags, "RUN", 20)
    monkeypatch.setattr(bags, "BLOCK", 16)
    rnd, vocab = random.Random(9), [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocab) for _ in range(40)]
    rows = [(i, " ".join(base), ["train", "test"][i % 2]) for i in range(60)]
    for i in range(60, 120):
        ws = list(base)
        ws[rnd.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(ws), ["train", "test"][i % 2]))
    rows += [(i, " ".join(rnd.choice(vocab) for _ in range(40)), "train") for i in range(120, 180)]
    df = spark.createDataFrame(rows, "k bigint, t string, split string")
    want = want_pairs(rows, False)
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "k", "t").collect()]
    assert set(got) == want and len(got) == len(want) > 7000
    got = [tuple(r) for r in split_overlap.cross_split_pairs(df, "k", "t", "split").collect()]
    assert set(got) == want_pairs(rows, True) and len(got) == len(set(got))
    groups = {r["key"]: r["group_key"] for r in near_duplicates.near_duplicate_groups(df, "k", "t").collect()}
    assert all(groups[k] == 0 for k in range(120)) and len(set(groups.values())) == 61
    report = split_overlap.overlap_report(df.withColumn("src", F.lit("s")), "k", "t", "split", "src").collect()
    assert [tuple(r) for r in report] == [("test", "s", len(got), 60)]


def test_groups_of_all_units(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(25))
    units = [(1, ["amen"], None), (2, ["amen"], None), (3, None, long), (4, [long], None), (5, None, "")]
    spark.createDataFrame(units, "unit_key bigint, lines array<string>, raw_text string").write.parquet(f"{tmp_path}/liturgical_units.parquet")
    got = {tuple(r) for r in near_duplicates.p6_groups(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1)}


@pytest.mark.parametrize("run", [bags.RUN, 3])
def test_hot_pairs_exact(spark, texts, run, monkeypatch):
    monkeypatch.setattr(bags, "RUN", run)
    df, rows = texts
    parsed = bags.parse(df, "k", "t", F.lit(3))
    b = bags.bags_of(parsed, bags.cut(parsed.where("whole").groupBy("class").agg(F.bit_or("meta").alias("meta"))), tuple(bags._S)).withColumn("g", F.lit(0).cast("bigint"))
    ids = {r["class"]: r["bag"] for r in b.collect()}
    want = {(x, y) for x in ids for y in ids if x < y and len(set(ids[x]) & set(ids[y])) / max(len(ids[x]), len(ids[y])) >= 0.6}
    got = [tuple(r) for r in bags.hot_pairs(b, 0.6).collect()]
    assert want <= set(got) and len(got) == len(set(got))


def test_cross_split(spark, texts):
    df, rows = texts
    got = {tuple(r) for r in split_overlap.cross_split_pairs(df, "k", "t", "split").collect()}
    assert got == want_pairs(rows, True) and got
    assert split_overlap.cross_split_pairs(df.where("false"), "k", "t", "split").count() == 0


def test_runs():
    k, c = np.repeat(np.arange(50), 3), np.tile(np.arange(3), 50)
    table = lambda g, w: [c, np.full(150, 3 + 4 * 30), *[w] * bags.SKETCH, g]
    none = np.zeros(150, np.int64)
    a, b = bags._runs(k, table(none, none), 0.6, False)
    assert len(a) == 150 and set(zip(a.tolist(), b.tolist())) == {(0, 1), (0, 2), (1, 2)}
    a, b = bags._runs(k, table(np.where(c < 2, 7, 8), none), 0.6, False)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 2), (1, 2)}
    a, b = bags._runs(k, table(none, np.where(c == 1, 15, 240)), 0.6, False)  # 16 of 30 elements can't be shared
    assert set(zip(a.tolist(), b.tolist())) == {(0, 2)}
    assert len(bags._runs(k[:0], [x[:0] for x in table(none, none)], 0.6, True)[0]) == 0


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.integers(0, 2**62, 80).astype(np.uint64)
        y = np.concatenate([x[: rng.integers(0, 80)], rng.integers(0, 2**62, 70).astype(np.uint64)])
        e, starts = np.concatenate([x, y]), np.array([0, 80])
        t = [np.array([1, 2]), np.array([4 * len(x) + 3, 4 * len(y) + 3]), *(s.view(np.int64) for s in bags.sketches(e, starts)), np.zeros(2, np.int64)]
        share = len(set(x) & set(y)) / max(len(x), len(y))
        assert bags._joinable(np.array([0]), np.array([1]), t, share)[0]


def test_term_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(term_counts, "BURST", 4)
    monkeypatch.setattr(term_counts, "LEAST", 8)
    df, rows = texts
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts.count_terms(df, "t").collect()}
    occ, rec = collections.Counter(), collections.Counter()
    for r in rows:
        occ.update(words_of(r[1]))
        rec.update(set(words_of(r[1])))
    assert got == {w: (occ[w], rec[w]) for w in occ}
    assert term_counts.count_terms(df.where("false"), "t").count() == 0


def test_trie_round_trip():
    t, rnd = term_counts.BurstTrie(), random.Random(2)
    want = collections.Counter()
    for _ in range(9000):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randrange(9)))
        want[w] += 1
        t.add(w, 1, 1)
    got = collections.Counter()
    for c in t.containers():
        for rest, a, _ in term_counts.unpack(term_counts.pack(c.counts)):
            got[c.prefix + rest] += a
    assert got == want


def test_terms_of_one_long_prefix(spark, monkeypatch):
    """Terms that share 40 characters are split behind them, and spread over routes."""
    monkeypatch.setattr(term_counts, "ROUTES", 64)
    monkeypatch.setattr(term_counts, "LEAST", 100)
    head = "http-example-org-archive-of-old-texts-vol"
    df = spark.range(20000).select(F.concat(F.lit(head), F.col("id").cast("string")).alias("t")).union(spark.range(50).select(F.lit(head)))
    parts = term_counts.cut(term_counts._partial_tries(df.repartition(4), "t", "words"))
    split = term_counts._split_prefixes(parts, 300)
    routes = collections.Counter(term_counts.route_of(f"{head}{i}", split)[0] for i in range(20000))
    assert len(routes) > 64 and max(routes.values()) <= 1200
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts.count_terms(df, "t").collect()}
    assert got == {f"{head}{i}": (1, 1) for i in range(20000)} | {head: (50, 50)}


def test_grafts(monkeypatch):
    monkeypatch.setattr(term_counts, "BURST", 3)
    rnd, want, whole = random.Random(13), collections.Counter(), term_counts.BurstTrie()
    for _ in range(30):
        t = term_counts.BurstTrie()
        for _ in range(rnd.randrange(1, 60)):
            w = "".join(rnd.choice("ab") for _ in range(rnd.randrange(7)))
            want[w] += 1
            t.add(w, 1, 1)
        for c in t.containers():
            whole.graft(c.prefix, term_counts.unpack(term_counts.pack(c.counts)))
    got = {c.prefix + r: n[0] for c in whole.containers() for r, n in c.counts.items()}
    assert got == want and whole.size == len(want)


def test_format_copies(spark):
    rows = [(1, "Ab c", "x", None), (2, "a.b-c", "X ", None), (3, "abc", "x", ""), (4, None, None, None), (5, None, None, None), (6, "ábc", "x", None), (7, "cba", "x", None), (8, "", "", ""), (9, " - ", "!", "."), (10, "ABC", "x", None), (10, "ABC", "x", None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "entry_id bigint, headword string, normalised_form string, source string, _n string, copies int")
    _, members = format_duplicates.format_copies(df, "entry_id")
    got = collections.Counter((r["first_key"], r["entry_id"]) for r in members.collect())
    assert got == {(1, 1): 1, (1, 2): 1, (1, 10): 2, (4, 4): 1, (4, 5): 1, (8, 8): 1, (8, 9): 1}
    assert format_duplicates.format_copies(df.where("false"), "entry_id")[1].count() == 0


def test_costly_keys_only_where_needed(spark):
    rows = [(i, f"word{i}", f"form {i}", "src") for i in range(200)] + [(900, "Word7", "FORM-7", "Src"), (901, "7word", "form 7", "src"), (902, "ＫＡ", None, None), (903, "\u212as", "x", "y"), (904, "ks", "X", "Y.")]
    df = spark.createDataFrame(rows, "entry_id bigint, headword string, normalised_form string, source string")
    several = {r["_k"] for r in format_duplicates.several_members(df, "entry_id", format_duplicates.FIELDS).collect()}
    anagrams = {i for i in range(200) if any(i != j and sorted(str(i)) == sorted(str(j)) for j in range(200))}
    assert several == anagrams | {7, 900, 901, 903, 904}
    assert {(r["first_key"], r["entry_id"]) for r in format_duplicates.format_copies(df, "entry_id")[1].collect()} == {(7, 7), (7, 900), (903, 903), (903, 904)}


def test_histogram_of_slices():
    import pyarrow as pa

    words = pa.array(["Ab c", None, "c-BA", "", "abd", "1a", "a1"])
    whole = format_duplicates.histogram_keys(pa.StructArray.from_arrays([words, words], ["a", "b"])).to_pylist()
    part = format_duplicates.histogram_keys(pa.StructArray.from_arrays([words, words], ["a", "b"]).slice(2, 4)).to_pylist()
    assert whole[2:6] == part and whole[0] == whole[2] and whole[5] == whole[6] and len(set(whole)) == 5


def test_lookalikes(spark):
    rows = [(1, "Susagu lot yok"), (2, "Suѕagu lоt"), (3, "ｓｕｓａｇｕ　yok"), (4, "sus​agu yé"), (5, "песнь λόγος"), (6, None), (7, ""), (8, "“x” – y… ½ º é"), (9, "𝐒usagu ﬁ"), (10, "plain text"), (11, "nυlo vulo nulo nulo"), (12, "x" * 50000 + "­"), (2, "Suѕagu lоt")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "k bigint, t string, plain string")
    got = {r["row_id"]: (r["plain"], r["affected"]) for r in lookalikes.canonical_texts(df, "k", "t").collect()}
    assert {k for k, v in got.items() if v[1]} == {2, 3, 4, 9, 10, 11, 12}
    assert got[2][0] == "Susagu lot" and got[3][0] == "susagu yok" and got[4][0] == "susagu yé" and got[9][0] == "Susagu fi" and got[10][0] == "plain text"
    assert got[6][0] is None and got[7][0] == "" and got[11][0].startswith("nulo ") and got[12][0] == "x" * 50000
    assert lookalikes.canonical_texts(df, "k", "t").count() == len(rows)


def test_automaton():
    t = lookalikes.VocabularyTrie()
    for w, n in (("nulo", 3), ("nvlo", 5), ("kanta", 1)):
        t.add(w, n)
    told = lambda term, budget=0: (lambda x: x and (x[0], x[3], x[4]))(t.canonical(term, budget))
    assert told("nυlo") == (0, "nvlo", "nvlo") and told("kаn‍ta") == (0, "kanta", "kanta") and told("kanto") is None
    assert told("kanto", 1) == (1, "kanta", "kanto") and told("kata", 1) == (1, "kanta", "kata") and told("kаntas", 1) == (1, "kanta", "kantas")
    assert told("nυlos", 1)[2] == "nvlos" and told("xnυlos", 1) is None


def test_routes_meet_within_one_edit():
    rnd = random.Random(11)
    for _ in range(300):
        w = "".join(rnd.choice("abluv") for _ in range(rnd.randrange(2, 9)))
        i = rnd.randrange(len(w))
        for near in (w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]):
            assert not near or set(lookalikes.word_routes(w)) & set(lookalikes.asked_routes(near)), (w, near)


def test_readings_by_near_words(spark):
    """The tries decide how a letter of two readings is read, also where no word is equal, and which rows come out."""
    rows = [(1, "kulasan kulasan mang ivlog"), (2, "kυlasang Μang"), (3, "ivυlog"), (4, "plain")]
    df = spark.createDataFrame(rows, "k bigint, t string")
    got = {r["row_id"]: (r["plain"], r["affected"]) for r in lookalikes.canonical_texts(df, "k", "t").collect()}
    assert got[2] == ("kulasang Mang", True) and got[3][1] and got[4] == ("plain", False)
    assert {r["row_id"] for r in lookalikes.affected_rows(df, "k", "t").collect()} == {2, 3}
    assert lookalikes.affected_rows(df.where("false"), "k", "t").count() == 0


def test_tied_groups(spark):
    rows = [(1, 5, "g", "s"), (2, 5, None, "s"), (3, None, "g", "s"), (4, None, "h", ""), (5, None, "h", ""), (6, 7, "h", "z"), (7, 7, "g", "q"), (8, None, None, None), (9, None, "g", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k bigint, unit_id int, genre string, source string, size int")
    got = {r["k"]: r["group_key"] for r in grouped_splits.tied_groups(df, "k", grouped_splits.TIES).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6}


def test_split_totals(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([1, 1, 2, 3, 7, 20]) for _ in range(300)]
    rows = [(10_000 * g + i, 10_000 * g, s) for g, s in enumerate(sizes) for i in range(s)]
    df = spark.createDataFrame(rows, "k bigint, group_key bigint, size bigint")
    out = grouped_splits.assign_splits(df, "k", [("train", 80), ("validation", 10), ("test", 10)]).collect()
    n = collections.Counter(r["split"] for r in out)
    assert len(out) == len(rows) and abs(n["test"] - len(rows) * 0.1) <= 1 and abs(n["validation"] - len(rows) * 0.1) <= 1
    assert all(len({r["split"] for r in out if r["group_key"] == g}) == 1 for g in {r["group_key"] for r in out})


def test_totals_beyond_the_bits(monkeypatch):
    monkeypatch.setattr(grouped_splits, "BITS", 64)
    rnd = random.Random(3)
    sizes = {rnd.randrange(2, 900): rnd.randrange(1, 30) for _ in range(60)} | {1: 500}
    total = sum(s * n for s, n in sizes.items())
    chosen = grouped_splits.choose_counts(sizes, [("train", 80), ("validation", 10), ("test", 10)])
    assert all(abs(sum(s * n for s, n in chosen[k].items()) - total * 0.1) <= 1 for k in ("validation", "test"))
    assert all(sum(c[s] for c in chosen.values()) == n and min(c[s] for c in chosen.values()) >= 0 for s, n in sizes.items())


def test_closest_subset():
    rnd = random.Random(5)
    for _ in range(40):
        counts = collections.Counter(rnd.choice([2, 5, 9, 14]) for _ in range(rnd.randrange(1, 8)))
        goal, sums = rnd.randrange(40), {0}
        for s in counts.elements():
            sums |= {x + s for x in sums}
        took = sum(s * n for s, n in grouped_splits._closest(counts, goal, 1).items())
        assert abs(took - goal) == min(abs(x - goal) for x in sums)


def test_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(6)
    texts = ["", None, "  \n ", "Hello  world's 123", "<|endoftext|> x", "é" * 700, "ab" * 900, "x" * 257, "日本 🎵🎵", "".join(rnd.choice("abcé ,.\n") for _ in range(4000)), "".join(rnd.choice("abcdefg") for _ in range(3000))]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert bpe.encode(df.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("shard", [60, 15])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    monkeypatch.setattr(leaks, "EXPANDED", 50)
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 400)
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 8, 12, 30])))) for i in range(12)] + [(99, None), (98, "")]
    docs = [(1000 + i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 80])))) for i in range(60)]
    docs += [(2000 + i, "Aa, " + items[i][1].upper().replace(" ", ".\n") + " zz") for i in range(12)] + [(3000, None), (3001, "la " * 20000), (2001, docs[0][1])]
    d, q = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, words int"), spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    got = collections.Counter((r["item_id"], r["doc_id"]) for r in leaks.leaked_passages(d, "doc_id", "text", q, "item_id", "text").collect())
    grams = lambda t: {tuple(w[i : i + 8]) for w in [words_of(t)] for i in range(len(w) - 7)}
    assert got == collections.Counter((i, k) for i, a in items for k, b in docs if grams(a) & grams(b))


def test_longest_leaks(spark):
    rnd = random.Random(12)
    vocab = [f"v{i}" for i in range(3)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(60))) for i in range(25)] + [(90, "la " * 300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(10)] + [(50, "la " * 40)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]): (r["words"], r["doc_at"], r["item_at"]) for r in leaks.leaked_passages(d, "doc_id", "text", q, "item_id", "text").collect()}
    want = {}
    for i, a in items:
        for k, b in docs:
            x, y = words_of(a), words_of(b)
            for n in range(min(len(x), len(y)), 7, -1):
                runs = {tuple(x[p : p + n]): p for p in range(len(x) - n, -1, -1)}
                at = next((p for p in range(len(y) - n + 1) if tuple(y[p : p + n]) in runs), None)
                if at is not None:
                    want[i, k] = (n, at, runs[tuple(y[at : at + n])])
                    break
    assert got == want and want[50, 90] == (40, 0, 0)


def test_leaks_of_one_repeated_word(spark):
    """A shard of one repeated word against a long item of it: linear, not the product."""
    import time

    items = leaks.Items([7], ["la " * 5000], leaks.LEAST)
    words = np.append(np.full(1_000_000, items.query[0]), np.uint64(0))
    began = time.time()
    order = leaks.suffix_array(words, leaks.LEAST)
    assert items.found_in(words, order, np.zeros(len(words), np.int64)).tolist() == [[0], [0]]
    assert leaks.longest_match(words[:-1], items.words(0), leaks.LEAST) == (5000, 0, 0)
    assert time.time() - began < 60


def test_without_leaks(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "w1 w2 w3"), (3, None), (None, text), (1, "other")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, text)], "item_id bigint, text string")
    found = leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "text", places=False)
    assert [tuple(r) for r in found.collect()] == [(5, 1)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in leaks.without_leaks(docs, "doc_id", found).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(0, text), (2, "w1 w2 w3"), (3, "")]


def test_truncation(spark):
    rnd = random.Random(8)
    vocab = [f"{a}{b}{c}" + "lo" * n for a in "ptkm" for b in "aei" for c in "nsr" for n in (0, 1, 2, 3)]
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows, cut = [], set()
    for i in range(400):
        verse = i % 2
        t = "\n".join(sentence(6) for _ in range(rnd.randrange(4, 9))) if verse else " ".join(sentence(7).capitalize() + "." for _ in range(rnd.randrange(4, 9)))
        source = "lim" if i % 4 < 2 and i % 8 < 6 else "free"
        if source == "lim" and len(t) > 150 and i % 3 == 0:
            t = t[:150]
            if not (t.endswith(".") or t.endswith("\n")):
                cut.add(i)
        rows.append((i, t, source, "song" if verse else "basic_text"))
    rows += [(1000, None, "lim", "song"), (1001, "", "lim", "song"), (1002, " \n ", None, None), (1003, sentence(8) + " (Amen.)", "free", "basic_text"), (1004, sentence(6) + "�", "free", None), (1005, sentence(6) + " xan...", "free", "basic_text"), (1006, sentence(6) + "...", "free", "basic_text")]
    cut |= {1004, 1005}
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id bigint, text string, source string, genre string, word string")
    got = {r["doc"] for r in truncation.truncated_texts(df, "doc_id", "text", "source", "genre").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(cut) + 1
    assert truncation.truncated_texts(df.where("false"), "doc_id", "text", "source", "genre").count() == 0


def test_words_in_one_pass(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/genre_documents.parquet").select("text").limit(50).collect()]
    from lexloom.llm.words import PieceHash, word_hashes

    h, at = word_hashes(docs, PieceHash())
    assert np.bincount(at, minlength=len(docs)).tolist() == [len(words_of(t)) for t in docs]
