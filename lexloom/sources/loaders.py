"""Readers of corpora, word lists, lexicons and genre folders, and the writers of results.

Files are listed and named by the driver; their content is read by Spark.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import stripped
from lexloom.operators.lexicon import first_entries

LEXICON = "headword string, source string, pos string, gloss string, lemma string, normalised_form string, context string, ord bigint"
#: What a CSV cell may say for no value.
NO_VALUE = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def known(c: Column) -> Column:
    """A CSV cell, null where it says that there is no value."""
    return F.when(~c.isin(*NO_VALUE), c)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid (a byte order mark stays), else Latin-1, which takes any byte."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def unique_words(spark: SparkSession, path: str) -> DataFrame:
    """(idx, word): one word a line, in lower case, without a leading ``N.``; blank lines are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("idx", "line")).select("idx", stripped(F.col("line")).alias("line")).where("line <> ''")
    numbered = F.regexp_extract("line", r"^\d+\.\s+(.+)$", 1)
    return lines.select("idx", F.lower(F.when(numbered != "", numbered).otherwise(F.col("line"))).alias("word"))


def house_column(name: str) -> str:
    """The column a header stands for, by what it contains; an unknown header keeps its name."""
    low = name.lower().strip()
    if low == "word":
        return "Word"
    for parts, column in ((("number",), "Number"), (("normalized", "normalised"), "Normalized_Ilocano"), (("lemma", "root"), "Lemma_Root"), (("pos",), "UPOS_Tag"), (("english", "translation"), "English_Translation"), (("context", "example"), "Context_Example")):
        if any(p in low for p in parts):
            return column
    return name


def _files(folder: str, pattern: str) -> list[Path]:
    return sorted(Path(folder).glob(pattern)) if Path(folder).is_dir() else []


def house_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """LEXICON rows of all CSV files, in the order of their names; the first entry of a headword stays. Headers may be in
    any order and spelling; unknown columns are ignored; empty headwords and those of NO_VALUE are dropped (in any case: nan)."""
    out = None
    for i, file in enumerate(_files(folder, "*.csv")):
        header = next(csv.reader([_first_line(file)]), [])
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(header))])
        at = {}
        for k, h in enumerate(header):
            at.setdefault(house_column(h), f"c{k}")
        rows = spark.read.schema(schema).csv(str(file), header=True, multiLine=True, escape='"', encoding=_encoding(file)).withColumn("_row", F.monotonically_increasing_id())
        cell = lambda c: known(F.col(at[c])) if c in at else F.lit(None).cast("string")  # noqa: B023, E731
        one = rows.select(F.lower(F.trim(cell("Word"))).alias("headword"), F.lit("house").alias("source"), cell("UPOS_Tag").alias("pos"), cell("English_Translation").alias("gloss"), cell("Lemma_Root").alias("lemma"), F.lower(F.trim(cell("Normalized_Ilocano"))).alias("normalised_form"), cell("Context_Example").alias("context"), (F.lit(i).cast("bigint") * (1 << 40) + F.col("_row")).alias("ord"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], LEXICON)
    return first_entries(out.where("headword <> '' and headword <> 'nan'"), ["ord"])


def _first_line(file: Path) -> str:
    with file.open("rb") as f:
        raw = f.readline()
    try:
        return raw.decode("utf-8-sig").rstrip("\r\n")
    except UnicodeDecodeError:
        return raw.decode("latin-1").rstrip("\r\n")


def _encoding(file: Path) -> str:
    with file.open("rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            try:
                block.decode("utf-8")
            except UnicodeDecodeError as e:
                if e.start < len(block) - 4:
                    return "ISO-8859-1"
    return "UTF-8"


def _lexicon(df: DataFrame, source: str, headword: Column, gloss: Column | None = None, pos: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    rows = df.select(F.lower(F.trim(headword)).alias("headword"), F.lit(source).alias("source"), (pos if pos is not None else null).alias("pos"), (gloss if gloss is not None else null).alias("gloss"), null.alias("lemma"), null.alias("normalised_form"), null.alias("context"), F.monotonically_increasing_id().alias("ord"))
    return rows.where("headword <> ''")


def dictionary_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """LEXICON rows of a dictionary dump, one JSON object a line; bad lines are dropped, all entries of a word stay."""
    schema = "word string, pos string, senses array<struct<glosses: array<string>>>"
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("word is not null")
    glosses = F.array_join(F.flatten(F.transform(F.coalesce("senses", F.array().cast("array<struct<glosses:array<string>>>")), lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>")))), "; ")
    return _lexicon(df, "wiktionary", F.col("word"), F.nullif(glosses, F.lit("")), F.col("pos"))


def expressions_json(spark: SparkSession, path: str) -> DataFrame:
    """LEXICON rows of an expression list: ``{"result": [...]}`` or a bare list of objects with txt or word, or strings."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    items = F.coalesce(F.from_json(F.get_json_object("v", "$.result"), "array<string>"), F.from_json("v", "array<string>"))
    each = text.select(F.explode(items).alias("x"))
    word = F.coalesce(F.get_json_object("x", "$.txt"), F.get_json_object("x", "$.word"), F.when(~F.col("x").startswith("{"), F.col("x")))
    return _lexicon(each, "panlex", word)


def user_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """LEXICON rows of a user's files: CSV with headword and gloss by position, TXT with one headword a line."""
    out = spark.createDataFrame([], LEXICON)
    for file in _files(folder, "*.csv"):
        df = spark.read.csv(str(file), header=True)
        out = out.unionByName(_lexicon(df, "user_supplied", known(F.col(f"`{df.columns[0]}`")), known(F.col(f"`{df.columns[1]}`")) if len(df.columns) > 1 else None))
    for file in _files(folder, "*.txt"):
        out = out.unionByName(_lexicon(spark.read.text(str(file)), "user_supplied", F.col("value")))
    return out


GENRE_DOCUMENT = "doc_id string, text string, lines array<string>, genre string, source string, unit_id int"


def genre_folder(spark: SparkSession, folder: str, genre: str) -> DataFrame:
    """GENRE_DOCUMENT rows of the TXT files: blocks between blank lines. Empty blocks are dropped, but counted in the id."""
    out = spark.createDataFrame([], GENRE_DOCUMENT)
    for file in _files(folder, "*.txt"):
        blocks = spark.read.text(str(file), wholetext=True).select(F.posexplode(F.split("value", "\n\n")).alias("i", "block"))
        lines = F.filter(F.transform(F.split("block", "\n"), stripped), lambda x: x != "")
        rows = blocks.select("i", lines.alias("lines")).where("size(lines) > 0")
        out = out.unionByName(rows.select(F.concat_ws("_", F.lit(genre), F.lit(file.stem), F.col("i").cast("string")).alias("doc_id"), F.array_join("lines", "\n").alias("text"), "lines", F.lit(genre).alias("genre"), F.lit(file.stem).alias("source"), F.lit(None).cast("int").alias("unit_id")))
    return out


def genres(spark: SparkSession, folder: str, songs: DataFrame | None = None, song_source: str = "corpus") -> DataFrame:
    """Songs (unit_id, lines) and the genre folders that exist, in one table."""
    out = spark.createDataFrame([], GENRE_DOCUMENT)
    if songs is not None:
        out = out.unionByName(songs.select(F.concat(F.lit("song_"), F.col("unit_id").cast("string")).alias("doc_id"), F.array_join("lines", "\n").alias("text"), "lines", F.lit("song").alias("genre"), F.lit(song_source).alias("source"), F.col("unit_id").cast("int").alias("unit_id")))
    for genre in ("basic_text", "conversation", "poetry"):
        out = out.unionByName(genre_folder(spark, f"{folder}/{genre}", genre))
    return out


def positive_only(docs: DataFrame) -> bool:
    """Whether all documents are songs."""
    return docs.where("genre <> 'song'").isEmpty()


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Bounds drawn by hand, as half-open ranges of line numbers; for segments.detect_units."""
    return spark.read.schema("title string, start_line int, end_line int, unit_type string").csv(path, header=True)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A result table as CSV with a header; large ones stay in one file for each task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_refrains(pairs: DataFrame, path: str, block: int = 1000) -> None:
    """Distinct (line, unit_key) as CSV rows (line, block, song_ids): the ids as a JSON list, in blocks of about that many,
    so that a line of very many songs is no single row."""
    sizes = pairs.groupBy("line").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("unit_key"), F.lit(max(1, -(-top // block))))
    ids = pairs.groupBy("line", part.alias("block")).agg(F.to_json(F.array_sort(F.collect_list("unit_key"))).alias("song_ids"))
    write_csv(ids, path)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a small result as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |\n" for r in rows)
