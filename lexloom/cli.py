"""Command line: ``python -m lexloom.cli search PHRASE -k 3 --corpus FILE`` lists the best songs for a phrase,
``python -m lexloom.cli run --config FILE --out FOLDER [--fast]`` makes every table and the report."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lexloom.operators import retrieval
from lexloom.operators.experiments import Config, load_config
from lexloom.pipeline import corpus_units, run, songs_of
from lexloom.session import local_session


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    find = sub.add_parser("search")
    find.add_argument("phrase")
    find.add_argument("-k", type=int, default=3)
    find.add_argument("--corpus", required=True, help="a text with page marks")
    find.add_argument("--method", default="combined", choices=sorted(retrieval.METHODS))
    every = sub.add_parser("run")
    every.add_argument("--config", required=True)
    every.add_argument("--out", required=True)
    every.add_argument("--fast", action="store_true")
    args = p.parse_args(argv)
    spark = local_session()
    if args.what == "run":
        config = load_config(args.config)
        config.fast_mode |= args.fast
        return sorted(run(spark, config, args.out))
    songs = songs_of(corpus_units(spark, Config(paths={"raw_corpus": args.corpus})))
    index = retrieval.Index(songs.select(F.col("unit_id").alias("doc"), "text"))
    ranked = retrieval.search(index, spark.createDataFrame([(0, args.phrase)], "q int, text string"), args.k, args.method)
    titles = songs.select(F.col("unit_id").alias("doc"), "title")
    return [f"{r['rank']}. {r['score']:.4f}  [{r['doc']}] {r['title']}" for r in ranked.join(titles, "doc").orderBy("rank").collect()]


if __name__ == "__main__":
    print(*main(), sep="\n")
