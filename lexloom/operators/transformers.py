"""Feature blocks as pyspark.ml transformers, for pipelines. Each adds one vector column."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import features as ft


class _Block(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """inputCol is the text; rows are numbered for the join only while features are made."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "features") -> None:  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="text", outputCol="features")
        self._set(**self._input_kwargs)

    def names(self) -> list[str]:
        """The features, in the order of the vector."""
        raise NotImplementedError

    def _made(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Features are made once for each distinct text and joined back by it, null texts get zeros."""
        t, values = self.getInputCol(), F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names()))
        keyed = dataset.withColumn("_h", F.coalesce(F.sha2(F.col(t), 256), F.lit("")))
        texts = keyed.select(F.col("_h").alias("k"), F.coalesce(t, F.lit("")).alias("t")).dropDuplicates(["k"])
        made = self._made(texts).select(F.col("k").alias("_h"), values.alias("_v"))
        return keyed.join(made, "_h", "left").withColumn(self.getOutputCol(), array_to_vector(_zeros(F.col("_v"), len(self.names())))).drop("_h", "_v")


def _zeros(c: Column, n: int) -> Column:
    return F.coalesce(c, F.array(*[F.lit(0.0)] * n))


class TextStats(_Block):
    """Counts and lengths of the text."""

    def names(self) -> list[str]:
        return ["avg_line_length", "avg_token_length", "num_chars", "num_lines", "num_tokens", "num_unique_tokens", "type_token_ratio"]

    def _made(self, docs: DataFrame) -> DataFrame:
        return ft.text_stats(docs, "k", "t")


class Loanwords(_Block):
    """Share and number of loan-word seeds."""

    def names(self) -> list[str]:
        return ["loanword_ratio", "loanwords"]

    def _made(self, docs: DataFrame) -> DataFrame:
        return ft.loanword_features(docs, "k", "t")


class LexiconFeatures(_Block):
    """Coverage by a lexicon, set with on(); zeros without one."""

    _lex: DataFrame | None = None

    def on(self, lex: DataFrame | None) -> LexiconFeatures:
        self._lex = lex
        return self

    def names(self) -> list[str]:
        return ["coverage", "oov", "variant", "pos_diversity", "gloss_ratio"]

    def _made(self, docs: DataFrame) -> DataFrame:
        if self._lex is None:
            return docs.select("k", *(F.lit(0.0).alias(n) for n in self.names()))
        return ft.lexicon_features(docs, "k", "t", self._lex)
