"""Word and character n-grams, TF-IDF blocks and the assembled feature vector."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions.lexicons import SIGNALS
from msgrisk.functions.signals import TMP, normal_for_tfidf, with_signals
from msgrisk.functions.urls import Suffixes


def words(text: Column) -> Column:
    """Words of two or more word characters."""
    # runs of word characters begin and end at boundaries anyway; a to z and digits stand first, as they are cheap to tell
    return F.regexp_extract_all(text, F.lit(r"(?U)[a-z0-9\w][a-z0-9\w]+"), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def word_ngrams(text: Column) -> Column:
    """Words and pairs of neighbouring words."""

    def grams(w: Column) -> Column:
        n = F.size(w)
        pairs = F.when(n > 1, F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(1))), F.slice(w, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    return once(words(text), grams)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by a space; a shorter word is given once."""

    def of_padded(p: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n <= F.length(p)) | (n == low))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))))

    padded = F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of_padded))


def document_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, df, idf) with idf = ln((1 + n) / (1 + df)) + 1; the count of documents rides along as a scalar."""
    n = df.count()
    counts = df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.withColumn("idf", F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def featurised(df: DataFrame, suffixes: Suffixes, text: str = "text") -> DataFrame:
    """Signals, n-gram columns; every row once. A null text has no terms and no signal."""
    df = with_signals(df, suffixes, text, keep=True)
    own = [c for c in df.columns if c not in (*SIGNALS, f"{TMP}canon")]
    normal = normal_for_tfidf(F.col(f"{TMP}canon"), suffixes).alias(f"{TMP}normal")
    # the optimiser puts expressions in the places that use them, unless a generator made them: so each is evaluated once a row
    df = df.select(*own, F.inline(F.array(F.struct(normal, *(F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS)))))
    none = F.array().cast("array<string>")
    terms = [F.coalesce(grams(F.col(f"{TMP}normal")), none).alias(name) for name, grams in (("word_terms", word_ngrams), ("char_terms", char_ngrams))]
    return df.select(*own, *SIGNALS, *terms)


@dataclass
class FeatureModel:
    """Fitted blocks and the names of all features, in order."""

    model: PipelineModel
    names: list[str]

    def save(self, path: str) -> None:
        """The pipeline and the names (one JSON line) under ``path``."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(json.dumps(self.names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")

    @staticmethod
    def load(path: str) -> "FeatureModel":
        names = json.loads(SparkSession.active().read.text(f"{path}/names").first()["value"])
        return FeatureModel(PipelineModel.load(f"{path}/pipeline"), names)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop("word_counts", "char_counts", "word_idf", "char_idf", "word_scaled", "char_scaled", "word_tfidf", "char_tfidf", "word_terms", "char_terms")


def fit_features(df: DataFrame, min_df: float = 2.0) -> FeatureModel:
    """Fit on featurised rows; every term of ``min_df`` rows or more has a feature. Each block is scaled by idf + 1 and normalised on its own."""
    stages, names, now = [], [], df
    for block in ("word", "char"):
        counts = CountVectorizer(inputCol=f"{block}_terms", outputCol=f"{block}_counts", minDF=min_df, vocabSize=(1 << 31) - 1).fit(now)
        now = counts.transform(now)
        idf = IDF(inputCol=f"{block}_counts", outputCol=f"{block}_idf").fit(now)
        scale = Vectors.dense([x + 1.0 for x in idf.idf.toArray()])
        stages += [
            counts, ElementwiseProduct(inputCol=f"{block}_counts", outputCol=f"{block}_scaled", scalingVec=scale),
            Normalizer(inputCol=f"{block}_scaled", outputCol=f"{block}_tfidf", p=2.0),
        ]
        names += [f"{block}_tfidf__{t}" for t in counts.vocabulary]
    stages.append(VectorAssembler(inputCols=["word_tfidf", "char_tfidf", *SIGNALS], outputCol="features", handleInvalid="keep"))
    return FeatureModel(Pipeline(stages=stages).fit(now.drop("word_idf", "char_idf", "word_counts", "char_counts")), names + [f"engineered__{s}" for s in SIGNALS])
