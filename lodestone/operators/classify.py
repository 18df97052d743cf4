"""A small feed-forward net over bags of words and word pairs: vocabulary, counts, training, inference, held-out error."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_words", tx.tokens(F.col("text")))


def features(words: int = 1024, pairs: int = 512, least: int = 3) -> list:
    """Stages that count the most frequent words and pairs of at least ``least`` documents."""
    one = CountVectorizer(inputCol="_words", outputCol="_one", vocabSize=words, minDF=least)
    two = NGram(n=2, inputCol="_words", outputCol="_pairs")
    count = CountVectorizer(inputCol="_pairs", outputCol="_two", vocabSize=pairs, minDF=least)
    return [one, two, count, VectorAssembler(inputCols=["_one", "_two"], outputCol="_features")]


def counted(docs: DataFrame, **sizes) -> DataFrame:
    """docs with ``features``: the ids and counts of their vocabulary words."""
    made = Pipeline(stages=features(**sizes)).fit(with_words(docs)).transform(with_words(docs))
    return made.withColumn("features", F.col("_features")).drop("_words", "_one", "_pairs", "_two", "_features")


def train(docs: DataFrame, label: str, hidden: int = 8, epochs: int = 60, seed: int = 1, **sizes) -> PipelineModel:
    """Fits on docs (text, label of 0 and 1)."""
    rows = with_words(docs.where(F.col(label).isin(0, 1)).withColumn("_label", F.col(label).cast("double")))
    vectors = Pipeline(stages=features(**sizes)).fit(rows)
    size = len(vectors.stages[0].vocabulary) + len(vectors.stages[2].vocabulary)
    net = MultilayerPerceptronClassifier(layers=[size, hidden, 2], maxIter=epochs, seed=seed, featuresCol="_features", labelCol="_label")
    return PipelineModel([*vectors.stages, net.fit(vectors.transform(rows))])


def score(model: PipelineModel, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``unfit``: whether it is over the threshold."""
    made = model.transform(with_words(docs))
    value = vector_to_array("probability")[1]
    return made.select(*docs.columns, value.alias("score"), (value > threshold).alias("unfit"))
