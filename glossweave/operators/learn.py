"""Small models: trees, logistic regression, a perceptron, with Spark ML."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer filter's published decision point in mutual information, and the splits of the relevance tree.
TOKENIZER_BOUNDARY, UNIGRAM_SPLIT, HAMMING_SPLIT = -0.507, 2.5, 9.5


def ratio_features(samples: DataFrame) -> DataFrame:
    """unigram_ratio and hamming_ratio by query length; empty queries go."""
    n = F.length("query")
    return samples.where(n > 0).withColumns({"query_length": n, "unigram_ratio": F.col("unigram_count") / n, "hamming_ratio": F.col("hamming") / n})


def raw_features(samples: DataFrame) -> DataFrame:
    return samples.withColumn("query_length", F.length("query"))


def _fitted(estimator, rows: DataFrame, features: list[str], label: str) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    ready = assembler.transform(rows.withColumn(label, F.col(label).cast("double")))
    return PipelineModel([assembler, estimator.setLabelCol(label).fit(ready)])


def decision_tree(rows: DataFrame, features: list[str], label: str, depth: int = 2, seed: int = 0) -> PipelineModel:
    return _fitted(DecisionTreeClassifier(impurity="gini", maxDepth=depth, seed=seed), rows, features, label)


def logistic_regression(rows: DataFrame, features: list[str], label: str, c: float = 1.0) -> PipelineModel:
    """L2 with inverse strength c, features as they are."""
    n = rows.count()
    return _fitted(LogisticRegression(regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False), rows, features, label)


def perceptron(rows: DataFrame, features: list[str], label: str, hidden: int = 128, iterations: int = 50, seed: int = 0) -> PipelineModel:
    """Two hidden layers; close in kind to, but not the same as, networks with dropout."""
    return _fitted(MultilayerPerceptronClassifier(layers=[len(features), hidden, hidden, 2], maxIter=iterations, seed=seed), rows, features, label)


def shown(model: PipelineModel) -> str:
    return model.stages[-1].toDebugString


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prediction and, where the model has one, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    return out.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction")


def boundary(low: float, high: float, at: float = TOKENIZER_BOUNDARY) -> list[tuple[float, float]]:
    """Two points of a constant line, to plot."""
    return [(low, at), (high, at)]


def plot_points(rows: DataFrame, x: str, y: str, spread: float, seed: int) -> DataFrame:
    """(x, y) with Gaussian jitter, so that equal points can be told apart."""
    return rows.select((F.col(x) + F.randn(seed) * spread).alias("x"), (F.col(y) + F.randn(seed + 1) * spread).alias("y"))
