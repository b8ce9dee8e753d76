"""k-means, naive Bayes and their scores."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.operators.features import index_name

HASH_RANGE = 1 << 32


def kmeans(df: DataFrame, k: int, seed: int = 0, features: str = "features") -> tuple[KMeansModel, DataFrame]:
    """Fitted model and ``df`` with ``prediction``."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="prediction").fit(df)
    return model, model.transform(df)


def silhouette(predictions: DataFrame, features: str = "features", prediction: str = "prediction") -> float:
    """Mean silhouette by squared Euclidean distance; 0.0 when all rows share one cluster."""
    seen = predictions.agg(F.min(prediction).alias("lo"), F.max(prediction).alias("hi")).first()
    if seen.lo == seen.hi:
        return 0.0
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(predictions)


def training_share(training: float, test: float | None = None) -> float:
    """The share of rows that train; the two numbers are weights, and the second defaults to the rest of 1."""
    test = 1 - training if test is None else test
    if not (training > 0 and test > 0):
        raise ValueError(f"weights of training and test rows must be positive, got {training} and {test}")
    return training / (training + test)


def split_by_key(
    df: DataFrame, key: str, training: float = 0.7, test: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by weight, told apart by the first 32 bits of the MD5 of the key's text.

    The same rows on every run, whatever the steps between keys. Rows without a key train.
    """
    cut = round(training_share(training, test) * HASH_RANGE)
    digits = F.substring(F.md5(F.col(quoted(key)).cast("string")), 1, 8)
    place = F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0).cast("long"))
    return df.where(place < cut), df.where(place >= cut)


def split_at_random(
    df: DataFrame, training: float, seed: int, test: float | None = None
) -> tuple[DataFrame, DataFrame]:
    share = training_share(training, test)
    first, second = df.randomSplit([share, 1 - share], seed)
    return first, second


def naive_bayes(
    training: DataFrame, test: DataFrame, label: str, features: str = "features"
) -> tuple[NaiveBayesModel, DataFrame]:
    """Multinomial model with smoothing 1, and the test rows with ``prediction``."""
    model = NaiveBayes(
        modelType="multinomial", smoothing=1.0, labelCol=index_name(label), featuresCol=features
    ).fit(training)
    return model, model.transform(test)


def accuracy(predictions: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(
        labelCol=index_name(label), predictionCol="prediction", metricName="accuracy"
    ).evaluate(predictions)


def accuracy_table(predictions: DataFrame, label: str) -> DataFrame:
    """One row: test rows and the share predicted right."""
    hit = (F.col(quoted(index_name(label))) == F.col("prediction")).cast("double")
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
