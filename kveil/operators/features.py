"""Encoding of table columns into feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.functions.casting import quoted
from kveil.operators.project import with_dense_id

# StringIndexer keeps a column's labels in the driver; columns beyond this many are joined instead
MAX_LABELS = 100_000


def index_name(c: str) -> str:
    return f"{c}_Index"


def vector_name(c: str) -> str:
    return f"{c}_vec"


def label_table(df: DataFrame, col: str) -> DataFrame:
    """``(label, label_index)``: labels by falling frequency, then by text, numbered from 0."""
    counts = (
        df.select(F.col(quoted(col)).cast("string").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg((-F.count(F.lit(1))).alias("neg"))
    )
    ranked = with_dense_id(counts, ["neg", "label"], id_col="rank", unique=True)
    return ranked.select("label", (F.col("rank") - 1).cast("double").alias("label_index"))


def string_index(df: DataFrame, cols: Sequence[str], max_labels: int = MAX_LABELS) -> DataFrame:
    """Adds ``<col>_Index``; NULL gets the index after the last label."""
    sizes = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if sizes[f"c{i}"] <= max_labels]
    out = df
    if few:
        indexer = StringIndexer(
            inputCols=few, outputCols=[index_name(c) for c in few], handleInvalid="keep"
        )
        out = indexer.fit(df).transform(df)
    for c in [c for c in cols if c not in few]:
        table = label_table(df, c)
        after = table.count()
        text = F.col(quoted(c)).cast("string")
        out = out.join(table, text == F.col("label"), "left").withColumn(
            index_name(c), F.coalesce("label_index", F.lit(float(after)))
        ).drop("label", "label_index")
    return out


def encode(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    encoding: str = "index",
    label: str | None = None,
    include_label: bool = False,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Adds ``<col>_Index``, ``<col>_vec`` and ``features`` made of either.

    The label is indexed too, but is a feature only on request.
    """
    cols = list(cols or df.columns)
    inputs = [c for c in cols if include_label or c != label]
    named = cols + ([label] if label and label not in cols else [])
    indexed = string_index(df, named, max_labels)
    hot = OneHotEncoder(
        inputCols=[index_name(c) for c in named],
        outputCols=[vector_name(c) for c in named],
        dropLast=False,
        handleInvalid="error",
    )
    pick = {"index": index_name, "onehot": vector_name}[encoding]
    assemble = VectorAssembler(inputCols=[pick(c) for c in inputs], outputCol="features")
    return Pipeline(stages=[hot, assemble]).fit(indexed).transform(indexed)


def dense(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Adds a vector column as a plain array, zeros written out."""
    return df.withColumn(out, vector_to_array(F.col(quoted(vector))))
