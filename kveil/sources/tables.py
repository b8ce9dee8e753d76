"""Table readers and writers."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.functions.casting import quoted


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    sep: str = ",",
) -> DataFrame:
    """CSV table; without a schema every column is text, as no inference pass is made."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A job's input: parquet when the path says so, else CSV with a header."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_csv(
    df: DataFrame, path: str, header: bool = True, sep: str = ",", single_file: bool = False
) -> None:
    """CSV folder. ``single_file`` funnels all rows through one task: for small reports only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line per row, values joined by ``sep``; a NULL is written as empty text."""
    cells = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).write.mode("overwrite").text(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in key order (a top-n, not a full sort)."""
    return df.orderBy(*[F.col(quoted(k)) for k in keys]).limit(n)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
