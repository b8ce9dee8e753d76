"""Job: mine the normal and the anonymized table alike and compare the scores."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.functions.casting import CATEGORY, quoted
from kveil.operators.features import encode, index_name
from kveil.operators.mining import accuracy, kmeans, naive_bayes, silhouette, split_at_random, split_by_key
from kveil.operators.project import cap, cols, predictor_columns, select_typed
from kveil.session import cut_lineage
from kveil.sources.config import JobSpec, load_spec
from kveil.sources.tables import literal_table, read_table, write_csv

COMPARISON = "Info string, score double, metric string"
METRIC = {"k_means": "silhouette", "naive_bayes": "accuracy"}
FOLDER = {"k_means": "k-means", "naive_bayes": "naive-bayes"}


@dataclass(frozen=True)
class Examination:
    normal: DataFrame
    anonymized: DataFrame | None
    comparison: DataFrame


def comparison_table(spark: SparkSession, metric: str, normal: float, anonymized: float) -> DataFrame:
    rows = [
        ("Normal table", normal, metric),
        ("Anonymize table", anonymized, metric),
        ("Difference", abs(normal - anonymized), metric),
    ]
    return literal_table(spark, rows, COMPARISON)


def model_kind(spec: JobSpec) -> str:
    for kind in METRIC:
        if kind in (spec.model_name or ""):
            return kind
    raise ValueError(f"unknown model {spec.model_name!r}; known: {sorted(METRIC)}")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` dealt out to all workers.

    A Parquet file of one row group is read, and whatever is made from it passed over, by one task.
    """
    return df.hint("rebalance", F.col(quoted(key))) if key else df.hint("rebalance")


def score_table(
    df: DataFrame, spec: JobSpec, key: str | None = None, seed: int = 0, include_label: bool = False
) -> tuple[DataFrame, float]:
    """Predictions of one table with its plain columns, and their score.

    The table is written once, as encoding and fitting each pass over it, and so are the predictions with their features,
    which scoring passes over several times.
    """
    df = cut_lineage(spread(df, key))
    names = [c for c in df.columns if c != key]
    if model_kind(spec) == "k_means":
        _, predictions = kmeans(encode(df, names), spec.kmeans_k, seed)
    else:
        table = encode(df, names, label=spec.label, include_label=include_label)
        weights = (0.7 if spec.training_set is None else spec.training_set, spec.test_set)
        if key is None:
            training, test = split_at_random(table, weights[0], seed, weights[1])
        else:
            training, test = split_by_key(table, key, *weights)
        for part, rows in (("training", training), ("test", test)):
            if rows.isEmpty():
                raise ValueError(f"no {part} rows with weights {weights}")
        _, predictions = naive_bayes(training, test, spec.label)
    plain = predictor_columns(predictions)
    keep = ([key] if key and key not in plain else []) + plain
    needed = ["features"] if model_kind(spec) == "k_means" else [index_name(spec.label)]
    predictions = cut_lineage(predictions.select(*cols(keep + [c for c in [*needed, "prediction"] if c not in keep])))
    score = silhouette(predictions) if model_kind(spec) == "k_means" else accuracy(predictions, spec.label)
    return predictions.select(*cols(keep)), score


def examine(
    before: DataFrame,
    after: DataFrame | None,
    spec: JobSpec,
    key: str | None = None,
    seed: int = 0,
    include_label: bool = False,
) -> Examination:
    """Scores ``before`` and, unless it is None, ``after``.

    Quasi-identifiers of ``after`` are labels such as ``[28-49]`` and are read as text.
    """
    spark = before.sparkSession
    keep = [key] if key else []
    chosen = tuple(a for a in spec.selected if a.name != key)
    normal, score = score_table(select_typed(before, chosen, keep), spec, key, seed, include_label)
    metric = METRIC[model_kind(spec)]
    if after is None:
        return Examination(normal, None, literal_table(spark, [("Normal table", score, metric)], COMPARISON))
    as_text = [replace(a, data_type=CATEGORY) for a in chosen]
    anonymized, other = score_table(select_typed(after, as_text, keep), spec, key, seed, include_label)
    return Examination(normal, anonymized, comparison_table(spark, metric, score, other))


def run_examine(
    spark: SparkSession, path: str, key: str | None = None, seed: int = 0, single_file: bool = False
) -> dict[str, str]:
    """Runs the job file at ``path``; ``key`` names the column that the row cap and the split go by."""
    spec = load_spec(spark, path)
    before = read_table(spark, spec.input_path)
    after = read_table(spark, spec.input_path2) if spec.input_path2 else None
    if key:
        before = cap(before.withColumn(key, before[key].cast("long")), spec.cap, key)
        after = None if after is None else cap(after.withColumn(key, after[key].cast("long")), spec.cap, key)
    elif spec.cap is not None:
        raise ValueError("a row cap needs the name of the key column")
    made = examine(before, after, spec, key, seed)
    kind = model_kind(spec)
    base = f"{spec.output_path.rstrip('/')}/{FOLDER[kind]}"
    out = {"normal-table": made.normal, "anonymize-table": made.anonymized, f"{METRIC[kind]}-score": made.comparison}
    for name, table in out.items():
        if table is not None:
            write_csv(table, f"{base}/{name}", single_file=single_file)
    return {name: f"{base}/{name}" for name, table in out.items() if table is not None}
