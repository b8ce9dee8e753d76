"""Job files: one multi-line JSON document with paths, column roles, parameters and hierarchies."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kveil.functions.casting import CATEGORY, NUMERIC, quoted

DGH_SCHEMA = "attr string, value string, parent string, level int, position string"
ATTRIBUTE_SCHEMA = "attrName string, dataType string"


@dataclass(frozen=True)
class Attribute:
    name: str
    data_type: str = CATEGORY

    @property
    def is_numeric(self) -> bool:
        return self.data_type != CATEGORY


def category(name: str) -> Attribute:
    return Attribute(name, CATEGORY)


def numeric(name: str) -> Attribute:
    return Attribute(name, NUMERIC)


@dataclass(frozen=True)
class Roles:
    """Which columns identify a person, hint at one (quasi-identifiers), or are the payload."""

    quasi: tuple[Attribute, ...] = ()
    sensitive: tuple[Attribute, ...] = ()
    identifiers: tuple[Attribute, ...] = ()

    def __post_init__(self):
        clash = {a.name for a in self.identifiers} & {a.name for a in self.quasi}
        if clash:
            raise ValueError(f"columns are both identifier and quasi-identifier: {sorted(clash)}")

    @property
    def selected(self) -> tuple[Attribute, ...]:
        """Quasi-identifiers, then sensitive columns; the first mention of a name wins."""
        first: dict[str, Attribute] = {}
        for a in self.quasi + self.sensitive:
            first.setdefault(a.name, a)
        return tuple(first.values())

    @property
    def numeric_quasi(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.quasi if a.is_numeric)

    @property
    def category_quasi(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.quasi if not a.is_numeric)


@dataclass(frozen=True)
class JobSpec:
    input_path: str | None = None
    input_path2: str | None = None
    output_path: str | None = None
    k: int | None = None
    cap: int | None = None
    model_name: str | None = None
    kmeans_k: int | None = None
    label: str | None = None
    training_set: float | None = None
    test_set: float | None = None
    roles: Roles = field(default_factory=Roles)
    selected: tuple[Attribute, ...] = ()
    dgh: DataFrame | None = None


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def has_field(schema: T.StructType, dotted: str) -> bool:
    node = schema
    for part in dotted.split("."):
        if not isinstance(node, T.StructType) or part not in node.names:
            return False
        node = node[part].dataType
    return True


def read_attributes(config: DataFrame, element: str) -> DataFrame:
    """Rows ``(attrName, dataType)`` of one attribute list; empty when the job has no such list."""
    if not has_field(config.schema, element):
        return config.sparkSession.createDataFrame([], ATTRIBUTE_SCHEMA)
    return config.select(F.explode(quoted(element)).alias("a")).select("a.attrName", "a.dataType")


def read_dgh(config: DataFrame) -> DataFrame:
    """Hierarchy rows of every attribute, from either layout of the job file.

    An attribute holds its rows directly, or under ``generalization`` beside a ``tree`` name.
    """
    top = "domain_generalization_hierarchy"
    parts = []
    if has_field(config.schema, top):
        for attr in config.schema[top].dataType:
            rows = F.col(f"{top}.{quoted(attr.name)}")
            if isinstance(attr.dataType, T.StructType):
                if "generalization" not in attr.dataType.names:
                    continue
                rows = rows["generalization"]
            parts.append(
                config.select(F.explode(rows).alias("r")).select(
                    F.lit(attr.name).alias("attr"),
                    F.col("r.value").alias("value"),
                    F.col("r.parent").alias("parent"),
                    F.col("r.level").cast("string").try_cast("int").alias("level"),
                    F.col("r.position").alias("position"),
                )
            )
    if not parts:
        return config.sparkSession.createDataFrame([], DGH_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def load_spec(spark: SparkSession, path: str) -> JobSpec:
    config = read_config(spark, path).cache()
    try:
        scalars = {
            "input_path": "input_path",
            "input_path2": "input_path2",
            "output_path": "output_path",
            "k": "k",
            "cap": "num_sample_datas",
            "model_name": "model_name",
            "kmeans_k": "k_means.k",
            "label": "naive_bayes.label",
            "training_set": "naive_bayes.training_set",
            "test_set": "naive_bayes.test_set",
        }
        present = {k: v for k, v in scalars.items() if has_field(config.schema, v)}
        row = config.select(*[F.col(v).alias(k) for k, v in present.items()]).first()
        lists = {
            name: tuple(Attribute(*r) for r in read_attributes(config, name).collect())
            for name in ("quasi_identifier", "sensitive_identifier", "identifier", "selected_column")
        }
        dgh_rows = read_dgh(config).collect()
    finally:
        config.unpersist()
    return JobSpec(
        **(row.asDict() if row is not None else {}),
        roles=Roles(lists["quasi_identifier"], lists["sensitive_identifier"], lists["identifier"]),
        selected=lists["selected_column"],
        dgh=spark.createDataFrame(dgh_rows, DGH_SCHEMA),
    )
