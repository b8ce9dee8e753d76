"""Job: distinct values of each chosen column, one output per column."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kveil.operators.profile import distinct_profile
from kveil.operators.project import select_typed
from kveil.session import cut_lineage
from kveil.sources.config import load_spec
from kveil.sources.tables import read_table, write_csv


def run_explore(spark: SparkSession, path: str, single_file: bool = False) -> dict[str, str]:
    """Runs the job file at ``path``; one scan of the input serves all columns."""
    spec = load_spec(spark, path)
    table = select_typed(read_table(spark, spec.input_path), spec.selected)
    names = [a.name for a in spec.selected]
    found = cut_lineage(distinct_profile(table, names))
    out = {}
    for name in names:
        out[name] = f"{spec.output_path.rstrip('/')}/{name}"
        values = found.where(found["column"] == name).select(found["value"].alias(name))
        write_csv(values, out[name], single_file=single_file)
    return out
