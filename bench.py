"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Two queries run once untimed to warm the session up, then every query is timed once. Results go
to Spark's ``noop`` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time
import warnings

from checks.queries import QUERIES
from checks.tables import LINE, PERSON, flat, geography, lines, person_hierarchy, persons
from kveil.operators.cluster import greedy_k_member
from kveil.operators.generalize import k_anonymize
from kveil.operators.hierarchy import Hierarchy
from kveil.operators.project import with_dense_id
from kveil.session import local_session
from pyspark.sql import functions as F

HEADLINES = [
    "typed_projection",
    "dense_id_copies",
    "token_count",
    "describe_long",
    "distinct_profile",
    "dedup_report",
    "null_report",
    "dgh_closure",
    "lca_pairs",
    "record_distance",
    "furthest_record",
    "best_cluster",
    "leftover_assign",
    "cluster_info_loss",
    "k_anonymize",
    "k_anonymize_hot",
    "greedy_sizes",
    "greedy_lineitem",
    "anonymize_job",
    "string_index_wide",
    "kmeans_invariants",
    "nb_accuracy",
    "utility_compare",
]


def k_anonymize_lineitem(spark, d):
    """k-anonymity of all lines with given clusters of five neighbours."""
    rows = lines(spark, d)
    rows = rows.withColumn("Cluster", F.floor(F.col("order_key") / 2))
    tree = Hierarchy.build(geography(spark, d).unionByName(flat(rows, "shipped", "Any year", "shipped")))
    return k_anonymize(rows, LINE, tree)


def greedy_customer(spark, d):
    return greedy_k_member(persons(spark, d).drop("Cluster"), PERSON, person_hierarchy(spark, d), 5)


def greedy_lineitem_rows(spark, d):
    rows = with_dense_id(lines(spark, d), order="input")
    return greedy_k_member(rows, LINE, Hierarchy.build(geography(spark, d)), 5)


def run(spark, sf_dir: str, query) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    warnings.simplefilter("ignore")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    for query in (greedy_customer, QUERIES["dense_id_copies"]):
        run(spark, sf_dir, query)
    work = {n: QUERIES[n] for n in HEADLINES}
    work |= {f.__name__: f for f in (k_anonymize_lineitem, greedy_customer, greedy_lineitem_rows)}
    seconds = {name: run(spark, sf_dir, q) for name, q in work.items()}
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
