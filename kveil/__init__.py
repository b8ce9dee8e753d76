"""Table anonymization and utility evaluation on PySpark DataFrames."""

from kveil.operators.clean import drop_duplicates_report, drop_nulls_report, removal_shares
from kveil.operators.cluster import greedy_k_member
from kveil.operators.features import dense, encode, string_index
from kveil.operators.generalize import coverage, k_anonymize, verify_k
from kveil.operators.hierarchy import (
    Hierarchy,
    ancestor_at,
    dgh_closure,
    dgh_validate,
    lca_pairs,
    tree_height,
)
from kveil.operators.mining import accuracy, kmeans, naive_bayes, silhouette, split_at_random, split_by_key
from kveil.operators.neighbors import (
    assign_leftovers,
    best_cluster,
    best_record,
    category_distance,
    delta_info_loss,
    furthest,
    info_loss,
    record_distance,
    total_info_loss,
)
from kveil.operators.profile import distinct_profile, summary_long, token_counts
from kveil.operators.project import (
    cap,
    predictor_columns,
    select_roles,
    select_typed,
    suppress_identifiers,
    with_dense_id,
)
from kveil.plans import anonymize, examine, run_anonymize, run_examine, run_explore
from kveil.sources.config import Attribute, JobSpec, Roles, category, load_spec, numeric

__all__ = [
    "Attribute",
    "Hierarchy",
    "JobSpec",
    "Roles",
    "accuracy",
    "ancestor_at",
    "anonymize",
    "assign_leftovers",
    "best_cluster",
    "best_record",
    "cap",
    "category",
    "category_distance",
    "coverage",
    "delta_info_loss",
    "dense",
    "dgh_closure",
    "dgh_validate",
    "distinct_profile",
    "drop_duplicates_report",
    "drop_nulls_report",
    "encode",
    "examine",
    "furthest",
    "greedy_k_member",
    "info_loss",
    "k_anonymize",
    "kmeans",
    "lca_pairs",
    "load_spec",
    "naive_bayes",
    "numeric",
    "predictor_columns",
    "record_distance",
    "removal_shares",
    "run_anonymize",
    "run_examine",
    "run_explore",
    "select_roles",
    "select_typed",
    "silhouette",
    "split_at_random",
    "split_by_key",
    "string_index",
    "summary_long",
    "suppress_identifiers",
    "token_counts",
    "total_info_loss",
    "tree_height",
    "verify_k",
    "with_dense_id",
]
