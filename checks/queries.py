"""One query per operator, over whole tables. Keys match ``oracles.oracle_sql``."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import (
    LINE,
    ORDER,
    PERSON,
    chunk_label,
    geography,
    lines,
    order_hierarchy,
    person_hierarchy,
    persons,
    purchases,
    scratch,
    supplier_geography,
    table,
)
from kveil.operators import clean, cluster, features, generalize, mining, neighbors, profile, project
from kveil.operators.cluster import greedy_k_member
from kveil.operators.hierarchy import (
    Hierarchy,
    ancestor_at,
    dgh_closure,
    dgh_validate,
    lca_pairs,
    tree_height,
)
from kveil.plans import anonymize, examine, run_anonymize, run_examine, run_explore
from kveil.session import cut_lineage
from kveil.sources import (
    load_model,
    load_spec,
    preview,
    read_csv,
    read_text,
    save_model,
    write_csv,
    write_text,
)
from kveil.sources.config import JobSpec, Roles, category, numeric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 5


def query(fn: Query) -> Query:
    """Registers a query under its function's name, without the underscore that keeps it off an import."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# ---- sources and sinks -------------------------------------------------------------------------


@query
def csv_roundtrip(spark, d):
    source = table(spark, d, "customer")
    path = scratch(spark, "csv")
    write_csv(source, path, sep=";")
    return read_csv(spark, path, schema=source.schema, sep=";")


@query
def csv_untyped(spark, d):
    path = scratch(spark, "csv")
    write_csv(table(spark, d, "nation").join(table(spark, d, "customer"), F.expr("n_nationkey = c_nationkey")), path)
    return read_csv(spark, path).groupBy("n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_nationkey").alias("key_text")
    )


@query
def text_roundtrip(spark, d):
    path = scratch(spark, "text")
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    write_text(counts, path)
    return read_text(spark, path)


@query
def config_attrs_(spark, d):
    job = {
        "k": 5,
        "input_path": f"{d}/customer.parquet",
        "identifier": [{"attrName": "c_name", "dataType": "category"}],
        "quasi_identifier": [
            {"attrName": "c_acctbal", "dataType": "numeric"},
            {"attrName": "c_mktsegment", "dataType": "category"},
        ],
        "sensitive_identifier": [{"attrName": "c_nationkey", "dataType": "category"}],
    }
    path = scratch(spark, "job")
    spark.createDataFrame([(json.dumps(job, indent=1),)], "value string").write.text(path)
    spec = load_spec(spark, path)
    return project.select_roles(spark.read.parquet(spec.input_path), spec.roles, keep=["c_custkey"])


@query
def preview_(spark, d):
    return preview(table(spark, d, "customer"), ["c_custkey"], 20)


@query
def model_roundtrip(spark, d):
    vectors = embeddings(spark, d)
    model, before = mining.kmeans(vectors, 10, seed=1)
    path = scratch(spark, "model")
    save_model(model, path)
    after = load_model(KMeansModel, path).transform(vectors)
    pairs = before.select("vec_id", "prediction").join(
        after.select("vec_id", F.col("prediction").alias("again")), "vec_id"
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("again")).cast("long")).alias("same")
    )


# ---- projections and filters -------------------------------------------------------------------


@query
def typed_projection(spark, d):
    attrs = [numeric("c_acctbal"), category("c_nationkey"), category("c_mktsegment")]
    return project.select_typed(table(spark, d, "customer"), attrs, keep=["c_custkey"])


@query
def typed_text(spark, d):
    """Text that is no number becomes NULL, text with a fraction is cut."""
    source = table(spark, d, "events").select("event_id", F.col("value").cast("string").alias("amount"), "event_type")
    return project.select_typed(source, [numeric("amount"), numeric("event_type")], keep=["event_id"])


@query
def role_projection(spark, d):
    roles = Roles(
        quasi=(numeric("c_acctbal"), category("c_mktsegment")),
        sensitive=(category("c_mktsegment"), category("c_nationkey")),
        identifiers=(category("c_name"),),
    )
    return project.select_roles(table(spark, d, "customer"), roles, keep=["c_custkey"])


@query
def tag_rename_drop(spark, d):
    tagged = project.tag(table(spark, d, "supplier"), "Info", "Member")
    return project.rename(tagged, {"s_suppkey": "id"}).drop("s_acctbal")


@query
def dense_id(spark, d):
    return project.with_dense_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], unique=True)


@query
def dense_id_copies(spark, d):
    return project.with_dense_id(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query
def dense_id_input_order(spark, d):
    numbered = project.with_dense_id(table(spark, d, "orders").select("o_orderkey"), order="input")
    return numbered.agg(
        F.count_distinct("id").alias("ids"),
        F.min("id").alias("first"),
        F.max("id").alias("last"),
        F.count_distinct("o_orderkey").alias("orders"),
    )


@query
def row_cap(spark, d):
    numbered = project.with_dense_id(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], unique=True)
    return project.cap(numbered, 1000)


@query
def key_lookup(spark, d):
    return project.by_key(table(spark, d, "orders"), 77, "o_orderkey")


@query
def cluster_rows(spark, d):
    return project.cluster_rows(persons(spark, d), "Cluster 1").select("id", "nation", "Cluster")


@query
def ci_filter_topk(spark, d):
    kept = project.equals_ignoring_case(table(spark, d, "part"), "p_type", "Economy")
    return profile.top_groups(kept, "p_brand", "p_type", 10)


@query
def prefix_filter(spark, d):
    tokens = profile.tokens(table(spark, d, "documents"), "text", ",")
    return project.starts_with(tokens, "token", " the").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def predictor_columns(spark, d):
    encoded = features.encode(persons(spark, d).select("nation", "segment"))
    return encoded.withColumn("age", F.lit(1)).select(*project.predictor_columns(encoded.withColumn("age", F.lit(1))))


# ---- aggregates --------------------------------------------------------------------------------


@query
def row_count(spark, d):
    return profile.row_count(table(spark, d, "lineitem"))


@query
def token_count(spark, d):
    return profile.token_counts(table(spark, d, "documents"), "text", ",")


@query
def token_stats(spark, d):
    return profile.token_stats(profile.token_counts(table(spark, d, "documents"), "text", ","))


@query
def token_top3(spark, d):
    return profile.rarest_tokens(profile.token_counts(table(spark, d, "documents"), "text", ","), 3)


@query
def describe_long(spark, d):
    return profile.summary_long(table(spark, d, "customer")).select(
        "column", "count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max"
    )


@query
def median_approx(spark, d):
    return profile.median_approx(table(spark, d, "orders"), "o_totalprice", 1_000_000)


@query
def mode_value(spark, d):
    return profile.mode_value(table(spark, d, "orders"), "o_custkey")


@query
def distinct_profile(spark, d):
    return profile.distinct_profile(table(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_name"])


@query
def distinct_values(spark, d):
    return profile.distinct_values(table(spark, d, "part"), "p_name")


@query
def minmax_all(spark, d):
    return profile.min_max(table(spark, d, "lineitem"))


@query
def cluster_minmax(spark, d):
    return profile.min_max(persons(spark, d), ["balance"], by="Cluster")


@query
def cluster_sizes(spark, d):
    return profile.cluster_sizes(persons(spark, d))


@query
def cluster_ndv(spark, d):
    return profile.distinct_counts(persons(spark, d), ["balance", "nation", "segment"])


@query
def partition_census(spark, d):
    census = profile.partition_census(table(spark, d, "lineitem"))
    return census.agg(F.sum("number_of_records").alias("n"), (F.min("number_of_records") >= 0).alias("ok"))


@query
def union_rows(spark, d):
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    return project.union_rows(people, table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")))


def urgent_buyers(spark, d):
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(F.col("o_custkey").alias("c_custkey"))


@query
def except_rows(spark, d):
    return project.except_rows(table(spark, d, "customer").select("c_custkey"), urgent_buyers(spark, d))


@query
def except_by_key(spark, d):
    return project.except_rows(table(spark, d, "customer"), urgent_buyers(spark, d), "c_custkey")


@query
def distinct_rows(spark, d):
    return project.distinct_rows(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query
def sample_one(spark, d):
    """One row, of the table, and the same one however the table is partitioned."""
    people = table(spark, d, "customer")
    drawn = project.one_random_row(people, seed=7, key="c_custkey")
    again = project.one_random_row(people.repartition(7), seed=7, key="c_custkey")
    found = drawn.select("*", F.lit(1).alias("drawn")).join(people.withColumn("own", F.lit(1)), people.columns, "left")
    found = found.join(again.select("c_custkey", F.lit(1).alias("again")), "c_custkey", "left")
    return found.agg(
        F.count("drawn").alias("n"),
        F.min(F.col("own").isNotNull()).alias("in_table"),
        F.min(F.col("again").isNotNull()).alias("same_again"),
    )


@query
def sorted_first_row(spark, d):
    return project.first_rows(table(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 1)


# ---- cleaning ----------------------------------------------------------------------------------


def labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "quality", "toxic"
    )


@query
def dedup_rows(spark, d):
    clean_rows, _ = clean.drop_duplicates_report(table(spark, d, "documents"), ["text"], key="doc_id")
    return clean_rows.select("doc_id", "lang", "n_chars")


@query
def dedup_report(spark, d):
    return clean.drop_duplicates_report(table(spark, d, "documents"), ["text"], key="doc_id")[1]


@query
def null_rows(spark, d):
    return clean.drop_nulls_report(labelled(spark, d))[0]


@query
def null_report(spark, d):
    return clean.drop_nulls_report(labelled(spark, d))[1]


@query
def null_token_report(spark, d):
    return clean.drop_nulls_report(labelled(spark, d), ["lang"], null_tokens=["fr"])[1]


@query
def removal_share(spark, d):
    _, copies = clean.drop_duplicates_report(table(spark, d, "documents"), ["text"], key="doc_id")
    return clean.removal_shares(copies, clean.drop_nulls_report(labelled(spark, d))[1])


# ---- hierarchies -------------------------------------------------------------------------------


@query
def dgh_closure_(spark, d):
    return dgh_closure(supplier_geography(spark, d)).select(
        "value", "parent", "level", "depth", "height", "is_leaf", F.array_join("path", "/").alias("path")
    )


@query
def dgh_height_(spark, d):
    closure = dgh_closure(supplier_geography(spark, d))
    levels = tree_height(closure, "levels").withColumnRenamed("height", "levels")
    return tree_height(closure).join(levels, "attr")


@query
def dgh_orphans_(spark, d):
    """Documents hang on their label's node, which only labelled documents have."""
    label = table(spark, d, "labels").select(
        F.concat(F.lit("label "), F.col("doc_id")).alias("value"), F.lit("All").alias("parent"), F.lit(2).alias("level")
    )
    document = table(spark, d, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id")).alias("value"),
        F.concat(F.lit("label "), F.col("doc_id")).alias("parent"),
        F.lit(3).alias("level"),
    )
    top = label.select(F.lit("All").alias("value"), F.lit("All").alias("parent"), F.lit(1).alias("level")).distinct()
    rows = top.unionByName(label).unionByName(document)
    return dgh_validate(rows.select(F.lit("document").alias("attr"), "*")).select("value", "issue")


def nation_pairs(spark, d):
    """Nations of supplier and customer of every line, with the lines of each pair."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    keys = (
        line.join(supplier, F.expr("l_suppkey = s_suppkey"))
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(customer, F.expr("o_custkey = c_custkey"))
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nation = table(spark, d, "nation")
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer"))
    return keys.join(seller, "s_nationkey").join(buyer, "c_nationkey").select("seller", "buyer", "n")


@query
def lca_pairs_(spark, d):
    return lca_pairs(nation_pairs(spark, d), "seller", "buyer", Hierarchy.build(geography(spark, d)), "nation")


@query
def ancestor_at_level(spark, d):
    closure = dgh_closure(geography(spark, d))
    return ancestor_at(persons(spark, d).select("id", "nation"), "nation", 2, closure, "nation")


# ---- distances and information loss ------------------------------------------------------------


def first_person(people: DataFrame) -> DataFrame:
    return project.by_key(people, 1)


def rounded(df: DataFrame, col: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.round(col, 4).alias(col))


def number_only() -> Roles:
    return Roles(quasi=(numeric("balance"),))


def flat_hierarchy(spark, d) -> Hierarchy:
    return Hierarchy.build(geography(spark, d))


@query
def num_distance(spark, d):
    people, tree = persons(spark, d), flat_hierarchy(spark, d)
    return rounded(neighbors.record_distance(people, first_person(people), number_only(), tree), "distance", "id")


@query
def num_distance_ref(spark, d):
    people, tree = persons(spark, d), flat_hierarchy(spark, d)
    found = neighbors.record_distance(people, first_person(people), number_only(), tree, metric="reference")
    return found.select("id", "distance")


@query
def cat_distance(spark, d):
    return neighbors.category_distance(nation_pairs(spark, d), "seller", "buyer", flat_hierarchy(spark, d), "nation")


@query
def cat_distance_ref(spark, d):
    return neighbors.category_distance(
        nation_pairs(spark, d), "seller", "buyer", flat_hierarchy(spark, d), "nation", metric="reference"
    )


@query
def record_distance(spark, d):
    people = persons(spark, d)
    found = neighbors.record_distance(people, first_person(people), PERSON, person_hierarchy(spark, d))
    return rounded(found, "distance", "id")


@query
def record_distance_ref(spark, d):
    people = persons(spark, d)
    found = neighbors.record_distance(
        people, first_person(people), PERSON, person_hierarchy(spark, d), metric="reference"
    )
    return rounded(found, "distance", "id")


@query
def furthest_record(spark, d):
    people = persons(spark, d)
    found = neighbors.furthest(people, first_person(people), PERSON, person_hierarchy(spark, d))
    return rounded(found, "distance", "id")


@query
def cluster_info_loss(spark, d):
    found = neighbors.info_loss(persons(spark, d), PERSON, person_hierarchy(spark, d))
    return rounded(found, "info_loss", "Cluster", "n")


@query
def cluster_info_loss_ref(spark, d):
    found = neighbors.info_loss(persons(spark, d), PERSON, person_hierarchy(spark, d), metric="reference")
    return rounded(found, "info_loss", "Cluster", "n")


@query
def total_info_loss(spark, d):
    found = neighbors.total_info_loss(persons(spark, d), PERSON, person_hierarchy(spark, d))
    return rounded(found, "info_loss", "clusters", "rows")


def open_cluster(spark, d):
    people = persons(spark, d)
    first = F.col("Cluster") == "Cluster 1"
    return people, people.where(first), people.where(~first)


@query
def delta_info_loss(spark, d):
    people, members, free = open_cluster(spark, d)
    tree = person_hierarchy(spark, d)
    found = neighbors.delta_info_loss(free, members, PERSON, tree, neighbors.loss_model(people, PERSON, tree).domain)
    return rounded(found, "delta", "id")


@query
def best_record(spark, d):
    people, members, free = open_cluster(spark, d)
    tree = person_hierarchy(spark, d)
    found = neighbors.best_record(free, members, PERSON, tree, neighbors.loss_model(people, PERSON, tree).domain)
    return rounded(found, "delta", "id")


@query
def best_cluster(spark, d):
    people, _, others = open_cluster(spark, d)
    tree = person_hierarchy(spark, d)
    found = neighbors.best_cluster(
        others, first_person(people), PERSON, tree, neighbors.loss_model(people, PERSON, tree).domain
    )
    return rounded(found, "delta", "Cluster")


@query
def leftover_assign(spark, d):
    """Clusters of seven in id order; the remainder joins the best of them."""
    people = persons(spark, d).drop("Cluster")
    full = people.count() // 7 * 7
    clustered = people.where(F.col("id") <= full).withColumn("Cluster", chunk_label(F.col("id"), 7))
    left = people.where(F.col("id") > full)
    tree = person_hierarchy(spark, d)
    domain = neighbors.loss_model(people, PERSON, tree).domain
    return neighbors.assign_leftovers(left, clustered, PERSON, tree, domain).select("id", "Cluster")


@query
def leftover_assign_many(spark, d):
    """Every supplier as a leftover against the customers' clusters of five."""
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    left = suppliers.select(
        (F.col("s_suppkey") + 1).cast("long").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").cast("int").alias("balance"),
        F.col("n_name").alias("nation"),
        F.lit("BUILDING").alias("segment"),
    )
    people, tree = persons(spark, d), person_hierarchy(spark, d)
    return neighbors.assign_leftovers(left, people, PERSON, tree).select("id", "Cluster")


# ---- generalization ----------------------------------------------------------------------------


@query
def generalize_numeric(spark, d):
    out = generalize.k_anonymize(persons(spark, d), number_only(), flat_hierarchy(spark, d))
    return out.select("id", "balance")


@query
def generalize_root(spark, d):
    out = generalize.k_anonymize(persons(spark, d), PERSON, person_hierarchy(spark, d), level="root")
    return out.select("id", "nation", "segment")


@query
def generalize_lca(spark, d):
    out = generalize.k_anonymize(persons(spark, d), PERSON, person_hierarchy(spark, d))
    return out.select("id", "nation", "segment")


@query
def generalize_level(spark, d):
    out = generalize.k_anonymize(persons(spark, d), PERSON, person_hierarchy(spark, d), level=1)
    return out.select("id", "nation", "segment")


@query
def k_anonymize_(spark, d):
    """Segments have no hierarchy here, so mixed ones are suppressed."""
    return generalize.k_anonymize(persons(spark, d), PERSON, flat_hierarchy(spark, d))


@query
def k_anonymize_bounded(spark, d):
    return generalize.k_anonymize(persons(spark, d), PERSON, person_hierarchy(spark, d), bounded=True)


@query
def k_anonymize_hot(spark, d):
    """Six clusters hold all lines; hot clusters meet their profile by broadcast."""
    rows = lines(spark, d).withColumn("Cluster", F.concat("flag", "status"))
    found = generalize.k_anonymize(rows, LINE, flat_hierarchy(spark, d), hot_rows=1000)
    return found.groupBy("flag", "status", "quantity", "nation", "shipped").agg(F.count(F.lit(1)).alias("n"))


@query
def verify_k(spark, d):
    out = generalize.k_anonymize(persons(spark, d), PERSON, person_hierarchy(spark, d))
    return generalize.verify_k(out, ["balance", "nation", "segment"])


@query
def coverage(spark, d):
    people = persons(spark, d)
    out = generalize.k_anonymize(people, PERSON, person_hierarchy(spark, d))
    return generalize.coverage(people, out, ["balance", "nation", "segment"])


@query
def coverage_removed(spark, d):
    """Rows that an anonymized table lacks, here one whole segment, count as removed."""
    people = persons(spark, d)
    out = generalize.k_anonymize(people, PERSON, person_hierarchy(spark, d))
    out = out.join(people.where("segment = 'BUILDING'").select("id"), "id", "left_anti")
    return generalize.coverage(people, out, ["balance", "nation", "segment"])


# ---- clustering and the job --------------------------------------------------------------------


def invariants(clustered: DataFrame, k: int) -> DataFrame:
    sizes = clustered.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("Info") == "Centroid").cast("long")).alias("centroids"),
        F.sum((F.col("Info") == "Remainder").cast("long")).alias("rest"),
    )
    return sizes.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("clusters"),
        (F.min("n") >= k).alias("min_ok"),
        (F.max("n") <= 2 * k - 1).alias("max_ok"),
        F.bool_and(F.col("centroids") == 1).alias("centroids_ok"),
        F.bool_and(F.col("n") - F.col("rest") == k).alias("members_ok"),
    )


@query
def greedy_sizes(spark, d):
    clustered = greedy_k_member(
        persons(spark, d).drop("Cluster"), PERSON, person_hierarchy(spark, d), K, check_keys=True
    )
    return invariants(clustered, K)


def in_chunks(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Rows in clusters of neighbours along an order."""
    numbered = project.with_dense_id(df, order, id_col="__pos", unique=True)
    return numbered.withColumn("Cluster", chunk_label(F.col("__pos"), rows)).drop("__pos", *order[:-1])


@query
def greedy_loss(spark, d):
    """Blocked clustering of customers loses less than neighbours in hash order and in Z-order do."""
    people, tree = persons(spark, d).drop("Cluster"), person_hierarchy(spark, d)
    valued = cluster.rank_values(people, PERSON, tree)
    curves = cluster.rank_curves(valued, people.count(), len(PERSON.quasi), "id")
    z = valued.withColumn("z", cluster.z_order(curves)).select("z", *people.columns)
    made = {
        "greedy": greedy_k_member(people, PERSON, tree, 5).drop("Info"),
        "hashed": in_chunks(people.withColumn("h", F.xxhash64("id")), ["h", "id"], 5),
        "along_z": in_chunks(z, ["z", "id"], 5),
    }
    totals = None
    for name, rows in made.items():
        one = neighbors.total_info_loss(rows, PERSON, tree).select(F.lit(name).alias("how"), "rows", "info_loss")
        totals = one if totals is None else totals.unionByName(one)
    loss = {name: F.max(F.when(F.col("how") == name, F.col("info_loss"))) for name in made}
    return totals.agg(
        F.max("rows").alias("n"),
        (loss["greedy"] < loss["hashed"]).alias("below_hashed"),
        (loss["greedy"] < loss["along_z"]).alias("below_z_order"),
    )


@query
def greedy_lineitem(spark, d):
    rows = project.with_dense_id(lines(spark, d), ["order_key", "line", "part"])
    return invariants(greedy_k_member(rows, LINE, flat_hierarchy(spark, d), K), K)


@query
def greedy_keeps_rows(spark, d):
    """Every row comes back once and as it was."""
    clustered = greedy_k_member(persons(spark, d).drop("Cluster"), PERSON, person_hierarchy(spark, d), K)
    return clustered.drop("Cluster", "Info")


@query
def anonymize_job(spark, d):
    orders = purchases(spark, d)
    _, out = anonymize(orders, ORDER, order_hierarchy(spark, d), K)
    out = cut_lineage(out)
    checked = generalize.verify_k(out, ["price", "nation", "priority"])
    kept = out.join(orders.select("id", F.col("status").alias("was")), "id").agg(
        F.sum((F.col("status") == F.col("was")).cast("long")).alias("sensitive_kept")
    )
    return checked.select("rows", (F.col("min_class_size") >= K).alias("k_ok"), kept.scalar().alias("sensitive_kept"))


# ---- mining ------------------------------------------------------------------------------------


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


def as_text(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("int").cast("string")), ",").alias(name)


@query
def string_index(spark, d):
    people = persons(spark, d).select("id", "nation", "segment")
    return features.string_index(people, ["nation", "segment"])


@query
def string_index_wide(spark, d):
    """The joined form that columns with very many labels take."""
    return features.string_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], max_labels=10)


@query
def one_hot(spark, d):
    encoded = features.encode(persons(spark, d).select("id", "segment"), ["segment"], "onehot")
    return features.dense(encoded, "segment_vec", "hot").select("id", as_text("hot"))


@query
def feature_index(spark, d):
    encoded = features.encode(persons(spark, d).select("id", "nation", "segment"), ["nation", "segment"])
    return features.dense(encoded, "features", "f").select("id", as_text("f"))


@query
def feature_onehot(spark, d):
    encoded = features.encode(persons(spark, d).select("id", "nation", "segment"), ["nation", "segment"], "onehot")
    return features.dense(encoded, "features", "f").select("id", as_text("f"))


@query
def kmeans_invariants(spark, d):
    _, found = mining.kmeans(embeddings(spark, d), 10, seed=1)
    score = mining.silhouette(found)
    return found.agg(
        F.count("prediction").alias("n"),
        (F.min("prediction") >= 0).alias("low_ok"),
        (F.max("prediction") < 10).alias("high_ok"),
        F.lit(-1.0 <= score <= 1.0).alias("score_ok"),
    )


@query
def silhouette_fixed(spark, d):
    score = mining.silhouette(embeddings(spark, d), prediction="label")
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.lit(round(score, 4)))


@query
def hash_split(spark, d):
    """Every order's part under several weights."""
    orders, out = table(spark, d, "orders").select("o_orderkey"), None
    for weights in ((0.7, 0.3), (0.6, 0.2), (0.75, 0.25), (7.0, 1.0)):
        training, test = mining.split_by_key(orders, "o_orderkey", *weights)
        both = project.tag(training, "part", "training").unionByName(project.tag(test, "part", "test"))
        both = project.tag(both, "weights", f"{weights[0]}:{weights[1]}")
        out = both if out is None else out.unionByName(both)
    return out


def nb_table(spark, d):
    orders = purchases(spark, d).select("id", "nation", "priority", "status")
    encoded = features.encode(orders, ["nation", "priority"], label="status")
    training, test = mining.split_by_key(encoded, "id")
    return mining.naive_bayes(training, test, "status")[1]


@query
def nb_predict(spark, d):
    return nb_table(spark, d).select("id", "prediction")


@query
def nb_accuracy(spark, d):
    return mining.accuracy_table(nb_table(spark, d), "status").select("n", F.round("accuracy", 4).alias("accuracy"))


PERSON_JOB = JobSpec(
    model_name="naive_bayes",
    label="segment",
    training_set=0.7,
    selected=(numeric("balance"), category("nation"), category("segment")),
)


@query
def utility_compare_(spark, d):
    """Naive Bayes on the normal and on the anonymized table."""
    people = persons(spark, d)
    roles = Roles(quasi=PERSON.quasi[:2], sensitive=PERSON.quasi[2:])
    out = generalize.k_anonymize(people, roles, flat_hierarchy(spark, d))
    made = examine(people, out, PERSON_JOB, key="id")
    return made.comparison.select("Info", "metric", F.round("score", 4).alias("score"))


@query
def examine_job_(spark, d):
    people = persons(spark, d)
    out = generalize.k_anonymize(people, PERSON, flat_hierarchy(spark, d))
    made = examine(people, out, replace(PERSON_JOB, model_name="k_means", kmeans_k=2), key="id", seed=1)
    sizes = made.anonymized.agg(F.count("prediction").alias("n"))
    ok = made.comparison.select("Info", "metric", F.col("score").between(-1, 2).alias("ok"))
    return ok.select("*", sizes.scalar().alias("n"))


@query
def examine_single(spark, d):
    """One table alone."""
    made = examine(persons(spark, d), None, PERSON_JOB, key="id")
    return made.comparison.select("Info", "metric", F.round("score", 4).alias("score"))


@query
def examine_predictions(spark, d):
    made = examine(persons(spark, d), None, PERSON_JOB, key="id")
    return made.normal.select("id", "balance", "nation", "segment")


# ---- job files ---------------------------------------------------------------------------------


def job_file(spark, body: dict) -> str:
    path = scratch(spark, "job")
    spark.createDataFrame([(json.dumps(body, indent=1),)], "value string").write.text(path)
    return path


def tree_of(dgh: DataFrame, layout: str) -> dict:
    """A small hierarchy in either layout of a job file: rows of an attribute, or rows beside a tree's name."""
    found = {}
    for r in dgh.collect():
        node = {"value": r.value, "parent": r.parent, "level": str(r.level), "position": "null"}
        found.setdefault(r.attr, []).append(node)
    return found if layout == "flat" else {a: {"tree": "tree", "generalization": rows} for a, rows in found.items()}


def attributes(*pairs: tuple[str, str]) -> list[dict]:
    return [{"attrName": name, "dataType": kind} for name, kind in pairs]


@query
def dgh_layouts(spark, d):
    """Hierarchy rows of a job file, in both layouts."""
    out = None
    for layout in ("flat", "nested"):
        spec = load_spec(spark, job_file(spark, {"domain_generalization_hierarchy": tree_of(geography(spark, d), layout)}))
        rows = project.tag(spec.dgh.select("attr", "value", "parent", "level"), "layout", layout)
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def sorted_by_key(spark, d):
    """All rows in the order of their key, with their places."""
    mixed = persons(spark, d).select("id", "name").repartition(7, "name")
    return project.with_dense_id(project.sort_by_key(mixed), id_col="place", order="input")


@query
def column_names(spark, d):
    """Every column of a table in order, and its values that are not null."""
    people = table(spark, d, "customer")
    names = project.all_columns(people)
    counts = people.agg(*[F.count(n).alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("filled")) for n in names])
    return counts.select(F.posexplode(each).alias("place", "c")).select("place", "c.name", "c.filled")


@query
def explore_job_file(spark, d):
    """Distinct values of the chosen columns, from the files that the job writes."""
    body = {
        "input_path": f"{d}/customer.parquet",
        "output_path": scratch(spark, "explored"),
        "selected_column": attributes(("c_mktsegment", "category"), ("c_nationkey", "numeric")),
    }
    out = None
    for name, path in run_explore(spark, job_file(spark, body)).items():
        values = project.tag(read_csv(spark, path).select(F.col(name).alias("value")), "column", name)
        out = values if out is None else out.unionByName(values)
    return out


def relabelled(spark, d, clusters: DataFrame) -> DataFrame:
    """id, balance and nation as a cluster file's rows alone say they should be labelled."""
    world = geography(spark, d).where("level = 3").select(F.col("value").alias("nation"), F.col("parent").alias("region"))
    bounds = clusters.join(world, "nation").groupBy("Cluster").agg(
        *[F.min(F.col("balance").cast("int")).alias("lo"), F.max(F.col("balance").cast("int")).alias("hi")],
        *[F.min("nation").alias("n1"), F.max("nation").alias("n2")],
        *[F.min("region").alias("r1"), F.max("region").alias("r2")],
    )
    span = F.when(F.expr("lo = hi"), F.expr("CAST(lo AS string)")).otherwise(F.expr("concat('[', lo, '-', hi, ']')"))
    place = F.when(F.expr("n1 = n2"), F.col("n1")).when(F.expr("r1 = r2"), F.col("r1")).otherwise("World")
    return clusters.select("id", "Cluster").join(bounds, "Cluster").select(
        "id", span.alias("want_balance"), place.alias("want_nation")
    )


@query
def anonymize_job_file(spark, d):
    """The anonymize job from its file, checked by the tables that it writes; with a row cap in one layout."""
    people = persons(spark, d).select("name", "balance", "nation", "segment")
    source = f"{scratch(spark, 'people')}.csv"
    write_csv(people, source)
    out = None
    for layout, most in (("nested", None), ("flat", 500)):
        body = {
            "k": K,
            "input_path": source,
            "output_path": scratch(spark, "anonymized"),
            "identifier": attributes(("name", "category")),
            "quasi_identifier": attributes(("balance", "numeric"), ("nation", "category")),
            "sensitive_identifier": attributes(("segment", "category")),
            "domain_generalization_hierarchy": tree_of(geography(spark, d), layout),
        }
        if most is not None:
            body["num_sample_datas"] = most
        made = {name: read_csv(spark, path) for name, path in run_anonymize(spark, job_file(spark, body)).items()}
        anonymous = made["k-anonymity"]
        fine = anonymous.join(relabelled(spark, d, made["greedy-k-member-clustering"]), "id")
        fine = fine.join(made["normal-table"].select("id", F.col("segment").alias("was")), "id")
        flags = fine.agg(
            F.sum(F.expr("balance = want_balance AND nation = want_nation").cast("long")).alias("labels_right"),
            F.sum(F.expr("segment = was").cast("long")).alias("sensitive_kept"),
        )
        rows = generalize.verify_k(anonymous, ["balance", "nation"])
        rows = rows.select(F.lit(layout).alias("layout"), "rows", (F.col("min_class_size") >= K).alias("k_ok"))
        rows = rows.select("*", *[flags.select(c).scalar().alias(c) for c in ("labels_right", "sensitive_kept")])
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def examine_job_file(spark, d):
    """Naive Bayes on a normal and an anonymized file, scores read from the file that the job writes."""
    people = persons(spark, d)
    roles = Roles(quasi=PERSON.quasi[:2], sensitive=PERSON.quasi[2:])
    paths = [f"{scratch(spark, name)}.csv" for name in ("before", "after")]
    write_csv(people.drop("Cluster", "name"), paths[0])
    write_csv(generalize.k_anonymize(people, roles, flat_hierarchy(spark, d)).drop("name"), paths[1])
    body = {
        "input_path": paths[0],
        "input_path2": paths[1],
        "output_path": scratch(spark, "examined"),
        "model_name": "naive_bayes",
        "selected_column": attributes(("balance", "numeric"), ("nation", "category"), ("segment", "category")),
        "naive_bayes": {"label": "segment", "training_set": 0.7, "test_set": 0.3},
    }
    scores = read_csv(spark, run_examine(spark, job_file(spark, body), key="id")["accuracy-score"])
    return scores.select("Info", "metric", F.round(F.col("score").cast("double"), 4).alias("score"))
