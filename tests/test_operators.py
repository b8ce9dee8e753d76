import pytest
from conftest import tuples
from pyspark.sql import functions as F

from kveil.operators import clean, features, mining, profile, project
from kveil.sources.config import Roles, category, numeric


@pytest.mark.parametrize(
    "text, answer",
    [("39", 39), (" 39 ", 39), ("39.5", 39), ("-39.5", -39), ("?", None), ("", None), ("3e9", None), (None, None)],
)
def test_text_to_number(spark, text, answer):
    df = spark.createDataFrame([(text,)], "a string")
    assert project.select_typed(df, [numeric("a")]).first().a == answer


@pytest.mark.parametrize("number, answer", [(39.9, 39), (-39.9, -39), (1e12, None), (float("nan"), None)])
def test_double_to_number(spark, number, answer):
    df = spark.createDataFrame([(number,)], "a double")
    assert project.select_typed(df, [numeric("a")]).first().a == answer


def test_typed_columns_keep_order_and_odd_names(spark):
    df = spark.createDataFrame([("1", "2", "x")], ["hours-per-week", "a.b", "c"])
    out = project.select_typed(df, [numeric("a.b"), category("c"), numeric("hours-per-week")])
    assert out.dtypes == [("a.b", "int"), ("c", "string"), ("hours-per-week", "int")]
    assert tuple(out.first()) == (2, "x", 1)


def test_roles_keep_name_and_type_together(spark):
    roles = Roles(
        quasi=(category("a"), numeric("b")), sensitive=(numeric("a"), category("c")), identifiers=(category("d"),)
    )
    df = spark.createDataFrame([("1", "2", "3", "4")], ["a", "b", "c", "d"])
    assert project.select_roles(df, roles).dtypes == [("a", "string"), ("b", "int"), ("c", "string")]
    assert project.suppress_identifiers(df, roles).columns == ["a", "b", "c"]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_dense_ids_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("v")).repartition(parts)
    got = project.with_dense_id(df, ["k"], unique=True)
    assert tuples(got.select("id", "k"), "id") == [(i + 1, i) for i in range(1000)]


def test_dense_ids_of_copies_spread_over_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("k"))
    got = project.with_dense_id(df.repartition(8))
    assert got.agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (20_000, 1, 20_000)
    ks = [r.k for r in got.orderBy("id").collect()]
    assert ks == sorted(ks)


def test_copies_are_numbered_by_content_alone(spark, monkeypatch):
    """Runs of copies longer than one array, and numbers that no order of the input can change."""
    monkeypatch.setattr(project, "COPY_RUN", 4)
    rows = [(3, "b")] * 23 + [(1, None), (1, None), (2, "x"), (None, "x")] + [(3, "a")] * 8
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for parts in (1, 5):
        got = project.with_dense_id(spark.createDataFrame(rows[::-1] if parts > 1 else rows, "k int, v string").repartition(parts), ["k"])
        assert tuples(got, "id") == [(i + 1, *r) for i, r in enumerate(want)]
    plan = project.copies_apart(spark.createDataFrame(rows, "k int, v string"))._jdf.queryExecution().toString()
    assert "monotonically" not in plan


def test_dense_ids_in_input_order(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "v int").coalesce(1)
    assert tuples(project.with_dense_id(df, order="input"), "id") == [(1, 5), (2, 3), (3, 9), (4, 1), (5, 7)]


def test_dense_ids_of_an_empty_table(spark):
    assert project.with_dense_id(spark.range(0).toDF("v"), ["v"]).count() == 0


def test_filters_and_sets(spark, people):
    assert project.cap(people, 4).count() == 4 and project.cap(people, None).count() == 9
    assert project.by_key(people, 3).first().age == 38
    assert project.cluster_rows(people.replace("Cluster 2", "Cluster 10"), "Cluster 1").count() == 3
    assert project.equals_ignoring_case(people, "race", "WHITE").count() == 6
    assert project.starts_with(people, "workclass", "Self").count() == 2
    a, b = people.limit(0).unionByName(people), people.where("id > 5")
    assert project.except_rows(a, b, "id").count() == 5 and project.except_rows(a, b).count() == 5
    assert project.distinct_rows(people.select("sex")).count() == 2
    assert project.union_rows(a, b).count() == 13
    drawn = {project.one_random_row(people.repartition(p), 3).first().id for p in (1, 5)}
    assert len(drawn) == 1
    assert [r.id for r in project.sort_by_key(people).take(2)] == [1, 2]


def test_predictor_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3.0, 4)], "s string, i int, d double, x_Index double, l long")
    assert project.predictor_columns(df) == ["s", "i", "d"]


def test_tokens_drop_empty_ends_only(spark):
    df = spark.createDataFrame([("a,b,,",), (",a",), ("",), (",,",), ("a",), (None,)], "t string")
    assert dict(tuples(profile.token_counts(df, "t"), "token")) == {"": 2, "a": 3, "b": 1}


def test_token_separator_is_literal(spark):
    df = spark.createDataFrame([("a|b|",)], "t string")
    assert dict(tuples(profile.token_counts(df, "t", "|"), "token")) == {"a": 1, "b": 1}


def test_profiles(spark, people):
    rows = {(r.column, r.value): r.n for r in profile.distinct_profile(people, ["sex", "age"]).collect()}
    assert rows["sex", "Male"] == 5 and rows["age", "53"] == 1 and len(rows) == 11
    assert profile.mode_value(people, "race").first()[:] == ("White", 6)
    assert profile.median_approx(people, "age").first().median == 39
    census = profile.partition_census(spark.range(10).repartition(3).where("id < 0"))
    assert tuples(census, "partition_number") == [(0, 0), (1, 0), (2, 0)]
    long = {r.column: r for r in profile.summary_long(people).collect()}
    assert long["age"].min == "28" and long["race"].mean is None and long["race"]["count"] == 9
    assert profile.describe(people, ["age"]).count() == 5
    assert profile.top_groups(people, "race", "id", 1).first()[:] == ("White", 6)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "?", "x"), (4, "b", "y")], "id int, v string, w string")
    kept, report = clean.drop_duplicates_report(df, ["v", "w"], key="id")
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 3, 4]
    assert report.first()[:] == (4, 3, 1, 0.25)
    assert clean.drop_duplicates_report(df, ["v"])[0].count() == 3
    kept, report = clean.drop_nulls_report(df, null_tokens=["?"])
    assert [r.id for r in kept.collect()] == [4] and report.first()[:] == (4, 1, 3, 0.75)
    empty = clean.drop_nulls_report(df.limit(0))[1]
    assert empty.first()[:] == (0, 0, 0, 0.0)


def test_label_is_no_feature_unless_asked(spark, people):
    cols = ["race", "sex", "income"]
    assert features.encode(people, cols, label="income").first().features.size == 2
    assert features.encode(people, cols, label="income", include_label=True).first().features.size == 3
    hot = features.encode(people, cols, "onehot", label="income").first()
    assert hot.features.size == 6 and hot.income_vec.size == 3


def test_wide_columns_get_the_same_indices(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", None, "c", "b", "d"]], "v string")
    few, wide = features.string_index(df, ["v"]), features.string_index(df, ["v"], max_labels=1)
    assert set(few.select("v", "v_Index").collect()) == set(wide.select("v", "v_Index").collect())
    encoded = features.encode(df, ["v"], "onehot", max_labels=1)
    assert encoded.first().features.size == 5


def test_columns_named_like_an_index_stay_out(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d")], "IndexCode string, other string")
    assert features.encode(df, ["other"]).first().features.size == 1


def test_mining(spark, people, tmp_path):
    encoded = features.encode(people, ["age", "race", "sex", "workclass"])
    model, found = mining.kmeans(encoded, 2, seed=1)
    assert found.count() == 9 and -1 <= mining.silhouette(found) <= 1
    one = found.withColumn("prediction", F.lit(0))
    assert mining.silhouette(one) == 0.0
    a, b = mining.split_at_random(people, 0.7, seed=3)
    assert a.count() + b.count() == 9
    table = features.encode(people, ["race", "sex"], label="income")
    _, predictions = mining.naive_bayes(table, table, "income")
    assert mining.accuracy(predictions, "income") == pytest.approx(mining.accuracy_table(predictions, "income").first().accuracy)


@pytest.mark.parametrize("weights, share", [((0.7, 0.3), 0.7), ((0.6, 0.2), 0.75), ((3, 1), 0.75), ((0.04,), 0.04)])
def test_split_follows_both_weights_whatever_the_keys(spark, weights, share):
    for step in (1, 10):
        rows = spark.range(0, 4000 * step, step).select(F.col("id").alias("k"))
        training, test = mining.split_by_key(rows, "k", *weights)
        n = training.count()
        assert n + test.count() == 4000 and abs(n / 4000 - share) < 0.03
        assert training.join(test, "k").count() == 0
    with pytest.raises(ValueError, match="positive"):
        mining.split_by_key(rows, "k", 1.0)


def test_keyed_duplicates_with_null_keys(spark):
    rows = [(None, "a"), (2, "a"), (1, "a"), (None, "b"), (None, "b"), (5, None), (4, None)]
    df = spark.createDataFrame(rows, "id int, v string")
    kept, report = clean.drop_duplicates_report(df, ["v"], key="id")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a"), (None, "b"), (4, None)], key=str)
    assert report.first().removed == 4
