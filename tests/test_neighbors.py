import pytest
from conftest import tuples
from pyspark.sql import functions as F

from kveil.functions.metrics import category_distance_reference, numeric_distance, numeric_loss_reference
from kveil.operators import boxes
from kveil.operators import neighbors as N
from kveil.operators.cohorts import domain_of


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*xs):
    return [F.lit(x).cast("int") for x in xs]


@pytest.mark.parametrize(
    "a, b, lo, hi, metric, answer",
    [
        (28, 53, 28, 53, "reference", 1.0),
        (28, 52, 28, 53, "reference", 0.0),
        (28, 28, 28, 28, "reference", 0.0),
        (None, 28, 28, 53, "reference", 0.0),
        (28, 53, 28, 53, "paper", 1.0),
        (28, 38, 28, 53, "paper", 0.4),
        (5, 5, 5, 5, "paper", 0.0),
        (None, 28, 28, 53, "paper", 1.0),
        (None, None, 28, 53, "paper", 0.0),
        (-2147483648, 2147483647, -2147483648, 2147483647, "reference", 1.0),
    ],
)
def test_numeric_distance(spark, a, b, lo, hi, metric, answer):
    assert value(spark, numeric_distance(*lits(a, b, lo, hi), metric)) == answer


def test_literal_losses(spark):
    assert value(spark, numeric_loss_reference(*lits(28, 53, 3))) == 8.0
    assert value(spark, numeric_loss_reference(*lits(None, None, 3))) == 0.0
    assert value(spark, category_distance_reference(F.lit(2), F.lit(3))) == 0.67


@pytest.mark.parametrize(
    "a, b, reference, paper",
    [
        ("White", "Black", 0.67, 0.5),
        ("White", "White", 1.0, 0.0),
        ("White", "Asian", 0.33, 1.0),
        ("White", "Other", 0.0, 1.0),
        ("Other", "Other", 0.0, 0.0),
        (None, None, 0.0, 0.0),
        ("General", "General", 0.67, 0.0),
    ],
)
def test_category_distance(spark, hierarchy, a, b, reference, paper):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert N.category_distance(df, "a", "b", hierarchy, "race", "reference").first().distance == reference
    assert N.category_distance(df, "a", "b", hierarchy, "race").first().distance == paper


def test_information_loss_of_the_person_table(people, roles, hierarchy):
    loss = {r.Cluster: (r.n, round(r.info_loss, 6)) for r in N.info_loss(people, roles, hierarchy).collect()}
    assert loss == {"Cluster 1": (3, 4.02), "Cluster 2": (3, 6.8), "Cluster 3": (3, 6.18)}
    total = N.total_info_loss(people, roles, hierarchy).first()
    assert (total.clusters, total.rows, round(total.info_loss, 6)) == (3, 9, 17.0)


def test_literal_information_loss(people, roles, hierarchy):
    loss = {r.Cluster: r.info_loss for r in N.info_loss(people, roles, hierarchy, metric="reference").collect()}
    # size times (range div size, plus one over the levels of each tree: 0.33, 0.5, 0.25)
    assert loss["Cluster 1"] == pytest.approx(3 * (7 + 0.33 + 0.5 + 0.25))


def python_loss(rows, hierarchy, domain):
    """Loss per row of a list of person rows, straight from the definition."""
    ages = [r.age for r in rows]
    total = (max(ages) - min(ages)) / (domain["age"][1] - domain["age"][0])
    for attr in ("race", "sex", "workclass"):
        values = {r[attr] for r in rows}
        if len(values) > 1:
            nodes = {r.value: r for r in hierarchy.nodes(attr).collect()}
            paths = [nodes[v].path for v in values]
            shared = [p for p in zip(*paths) if len(set(p)) == 1]
            total += nodes[shared[-1][0]].height / hierarchy.height[attr]
    return total


def test_searches_agree_with_brute_force(people, roles, hierarchy):
    domain = domain_of(people, roles)
    rows = people.orderBy("id").collect()
    loss = lambda group: len(group) * python_loss(group, hierarchy, domain)
    for r in rows[:3]:
        record = people.where(F.col("id") == r.id)
        dist = {x.id: python_loss([r, x], hierarchy, domain) for x in rows}
        got = {x.id: x.distance for x in N.record_distance(people, record, roles, hierarchy, domain).collect()}
        assert got == pytest.approx(dist)
        best = N.furthest(people, record, roles, hierarchy, domain).first()
        assert best.id == min(dist, key=lambda i: (-round(dist[i], 9), i))
    for name in ("Cluster 1", "Cluster 2", "Cluster 3"):
        inside = [x for x in rows if x.Cluster == name]
        free = [x for x in rows if x.Cluster != name]
        delta = {x.id: loss(inside + [x]) - loss(inside) for x in free}
        args = (people.where(F.col("Cluster") != name), people.where(F.col("Cluster") == name), roles, hierarchy)
        got = {x.id: x.delta for x in N.delta_info_loss(*args, domain).collect()}
        assert got == pytest.approx(delta)
        assert N.best_record(*args, domain).first().id == min(delta, key=lambda i: (round(delta[i], 9), i))


@pytest.mark.parametrize("slice_rows", [2, 32])
def test_leftovers_join_their_best_cluster(spark, people, roles, hierarchy, monkeypatch, slice_rows):
    monkeypatch.setattr(boxes, "SLICE", slice_rows)
    domain = domain_of(people, roles)
    rows = people.collect()
    loss = lambda group: len(group) * python_loss(group, hierarchy, domain)
    left = [
        (101, 30, "White", "Female", "Private", ">50K"),
        (102, 51, "White", "Male", "Self-emp-inc", ">50K"),
        (103, 45, "Black", "Male", "Gov", "<=50K"),
        (104, 28, "Asian", "Male", "Never-worked", "<=50K"),
        (105, 53, "Black", "Female", "State-gov", "<=50K"),
    ]
    leftovers = spark.createDataFrame(left, people.drop("Cluster").schema)
    got = dict(tuples(N.assign_leftovers(leftovers, people, roles, hierarchy, domain).select("id", "Cluster"), "id"))
    for r in leftovers.collect():
        gain = {}
        for name in ("Cluster 1", "Cluster 2", "Cluster 3"):
            inside = [x for x in rows if x.Cluster == name]
            gain[name] = round(loss(inside + [r]) - loss(inside), 9)
        assert got[r.id] == min(gain, key=lambda n: (gain[n], n)), r
        record = leftovers.where(F.col("id") == r.id)
        assert N.best_cluster(people, record, roles, hierarchy, domain).first().Cluster == got[r.id]


def test_no_leftovers(people, roles, hierarchy):
    none = N.assign_leftovers(people.drop("Cluster").limit(0), people, roles, hierarchy)
    assert none.count() == 0 and "Cluster" in none.columns


def test_cluster_numbers_break_ties(spark, roles, hierarchy, people):
    first = people.where("id = 1").drop("Cluster")
    twin = first.withColumn("Cluster", F.lit("Cluster 10")).unionByName(first.withColumn("Cluster", F.lit("Cluster 2")))
    assert N.best_cluster(twin, first, roles, hierarchy).first().Cluster == "Cluster 2"


def test_unknown_metric_is_refused(people, roles, hierarchy):
    with pytest.raises(ValueError, match="metric"):
        N.info_loss(people, roles, hierarchy, metric="other")
