import pytest
from conftest import tuples
from pyspark.sql import functions as F

from kveil.operators import generalize as G
from kveil.operators.hierarchy import Hierarchy
from kveil.sources.config import DGH_SCHEMA, Roles, category, numeric

# Hand-computed answers for the person table.
LCA = {
    "Cluster 1": ("[28-49]", "General", "Female", "Private"),
    "Cluster 2": ("[37-52]", "White", "Adult", "Local-employee"),
    "Cluster 3": ("[39-53]", "General", "Male", "Employee"),
}
ROOT = {
    "Cluster 1": ("[28-49]", "Person", "Female", "Private"),
    "Cluster 2": ("[37-52]", "White", "Adult", "Employee"),
    "Cluster 3": ("[39-53]", "Person", "Male", "Employee"),
}


def expected(people, answers):
    return [(r.id, *answers[r.Cluster], r.income) for r in people.orderBy("id").collect()]


@pytest.mark.parametrize("level, answers", [("lca", LCA), ("root", ROOT), (1, ROOT), (9, LCA)])
@pytest.mark.parametrize("bounded", [False, True])
def test_person_table(people, roles, hierarchy, level, answers, bounded):
    out = G.k_anonymize(people, roles, hierarchy, level=level, bounded=bounded)
    assert out.columns == ["id", "age", "race", "sex", "workclass", "income"]
    assert tuples(out, "id") == expected(people, answers)


@pytest.mark.parametrize("hot_rows", [0, 2, 3, 10])
def test_hot_clusters_give_the_same_rows(spark, people, roles, hierarchy, hot_rows):
    extra = spark.createDataFrame(
        [(i, 20 + i % 50, "Black", "Male", "Private", "<=50K", "Cluster 1") for i in range(10, 60)], people.schema
    )
    rows = people.unionByName(extra)
    plain = G.k_anonymize(rows, roles, hierarchy)
    assert tuples(G.k_anonymize(rows, roles, hierarchy, hot_rows=hot_rows), "id") == tuples(plain, "id")


@pytest.mark.parametrize("bounded, hot_rows", [(False, 2), (False, 100), (True, 100)])
def test_rows_without_cluster_are_suppressed(spark, people, roles, hierarchy, bounded, hot_rows):
    lost = people.withColumn("Cluster", F.when(F.col("id") > 3, F.col("Cluster")))
    out = tuples(G.k_anonymize(lost, roles, hierarchy, bounded=bounded, hot_rows=hot_rows), "id")
    assert len(out) == 9
    assert [r[1:] for r in out[:3]] == [(None, None, None, None, "<=50K")] * 3
    assert None not in out[5]


def one_cluster(spark, rows, bounded, level="lca"):
    dgh = spark.createDataFrame(
        [("c", "Top", "Top", 1, None), ("c", "a", "Top", 2, None), ("c", "b", "Top", 2, None)], DGH_SCHEMA
    )
    df = spark.createDataFrame([(i, n, c, d, "Cluster 1") for i, (n, c, d) in enumerate(rows)],
                               "id int, n int, c string, d string, Cluster string")
    roles = Roles(quasi=(numeric("n"), category("c"), category("d")))
    with pytest.warns(UserWarning, match="no hierarchy"):
        out = G.k_anonymize(df, roles, Hierarchy.build(dgh), bounded=bounded, level=level)
    return {tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize(
    "rows, answer",
    [
        # NULL is a value of its own: beside another one it is generalized, too
        ([(1, "a", "x"), (None, None, None)], ("[1-1]", "Top", "*")),
        ([(None, None, None), (None, None, None)], (None, None, None)),
        ([(5, "a", "x"), (5, "a", "x")], ("5", "a", "x")),
        # a value in no tree is a child of the root
        ([(5, "?", "x"), (5, "?", "x")], ("5", "?", "x")),
        ([(5, "?", "x"), (5, "!", "x")], ("5", "Top", "x")),
        ([(5, "?", "x"), (5, "a", "y")], ("5", "Top", "*")),
        ([(-5, "a", "x"), (7, "b", "x")], ("[-5-7]", "Top", "x")),
    ],
)
def test_nulls_and_unmapped_values(spark, rows, answer, bounded):
    assert one_cluster(spark, rows, bounded) == {answer}


def test_verify_and_coverage(people, roles, hierarchy):
    qi = ["age", "race", "sex", "workclass"]
    out = G.k_anonymize(people, roles, hierarchy)
    row = G.verify_k(out, qi).first()
    assert (row.classes, row.rows, row.min_class_size) == (3, 9, 3)
    c = G.coverage(people, out, qi).first()
    assert (c.rows, c.anonymized, c.not_anonymized, c.anonymized_share) == (9, 9, 0, 1.0)
    same = G.coverage(people, people, qi).first()
    assert (same.anonymized, same.not_anonymized_share) == (0, 1.0)
    less = G.coverage(people, out.where("id > 3"), qi).first()
    assert (less.rows, less.anonymized, less.removed, less.anonymized_share) == (9, 6, 3, 0.6667)


def test_clusters_are_matched_by_equality(spark, hierarchy, roles, people):
    renamed = people.replace({"Cluster 2": "Cluster 10", "Cluster 3": "Cluster 1x"}, subset=["Cluster"])
    a = tuples(G.k_anonymize(renamed, roles, hierarchy), "id")
    assert a == tuples(G.k_anonymize(people, roles, hierarchy), "id")


def test_roles_reject_a_clash():
    with pytest.raises(ValueError, match="both identifier"):
        Roles(quasi=(category("a"),), identifiers=(category("a"),))


def test_dgh_schema_of_empty_hierarchy(spark, people, roles):
    empty = Hierarchy.build(spark.createDataFrame([], DGH_SCHEMA))
    with pytest.warns(UserWarning):
        out = G.k_anonymize(people, roles, empty)
    row = out.where("id = 5").first()
    assert (row.age, row.race, row.sex, row.workclass) == ("[28-49]", "*", "Female", "Private")
