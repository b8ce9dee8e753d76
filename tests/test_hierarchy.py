import pytest
from conftest import TREES, dgh_rows, tuples
from pyspark.sql import functions as F

from kveil.operators import hierarchy as H
from kveil.session import cut_lineage
from kveil.sources.config import DGH_SCHEMA


def closure_of(spark, rows):
    return H.dgh_closure(spark.createDataFrame(rows, DGH_SCHEMA))


def test_paths_follow_parent_names(hierarchy):
    paths = {(r.attr, r.value): r.path for r in hierarchy.closure.collect()}
    assert paths["race", "White"] == ["Person", "General", "White"]
    assert paths["workclass", "Private"] == ["Employee", "Local-employee", "Others", "Private"]
    assert len(paths) == sum(map(len, TREES.values()))


def test_orphans_hang_on_the_root(hierarchy, dgh):
    paths = {r.value: r.path for r in hierarchy.nodes("workclass").collect()}
    orphans = {"State-gov", "Federal-gov", "Local-gov", "Without-pay"}
    assert all(paths[o] == ["Employee", o] for o in orphans)
    assert {(r.value, r.issue) for r in H.dgh_validate(dgh).collect()} == {(o, "orphan") for o in orphans}


def test_spans_hold_exactly_the_descendants(hierarchy):
    nodes = hierarchy.nodes("workclass").collect()
    for a in nodes:
        inside = {b.value for b in nodes if a.pre <= b.pre <= a["last"]}
        assert inside == {b.value for b in nodes if a.value in b.path}
        assert a.height == max(len(b.path) for b in nodes if a.value in b.path) - len(a.path)


def test_validation_names_every_fault(spark):
    rows = [
        ("a", "root", "root", 1, None),
        ("a", "other", "other", 1, None),
        ("a", "x", "root", 2, None),
        ("a", "x", "other", 3, None),
        ("a", "p", "q", 2, None),
        ("a", "q", "p", 2, None),
        ("a", "lost", "nowhere", 2, None),
    ]
    found = {(r.value, r.issue) for r in H.dgh_validate(spark.createDataFrame(rows, DGH_SCHEMA)).collect()}
    # the root is the top of least level, then name
    assert found == {
        ("root", "extra_root"),
        ("x", "duplicate"),
        ("lost", "orphan"),
        ("p", "unreachable"),
        ("q", "unreachable"),
    }


def test_large_hierarchies_take_the_distributed_way(spark, hierarchy, dgh, monkeypatch):
    monkeypatch.setattr(H, "settle", lambda df: (cut_lineage(df), None if df.limit(1).count() else 0))
    large = H.dgh_closure(dgh)
    fields = ["attr", "value", "depth", "height", "path", "level", "is_leaf"]
    assert tuples(large.select(*fields), "attr", "value") == tuples(
        hierarchy.closure.select(*fields), "attr", "value"
    )
    for tree in (large, hierarchy.closure):
        nodes = tree.where("attr = 'race'").collect()
        for a in nodes:
            assert {b.value for b in nodes if a.pre <= b.pre <= a["last"]} == {
                b.value for b in nodes if a.value in b.path
            }


@pytest.mark.parametrize(
    "a, b, lca, level",
    [
        ("White", "Black", "General", 2),
        ("White", "Asian", "Person", 1),
        ("White", "White", "White", 3),
        ("General", "Black", "General", 2),
        ("White", "Other", "not found", None),
        ("Other", "White", "not found", None),
        (None, "White", "not found", None),
    ],
)
def test_lowest_common_ancestor(spark, hierarchy, a, b, lca, level):
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    row = H.lca_pairs(pair, "a", "b", hierarchy, "race").first()
    assert (row.lca, row.lca_level) == (lca, level)


def test_level_given_counts_for_orphans(spark, hierarchy):
    pair = spark.createDataFrame([("State-gov", "State-gov")], "a string, b string")
    assert H.lca_pairs(pair, "a", "b", hierarchy, "workclass").first().lca_level == 4


def test_ancestor_at_level(spark, hierarchy):
    df = spark.createDataFrame([("Private",), ("Self-emp",), ("?",)], "w string")
    at = {r.w: r.ancestor for r in H.ancestor_at(df, "w", 3, hierarchy.closure, "workclass").collect()}
    assert at == {"Private": "Others", "Self-emp": "Self-emp", "?": None}


def test_tree_heights(hierarchy, spark):
    heights = lambda unit: {r.attr: r.height for r in H.tree_height(hierarchy.closure, unit).collect()}
    assert heights("edges") == {"race": 2, "sex": 1, "workclass": 3}
    assert heights("levels") == {"race": 3, "sex": 2, "workclass": 4}
    lone = closure_of(spark, [("z", "only", "only", 1, None)])
    assert H.tree_height(lone, "levels").first().height == 0


def test_any_fan_out(spark):
    rows = [("n", "top", None, 1, None)] + [("n", f"v{i}", "top", 2, None) for i in range(40)]
    closure = closure_of(spark, rows)
    assert closure.where("is_leaf").count() == 40
    assert closure.where("value = 'top'").select(F.col("last") - F.col("pre")).first()[0] == 40


@pytest.mark.parametrize("depth", [1, 2, 4, 5, 16, 17, 64])
def test_deep_chains(spark, depth):
    rows = [("d", f"v{i}", f"v{max(i - 1, 0)}", None, None) for i in range(depth)]
    closure = closure_of(spark, rows)
    assert [r.path for r in closure.where("is_leaf").collect()] == [[f"v{i}" for i in range(depth)]]
    assert closure.where("depth = 1").first().height == depth - 1


def test_too_deep_a_chain_is_refused(spark):
    rows = [("d", f"v{i}", f"v{max(i - 1, 0)}", None, None) for i in range(65)]
    with pytest.raises(ValueError, match="deeper"):
        closure_of(spark, rows)
