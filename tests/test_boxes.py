"""The box index against a comparison of every leftover with every cluster."""

import random

import pytest
from pyspark.sql import functions as F

from kveil.operators import boxes
from kveil.operators import neighbors as N
from kveil.operators.cohorts import SIZE, attach_nodes, from_columns, loss_model, profiles
from kveil.operators.hierarchy import Hierarchy
from kveil.sources.config import DGH_SCHEMA, Roles, category, numeric

ROLES = Roles(quasi=(numeric("age"), category("town"), category("free")))
SHAPE = "id long, age int, town string, free string, Cluster string"


@pytest.fixture(scope="module")
def towns(spark):
    """Countries, counties and towns, three levels below the world."""
    rows = [("town", "World", "World", 1, None)]
    for a in range(4):
        rows.append(("town", f"country {a}", "World", 2, None))
        for b in range(3):
            rows.append(("town", f"county {a}{b}", f"country {a}", 3, None))
            rows += [("town", f"town {a}{b}{c}", f"county {a}{b}", 4, None) for c in range(3)]
    return Hierarchy.build(spark.createDataFrame(rows, DGH_SCHEMA))


def people(spark, n, seed, holes):
    """Clusters of five neighbours by town and age; with ``holes`` also nulls and towns in no tree."""
    r = random.Random(seed)
    towns = [f"town {a}{b}{c}" for a in range(4) for b in range(3) for c in range(3)]
    rows = [(r.choice(towns), r.randint(0, 90), r.choice("xy")) for _ in range(n)]
    if holes:
        odd = lambda value, other: r.choice([None, other]) if r.random() < 0.05 else value
        rows = [(odd(t, "nowhere"), odd(a, 5), odd(f, "z")) for t, a, f in rows]
    rows.sort(key=str)
    clustered = [(i, a, t, f, f"Cluster {i // 5 + 1}") for i, (t, a, f) in enumerate(rows)]
    left = [(10_000 + i, a, t, f, None) for i, (t, a, f) in enumerate(r.choices(rows, k=n // 4))]
    if holes:
        left += [(20_000, None, None, None, None), (20_001, 500, "elsewhere", "q", None), (20_001, 500, "elsewhere", "q", None)]
    return spark.createDataFrame(clustered, SHAPE), spark.createDataFrame(left, SHAPE).drop("Cluster")


def parts(spark, clustered, left, hierarchy):
    model = loss_model(clustered, ROLES, hierarchy)
    made = profiles(clustered, ROLES, hierarchy)
    made = made.select(
        F.expr("CAST(substr(Cluster, 9) AS long)").alias("__no"),
        F.col("Cluster").alias("__name"),
        *[F.col(f"`{c}`") for c in made.columns if c != "Cluster"],
    )
    rows = attach_nodes(left, ROLES, hierarchy, paths=True)
    rows = rows.select(F.col("id").alias("__id"), *[F.col(f"`{c}`") for c in rows.columns if c.startswith("__")])
    return made, rows, model


@pytest.mark.parametrize("holes, slice_rows, fanout, top, home", [(True, 3, 3, 2, 1), (False, 4, 4, 2, 2), (True, 256, 16, 64, 3)])
def test_every_leftover_gets_its_best_cluster(spark, towns, monkeypatch, holes, slice_rows, fanout, top, home):
    for name, value in (("SLICE", slice_rows), ("FANOUT", fanout), ("TOP", top), ("HOME", home)):
        monkeypatch.setattr(boxes, name, value)
    clustered, left = people(spark, 150, slice_rows, holes)
    made, rows, model = parts(spark, clustered, left, towns)
    delta = F.round(model.gain(from_columns, F.col(SIZE), from_columns), 9)
    bare = rows.drop(*[c for c in rows.columns if "__anc_" in c])
    met = made.crossJoin(bare).select("__id", F.struct(delta.alias("delta"), F.col("__no").alias("no"), F.col("__name").alias("name")).alias("b"))
    want = {r["__id"]: r.name for r in met.groupBy("__id").agg(F.min("b.delta"), F.min("b")["name"].alias("name")).collect()}
    best, _ = boxes.best_clusters(made, rows, model, towns)
    assert {r.id: r.name for r in best.collect()} == want
    got = N.assign_leftovers(left, clustered, ROLES, towns).select("id", "Cluster").collect()
    assert sorted((r.id, r.Cluster) for r in got) == sorted((r.id, want[r.id]) for r in left.collect())


def visited(spark, towns, n):
    clustered, left = people(spark, n, n, False)
    made, rows, model = parts(spark, clustered, left, towns)
    _, visits = boxes.best_clusters(made, rows, model, towns)
    pairs = visits.distinct().count()
    assert pairs == visits.count()
    return pairs, -(-made.count() // boxes.SLICE) * -(-rows.count() // boxes.SLICE)


def test_visited_blocks_grow_with_the_rows_not_with_their_square(spark, towns, monkeypatch):
    for name, value in (("SLICE", 4), ("FANOUT", 4), ("TOP", 4)):
        monkeypatch.setattr(boxes, name, value)
    (few, all_few), (many, all_many) = visited(spark, towns, 400), visited(spark, towns, 1600)
    assert all_many > 12 * all_few
    assert many / few < all_many / all_few / 2 and many < 0.2 * all_many


def test_a_plan_without_cross_joins(spark, towns):
    clustered, left = people(spark, 60, 1, True)
    plan = N.assign_leftovers(left, clustered, ROLES, towns)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_no_clusters_and_no_leftovers(spark, towns):
    clustered, left = people(spark, 20, 1, False)
    assert N.assign_leftovers(left, clustered.limit(0), ROLES, towns, {"age": (0, 9)}).where("Cluster IS NOT NULL").count() == 0
    assert N.assign_leftovers(left.limit(0), clustered, ROLES, towns).count() == 0
