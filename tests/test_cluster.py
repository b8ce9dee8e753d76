import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from kveil.functions import blocks
from kveil.operators.cluster import BlockPlan, assign_clusters, greedy_k_member
from kveil.operators.generalize import k_anonymize, verify_k
from kveil.operators.hierarchy import Hierarchy
from kveil.operators.neighbors import total_info_loss
from kveil.plans import anonymize
from kveil.sources.config import DGH_SCHEMA, Roles, category, numeric

# heights and domain are powers of two, so equal losses are equal floats
PARENT = {"a": "L", "b": "L", "c": "R", "d": "R", "L": "Top", "R": "Top", "Top": None}
ROLES = Roles(quasi=(numeric("n"), category("c"), category("e")), sensitive=(category("s"),))


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("c", v, p or v, None, None) for v, p in PARENT.items()]
    return Hierarchy.build(spark.createDataFrame(rows, DGH_SCHEMA))


def make(n, seed, nulls=False):
    rng = random.Random(seed)
    values = ["a", "b", "c", "d"] + (["L", "?", "!", None] if nulls else [])
    rows = [
        (
            i + 1,
            None if nulls and rng.random() < 0.1 else rng.randrange(65),
            rng.choice(values),
            rng.choice(["x", "y"] + ([None] if nulls else [])),
            f"s{rng.randrange(5)}",
        )
        for i in range(n)
    ]
    rows[0], rows[1] = (1, 0, *rows[0][2:]), (2, 64, *rows[1][2:])
    return rows


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, "id long, n int, c string, e string, s string").repartition(parts)


def path(v):
    out = []
    while v is not None:
        out.append(v)
        v = PARENT[v]
    return out[::-1]


HEIGHT = {"Top": 2, "L": 1, "R": 1}


def loss(rows):
    """Loss per row of (id, n, c, e, s) rows, from the definition."""
    numbers = {r[1] for r in rows}
    known = numbers - {None}
    total = 1.0 if known and None in numbers else (max(known) - min(known)) / 64 if known else 0.0
    values = {r[2] for r in rows}
    if len(values) > 1:
        if any(v not in PARENT for v in values):
            total += 1.0
        else:
            shared = [p for p in zip(*map(path, values)) if len(set(p)) == 1]
            total += HEIGHT[shared[-1][0]] / 2
    return total + (1.0 if len({r[3] for r in rows}) > 1 else 0.0)


def brute_force(rows, k, hashes):
    """The published method over one block; returns id -> (cluster, kind)."""
    free = sorted(rows)
    r = min(free, key=lambda x: (hashes[x[0]], x[0]))
    out, clusters = {}, []
    while len(free) >= k:
        r = max(free, key=lambda x: (loss([r, x]), -x[0]))
        free.remove(r)
        members = [r]
        out[r[0]] = (len(clusters) + 1, "Centroid")
        while len(members) < k:
            r = min(free, key=lambda x: (loss(members + [x]), x[0]))
            free.remove(r)
            members.append(r)
            out[r[0]] = (len(clusters) + 1, "Member")
        clusters.append(members)
    for r in free:
        gain = [(k + 1) * loss(c + [r]) - k * loss(c) for c in clusters]
        out[r[0]] = (gain.index(min(gain)) + 1, "Remainder")
    return out


def hashes_of(df, seed):
    return {r.id: r.h for r in df.select("id", F.xxhash64("id", F.lit(seed)).alias("h")).collect()}


@pytest.mark.parametrize("n, k, seed, nulls", [(40, 3, 0, False), (61, 5, 1, False), (83, 4, 2, True), (50, 7, 3, True)])
def test_one_block_is_the_published_method(spark, tree, n, k, seed, nulls):
    rows = make(n, seed, nulls)
    df = table(spark, rows)
    got = greedy_k_member(df, ROLES, tree, k, seed=seed)
    assert got.columns == ["id", "n", "c", "e", "s", "Cluster", "Info"]
    want = brute_force(rows, k, hashes_of(df, seed))
    assert {r.id: (int(r.Cluster.split()[1]), r.Info) for r in got.collect()} == want
    assert tuples(got.drop("Cluster", "Info"), "id") == sorted(rows)


@pytest.mark.parametrize("n, k, block", [(500, 3, 40), (333, 2, 20), (1000, 5, 50), (64, 4, 40), (81, 4, 40)])
def test_each_block_is_clustered_by_itself(spark, tree, n, k, block):
    rows = make(n, n, nulls=True)
    df = table(spark, rows)
    got = greedy_k_member(df, ROLES, tree, k, block_rows=block, exchange=0).collect()
    plan = BlockPlan(n, k, block)
    sizes = [plan.base + (b < plan.rem) for b in range(plan.count)]
    assert sum(sizes) == n and all(block <= s < 2 * block for s in sizes)
    hashes, by_id, first = hashes_of(df, 0), {r[0]: r for r in rows}, 0
    for size in sizes:
        names = range(first + 1, first + size // k + 1)
        mine = [r for r in got if int(r.Cluster.split()[1]) in names]
        assert len(mine) == size
        want = brute_force([by_id[r.id] for r in mine], k, hashes)
        assert {r.id: (int(r.Cluster.split()[1]) - first, r.Info) for r in mine} == want
        first += size // k
    assert len({r.Cluster for r in got}) == first


@pytest.mark.parametrize("nulls", [False, True])
def test_rows_that_cross_the_borders_lose_less(spark, tree, nulls):
    """Same cluster names and sizes, every row once, and never a greater loss."""
    df = table(spark, make(600, 7, nulls))
    alone, crossed = (greedy_k_member(df, ROLES, tree, 5, block_rows=60, exchange=x) for x in (0, 0.4))
    names = lambda got: sorted((r.Cluster, r.n) for r in got.groupBy("Cluster").agg(F.count("*").alias("n")).collect())
    assert names(alone) == names(crossed)
    assert tuples(crossed.select("id", "n", "c", "e", "s"), "id") == tuples(df, "id")
    kinds = {r.Info: r.n for r in crossed.groupBy("Info").agg(F.count("*").alias("n")).collect()}
    assert kinds["Centroid"] == len(names(crossed)) and kinds["Member"] == 4 * kinds["Centroid"]
    before, after = (total_info_loss(got, ROLES, tree).first().info_loss for got in (alone, crossed))
    assert after < before


@pytest.mark.parametrize("seed", range(6))
def test_worst_clusters_are_those_of_k_rows_that_lose_most(seed):
    rng = np.random.default_rng(seed)
    sizes, k = np.array([23, 20]), 4
    valid = np.arange(23)[None, :] < sizes[:, None]
    label = np.zeros((2, 23), np.int64)
    for b, n in enumerate(sizes):
        label[b, :n] = rng.permutation(np.r_[np.repeat(np.arange(n // k) + 1, k), rng.integers(1, n // k + 1, n % k)])
    own = np.round(rng.random((2, 5)), 1)
    again, loss = blocks.worst_clusters(label, own, valid, sizes, k, 0.5)
    for b, n in enumerate(sizes):
        count = np.bincount(label[b, :n], minlength=6)
        whole = sorted((-own[b, c - 1], c) for c in range(1, 6) if count[c] == k and own[b, c - 1] > 0)
        worst = {c for _, c in whole[: int(0.5 * (n // k))]}
        assert {int(c) for c in label[b, :n][again[b, :n]]} == worst
        assert not again[b, n:].any()
        assert all(loss[b, i] == own[b, label[b, i] - 1] for i in range(n) if again[b, i])


def test_labels_from_the_kernel_are_those_of_the_clusters(spark, tree):
    """No exchange and no window after the clusters are made, and the same labels as from the clustered table."""
    df = table(spark, make(400, 3, nulls=True))
    with pytest.warns(UserWarning):
        clustered, got = anonymize(df, ROLES, tree, 4, block_rows=50)
    with pytest.warns(UserWarning):
        want = k_anonymize(clustered.drop("Info"), ROLES, tree, bounded=True)
    assert got.columns == want.columns and tuples(got, "id") == tuples(want, "id")
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan


def test_partitioning_does_not_matter(spark, tree):
    rows = make(400, 9, nulls=True)
    results = [
        tuples(greedy_k_member(table(spark, rows, p), ROLES, tree, 4, block_rows=40), "id") for p in (1, 4, 13)
    ]
    assert results[0] == results[1] == results[2]


def test_copies_fill_many_blocks(spark, tree):
    """A third of all rows is alike; every block stays bounded and every class has k rows."""
    rows = make(600, 5)
    rows = [(i, 7, "a", "x", s) if i % 3 == 0 else (i, n, c, e, s) for i, n, c, e, s in rows]
    got = greedy_k_member(table(spark, rows), ROLES, tree, 5, block_rows=50)
    sizes = [r.n for r in got.groupBy("Cluster").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and min(sizes) >= 5 and max(sizes) <= 9


@pytest.mark.parametrize("k", [2, 5, 11])
def test_result_is_k_anonymous_and_close(spark, tree, k):
    df = table(spark, make(300, k, nulls=True))
    got = greedy_k_member(df, ROLES, tree, k)
    with pytest.warns(UserWarning):
        out = k_anonymize(got.drop("Info"), ROLES, tree, bounded=True)
    assert verify_k(out, ["n", "c", "e"]).first().min_class_size >= k
    chunks = df.withColumn("h", F.xxhash64("id")).orderBy("h").collect()
    at_random = spark.createDataFrame(
        [(*r[:5], f"Cluster {min(i // k, 300 // k - 1)}") for i, r in enumerate(chunks)],
        "id long, n int, c string, e string, s string, Cluster string",
    )
    greedy = total_info_loss(got, ROLES, tree).first().info_loss
    assert greedy < total_info_loss(at_random, ROLES, tree).first().info_loss


def test_sizes_at_the_edges(spark, tree):
    rows = make(6, 0)
    with pytest.raises(ValueError, match="cannot form"):
        greedy_k_member(table(spark, rows), ROLES, tree, 7)
    one = greedy_k_member(table(spark, rows), ROLES, tree, 6)
    assert [r.Cluster for r in one.select("Cluster").distinct().collect()] == ["Cluster 1"]
    each = greedy_k_member(table(spark, rows), ROLES, tree, 1)
    assert each.select("Cluster").distinct().count() == 6
    with pytest.raises(ValueError, match="not unique"):
        greedy_k_member(table(spark, rows + rows), ROLES, tree, 2, check_keys=True)


def test_text_keys_and_only_categories(spark, tree):
    rows = [(f"p{i:03d}", "abcd"[i % 4]) for i in range(48)]
    df = spark.createDataFrame(rows, "who string, c string")
    got = greedy_k_member(df, Roles(quasi=(category("c"),)), tree, 4, key="who")
    assert got.groupBy("Cluster").agg(F.count_distinct("c").alias("d")).agg(F.max("d")).first()[0] == 1


def test_constant_number(spark, tree):
    df = spark.createDataFrame([(i, 5) for i in range(20)], "id int, n int")
    got = greedy_k_member(df, Roles(quasi=(numeric("n"),)), tree, 3)
    assert got.count() == 20 and got.schema["n"].dataType.simpleString() == "int"


def test_odd_column_names(spark):
    names = ["native-country", "a.b", "x y", "from"]
    rows = [("n", v, p, None, None) for v, p in [("Top", "Top"), ("a", "Top"), ("b", "Top")]]
    dgh = spark.createDataFrame([(names[0], *r[1:]) for r in rows], DGH_SCHEMA)
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 7 % 13, "uv"[i % 2], i) for i in range(30)], ["id", *names])
    df = df.withColumn("a.b", F.col("`a.b`").cast("int"))
    roles = Roles(quasi=(category(names[0]), numeric(names[1]), category(names[2])), sensitive=(category(names[3]),))
    odd = Hierarchy.build(dgh)
    got = greedy_k_member(df, roles, odd, 3)
    assert total_info_loss(got, roles, odd).first().rows == 30
    for bounded in (True, False):
        with pytest.warns(UserWarning):
            out = k_anonymize(got.drop("Info"), roles, odd, bounded=bounded)
        assert out.columns == ["id", *names] and verify_k(out, names[:3]).first().min_class_size >= 3


def test_large_hierarchy_is_joined_before_the_shuffle(spark, tree, monkeypatch):
    rows = make(90, 4, nulls=True)
    small = tuples(greedy_k_member(table(spark, rows), ROLES, tree, 4), "id")
    monkeypatch.setattr("kveil.operators.hierarchy.SMALL_ROWS", 3)
    assert not tree.small
    assert tuples(greedy_k_member(table(spark, rows), ROLES, tree, 4), "id") == small


def test_block_arithmetic_at_scale():
    plan = BlockPlan(10**12 + 7, 5, 1000)
    assert plan.count == 10**9 and plan.base == 1000 and plan.rem == 7


# a tree of height 3 in preorder: node -> (parent, height), leaves have height 0
DEEP = {0: (None, 3), 1: (0, 2), 2: (1, 1), 3: (2, 0), 4: (2, 0), 5: (1, 0), 6: (0, 1), 7: (6, 0), 8: (6, 0), 9: (0, 0)}
LAST = {0: 9, 1: 5, 2: 4, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 8, 9: 9}


def up(node):
    out = [node]
    while DEEP[node][0] is not None:
        node = DEEP[node][0]
        out.append(node)
    return out


def exact_loss(rows, domain):
    """Loss of (number, number, node) rows in exact arithmetic."""
    total = sum(Fraction(max(r[i] for r in rows) - min(r[i] for r in rows), domain) for i in (0, 1))
    shared = set.intersection(*(set(up(r[2])) for r in rows))
    return total + Fraction(min(DEEP[s][1] for s in shared), 3)


def exact_method(rows, k, seed, domain):
    free, out, clusters, r = list(range(len(rows))), {}, [], seed
    while len(free) >= k:
        r = max(free, key=lambda x: (exact_loss([rows[r], rows[x]], domain), -x))
        free.remove(r)
        members = [r]
        while len(members) < k:
            r = min(free, key=lambda x: (exact_loss([rows[m] for m in members] + [rows[x]], domain), x))
            free.remove(r)
            members.append(r)
        clusters.append(members)
        out |= {m: len(clusters) for m in members}
    for r in free:
        gain = [
            (k + 1) * exact_loss([rows[m] for m in c + [r]], domain) - k * exact_loss([rows[m] for m in c], domain)
            for c in clusters
        ]
        out[r] = gain.index(min(gain)) + 1
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("domain", [10, 25])
@pytest.mark.parametrize("seed", range(20))
def test_ties_go_to_the_least_key_in_exact_arithmetic(domain, seed):
    rng = random.Random(seed)
    leaves = [3, 4, 5, 7, 8, 9]
    rows = [(rng.randrange(domain + 1), rng.randrange(domain + 1), rng.choice(leaves)) for _ in range(60)]
    k, first = rng.choice([3, 4, 7]), rng.randrange(60)
    lo, hi, drop = np.full((60, 3), np.inf), np.full((60, 3), -np.inf), np.zeros((60, 3))
    for i, (_, _, leaf) in enumerate(rows):
        above = 1.0
        for d, node in enumerate(up(leaf)[::-1][1:]):
            lo[i, d], hi[i, d] = node, LAST[node]
            drop[i, d], above = DEEP[node][1] / 3 - above, DEEP[node][1] / 3
    number = [np.array([[r[i] / domain for r in rows]]) for i in (0, 1)]
    category = [(np.array([[float(r[2]) for r in rows]]), lo[None], hi[None], drop[None])]
    valid, sizes = np.ones((1, 60), dtype=bool), np.array([60])
    got, _ = blocks.cluster_blocks(number, category, valid, sizes, np.array([first]), k)
    assert got[0].tolist() == exact_method(rows, k, first, domain)


def test_one_outlier_does_not_widen_the_other_clusters(spark, tree):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1_000_000), rng.randrange(1_000_000)) for i in range(6000)]
    roles = Roles(quasi=(numeric("a"), numeric("b")))

    def width(data):
        df = spark.createDataFrame(data, "id long, a int, b int")
        got = greedy_k_member(df, roles, tree, 5, block_rows=200).where("id < 6000")
        spread = got.groupBy("Cluster").agg((F.max("a") - F.min("a") + F.max("b") - F.min("b")).alias("w"))
        return spread.agg(F.avg("w")).first()[0]

    assert width(rows + [(6000, 2_000_000_000, 2_000_000_000)]) < 1.2 * width(rows)


def test_block_rule_is_checked(spark, tree):
    df = table(spark, make(30, 1))
    with pytest.raises(ValueError, match="below k"):
        greedy_k_member(df, ROLES, tree, 7, block_rows=6)
    many = Roles(quasi=tuple(numeric(f"q{i}") for i in range(63)))
    with pytest.raises(ValueError, match="62"):
        greedy_k_member(df, many, tree, 2)


def test_kinds_of_rows_cluster_like_rows_one_by_one(monkeypatch):
    """Blocks of alike rows and of few kinds against the plain method, which blocks of alike rows do not need."""
    r = np.random.default_rng(3)
    plain = blocks.cluster_rows
    for t in range(60):
        count, width = int(r.integers(1, 6)), int(r.integers(5, 80))
        sizes = r.integers(max(5, width - 3), width + 1, count)
        valid = np.arange(width)[None] < sizes[:, None]
        number = r.integers(0, 1 + t % 4, (count, width)) / 4
        if t % 2:
            number = np.where(r.random((count, width)) < 0.1, np.nan, number)
        pre = r.integers(0, 1 + t % 7, (count, width)).astype(float)
        number[0], pre[0] = 0.5, 1.0
        group = pre // 3
        lo, hi = np.stack([group * 3, pre], 2), np.stack([group * 3 + 2, pre], 2)
        given = [number], [(pre, lo, hi, np.full(lo.shape, -0.5))], valid, sizes, r.integers(0, sizes), 5
        want, got = plain(*given), blocks.cluster_all(*given)
        live = np.arange(want[2].shape[1])[None] < (sizes // 5)[:, None]
        assert (want[0] == got[0]).all() and (want[1][valid] == got[1][valid]).all()
        assert (want[2][live] == got[2][live]).all()
        monkeypatch.setattr(blocks, "cluster_rows", None)
        alike = [v[:1] for v in given[0]], [tuple(x[:1] for x in c) for c in given[1]], *(x[:1] for x in given[2:5]), 5
        if not np.isnan(alike[0][0][valid[:1]]).any():
            assert (blocks.cluster_all(*alike)[0] == want[0][:1]).all()
        monkeypatch.setattr(blocks, "cluster_rows", plain)


def test_the_input_of_clustering_is_computed_once_for_all_passes(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(row):
        seen.add(1)
        return row

    rows = spark.sparkContext.parallelize([(i, i % 7) for i in range(40)], 1).map(told)
    df = spark.createDataFrame(rows, "id long, v int")
    tree = Hierarchy.build(spark.createDataFrame([("x", "r", "r", 1, None)], DGH_SCHEMA))
    assert assign_clusters(df, Roles(quasi=(numeric("v"),)), tree, 5, block_rows=10).count() == 40
    assert seen.value == 40
