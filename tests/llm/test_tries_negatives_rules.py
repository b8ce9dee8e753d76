"""Prefix trie, hard negatives and the rule ensemble, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from kveil.llm import negatives, prefixes, rules
from pyspark.sql import functions as F
from samples import docs, empty, rows, texts  # noqa: F401

TURNS = "conv_id long, turn long, role string, text string, digest string, no long"


def plain_trie(rows):
    """Every prefix of every rebuilt conversation, kept as a tuple."""
    told = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256((f"{len(role.encode())}:" + role + text).encode()).digest()
            told[c].append(((t is not None, t or 0), digest, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda z: z[:2])] for c, v in told.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += n not in children
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        up = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), up, len(m), children.get(n, 0), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed, texts):
    r = random.Random(seed)
    out = []
    for c in range(-7, 30):
        for t in range(r.choice([1, 2, 5, 9, 10, 11, 12, 25])):
            c_id = c if r.random() < 0.97 else None
            out.append((c_id, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(texts), "d", 1))
    return out + out[:5]


@pytest.mark.parametrize("piece, run", [(3, 2), (128, 4096)])
def test_prefix_trie(spark, monkeypatch, piece, run):
    table = conversations(piece, ["a", "b", "a", "é", None, "", "x" * 5000])
    whole = prefixes.chained
    monkeypatch.setattr(prefixes, "chained", lambda rows, _=0: whole(rows, piece))
    monkeypatch.setattr(prefixes, "RUN", run)
    got = prefixes.conversation_trie(spark.createDataFrame(table, TURNS).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(table)


def test_prefix_trie_of_copies_and_of_one_long_conversation(spark):
    """A conversation that most others repeat, one with most of all turns, and one without any turn left."""
    table = [(c, t, "user", f"t{t}", "d", 1) for c in range(60) for t in range(3)]
    table += [(1000, t, "user", str(t % 7), "d", 1) for t in range(400)]
    table += [(1001, 0, "user", "gone", "d", 1)]
    got = prefixes.conversation_trie(spark.createDataFrame(table, TURNS)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(table)


def test_prefix_trie_of_nothing(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert prefixes.conversation_trie(nothing).count() == 0
    strays = spark.createDataFrame([(None, 0, "user", "x", "d", 1)], TURNS)
    assert prefixes.conversation_trie(strays).count() == 0


def plain_negatives(rows, share=(50, 95)):
    """rows: (id, label, components), ids unique."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in rows:
        if i % 50:
            continue
        ranked = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for score, j, _ in [x for x in ranked if x[2] == label][:5]:
            near = [(-s, k) for s, k, other in ranked if other != label and share[0] * -score <= 100 * -s <= share[1] * -score]
            out += [(i, j, n + 1, k, -score, s) for n, (s, k) in enumerate(near[:3])]
    return sorted(out)


@pytest.mark.parametrize("block, group, slice_", [(4, 2, 7), (512, 4096, 1 << 20)])
def test_hard_negatives(spark, monkeypatch, block, group, slice_):
    r = random.Random(block)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "SLICE", slice_)
    table = []
    for i in range(-100, 160):
        v = [r.uniform(-1, 1) if r.random() < 0.8 else r.choice([0.0, 0.5]) for _ in range(r.choice([5, 5, 5, 4, 0]))]
        table.append((i, r.choice([1, 1, 1, 2, 3]), table[-1][2] if table and r.random() < 0.2 else v, "x"))
    bad = [(500, None, [1.0], "x"), (550, 1, None, "x"), (600, 1, [1.0, None], "x"), (650, 1, [float("nan")], "x")]
    bad += [(700, 1, [float("inf")], "x"), (None, 1, [1.0], "x")]
    shape = "vec_id long, label int, embedding array<double>, ids string"
    df = spark.createDataFrame(table + bad + table[:9], shape).repartition(3)
    kept = negatives.quantised(df, "vec_id", F.col("label"), F.col("embedding"))
    got = negatives.hard_negatives(kept, F.col("id") % 50 == 0).collect()
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, _ in table]
    assert sorted(map(tuple, got)) == plain_negatives(whole)
    nothing = negatives.quantised(df.limit(0), "vec_id", F.col("label"), F.col("embedding"))
    assert negatives.hard_negatives(nothing, F.col("id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(kept, F.col("id") == 10**6).count() == 0


@pytest.mark.parametrize("low, high, dims", [(-160, 155, 64), (0, 1, 3), (-3, -3, 2), (-(10**6), 10**6, 9), (-1, 0, 1)])
def test_packed_products_are_exact(low, high, dims):
    r = np.random.default_rng(dims)
    values = r.integers(low, high + 1, (37, dims))
    values[0], values[1] = low, high
    anchors = r.integers(low, high + 1, (11, dims))
    anchors[0], anchors[1] = low, high
    fields = negatives.Fields.of(dims, min(low, 0), max(high, 0), float(np.abs(anchors).sum(axis=1).max()))
    assert (fields.scores(anchors, fields.pack(values), len(values)) == anchors @ values.T).all()


def test_scores_beyond_a_long_are_an_error():
    assert negatives.Fields.of(64, -160, 155, 2000.0).per_word == 3
    with pytest.raises(ValueError):
        negatives.Fields.of(64, -(2**40), 2**40, 2.0**50)


def test_tree_rules_read_every_path():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0E-4)
    Predict: 0.0
   Else (feature 1 > 2.0E-4)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""
    inf = math.inf
    assert rules.tree_rules(tree, ["a", "b"]) == [
        (("a", -inf, 0.5),),
        (("a", -inf, 0.5), ("b", -inf, 2e-4)),
        (("a", -inf, 0.5), ("b", 2e-4, inf)),
        (("a", 0.5, inf),),
        (("a", 0.5, 0.75),),
        (("a", 0.75, inf),),
    ]


def test_statistics_of_odd_texts(spark, docs, texts):
    names = [rules.S + n for n in rules.STATISTICS]
    got = {r.doc_id: r for r in rules.statistics(docs).select("doc_id", *names).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = {
            "words_log": math.log1p(len(words)),
            "distinct": len(set(words)) / max(1, len(words)),
            "repeats": sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)),
            "upper": sum("A" <= c <= "Z" for c in text or "") / max(1, len(text or "")),
        }
        for name, value in want.items():
            assert got[i][rules.S + name] == pytest.approx(value), (i, name)
    blank = {r.doc_id: r for r in rules.statistics(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()}
    assert all(blank[i][n] == 0 for i in (1, 2) for n in names if n != rules.S + "lines")


@pytest.fixture(scope="module")
def judged(spark):
    """Prose, and junk of two kinds with a third of all rows one and the same text."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    out = []
    for i in range(240):
        kind = i % 4
        prose = [r.choice(words) for _ in range(r.randint(5, 60))]
        text = " ".join(prose) if kind < 2 else " ".join(w + "###" for w in prose) if kind == 2 else "same " * 40
        out.append((i, text, int(kind < 2), "clash"))
    return spark.createDataFrame(out, "doc_id long, text string, label int, score string").repartition(2)


def test_rule_ensemble_holds_out(spark, judged):
    train = rules.statistics(judged.filter("doc_id % 3 > 0")).drop("text", "doc_id", "score")
    model = rules.fit_rules(train, trees=6)
    assert 0 < len(model.rules) == len(model.told())
    clash = judged.filter("doc_id % 3 = 0").withColumn("__r_symbols", F.lit("mine"))
    held = rules.classify(clash, model)
    assert held.columns == ["doc_id", "text", "label", "__r_symbols", "score", "predicted"]
    assert held.filter("__r_symbols = 'mine'").count() == 80
    got = held.select("label", "score", "predicted").collect()
    assert all(r.label == r.predicted and 0 <= r.score <= 1 for r in got)
    # the compiled expression is the sum of the weights of the rules that hold
    stats = rules.statistics(judged.limit(20)).withColumn("p", model.score()).collect()
    for r in stats:
        holds = [w for rule, w in model.rules if all(low < r[rules.S + n] <= high for n, low, high in rule)]
        assert r.p == pytest.approx(1 / (1 + math.exp(-model.intercept - sum(holds))))


def test_rule_ensemble_without_two_labels(spark, judged, docs, empty):
    train = rules.statistics(judged).drop("text", "doc_id", "score")
    assert rules.fit_rules(train.limit(0)) == rules.constant(0, 0)
    alone = rules.fit_rules(train.filter("label = 1"))
    assert alone.rules == () and alone.intercept > 0
    assert rules.classify(empty, alone).count() == 0
    assert rules.classify(docs, alone).count() == docs.count()


def test_draw_of_labels_is_bounded_and_keeps_to_its_fold(spark, judged):
    told = judged.select("doc_id", F.col("label").alias("quality"))
    told = told.union(spark.createDataFrame([(None, 1), (1, 0), (2, None), (5, 7)], "doc_id long, quality int"))
    got = rules.labelled(judged.select("doc_id", "text"), told, F.col("doc_id") % 2 == 0).select("label").collect()
    assert len(got) == 120 and sum(r.label for r in got) == 60
    few = rules.labelled(judged.select("doc_id", "text"), told, F.lit(True), most=40).count()
    assert 15 <= few <= 75
