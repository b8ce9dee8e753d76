"""Operators that compare texts with each other, against plain Python."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from kveil.llm import components, exact, jaccard, packing, simhash, substrings, toolcalls, wideprints
from pyspark.sql import functions as F
from samples import docs, empty, rows, texts  # noqa: F401
from tokenizers import Tokenizer


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, rows, empty):
    groups = {}
    for r in rows:
        groups.setdefault(normalised(r[1]), []).append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    got = [tuple(r) for r in exact.exact_dedup(docs, files_per_batch=1).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact.exact_dedup(empty).count() == 0


def test_digest_clashes_are_split_by_text(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "ab")], "doc_id long, text string")
    out = df.select(F.lit(b"x").alias("digest"), F.col("doc_id").alias("id"), F.lit(1).alias("keep_id"), F.lit(4).alias("group_size"))
    clashes = out.select("digest").distinct()
    monkeypatch.setattr(
        exact, "texts_of", lambda d, digests, i, t: d.select(F.lit(b"x").alias("digest"), F.col(i).alias("id"), F.col(t).alias("text"))
    )
    got = exact.split_clashes(df, out, clashes, "doc_id", "text").select("id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2)]
    assert exact.different_bytes(df, clashes.withColumn("size", F.lit(4)), "doc_id", "text").count() == 1


def test_keep_first_drops_copies_and_repeated_rows(spark, docs, texts):
    got = [r.doc_id for r in exact.keep_first(spark, docs, "").collect()]
    seen, want = set(), []
    for i, t in enumerate(texts):
        if normalised(t) not in seen:
            seen.add(normalised(t))
            want.append(i)
    assert sorted(got, key=str) == sorted([*want, None], key=str)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints, bits=3):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in root}


def test_simhash_components(docs, rows, empty):
    prints = {(r[0], r[1]): plain_fingerprint(r[1]) for r in rows}
    root = classes_of(set(prints.values()))
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    by_id = {i: p for (i, _), p in prints.items()}
    got = simhash.near_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        p = by_id[r.id]
        assert r.fingerprint == f"{p:016x}" and r.component_id == least.get(root[p])
    assert simhash.near_components(empty).count() == 0


@pytest.mark.parametrize("hot", [2048, 1])
def test_links_connect_like_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_LIST", hot)
    r = random.Random(3)
    prints = set()
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            prints.add(p)
            for b in r.sample(range(64), r.randint(1, 4)):
                p ^= 1 << b
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components.components(simhash.near_links(spark.createDataFrame(signed, "print long"))).collect()
    root = classes_of(prints)
    got = {n & (2**64 - 1): x for n, x in found}
    sizes = {}
    for p in prints:
        sizes.setdefault(root[p], set()).add(p)
    for members in sizes.values():
        assert len({got.get(p, p) for p in members}) == 1
        assert all((p in got) == (len(members) > 1) for p in members)


def test_flips_find_what_tallies_find():
    r = random.Random(5)
    base = r.getrandbits(64) & ~0xFFFFFF
    prints = np.array(sorted({base | r.getrandbits(24) & 0x30F0F for _ in range(300)}), dtype=np.uint64)
    by_flips = simhash.forest_by_flips(prints, simhash.flips((3, 4, 5, 6, 7)))
    by_tally = simhash.forest_by_tally(prints)
    assert len(by_flips) == len(by_tally) == len(prints) - 1


def test_the_near_duplicate_stage_keeps_one_of_similar_texts_and_all_others(spark):
    r = random.Random(11)

    def prose(n):
        return [f"w{r.randrange(3000)}" for _ in range(n)]

    def similarity(a, b):
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    rows = []
    for k in range(40):
        base = prose(150)
        other = list(base)
        for at in r.sample(range(5, 145), r.randint(1, 6)):
            other[at] = "changed"
        rows += [(2 * k, base), (2 * k + 1, other)]
    want = {2 * k for k in range(40)} | {2 * k + 1 for k in range(40) if similarity(rows[2 * k][1], rows[2 * k + 1][1]) < 0.8}
    assert 45 < len(want) < 75
    one = prose(100)
    rows += [(100 + k, one[:k] + ["own"] + one[k + 1 :]) for k in range(60)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    assert {x.doc_id for x in simhash.keep_one(spark, df, "").collect()} == want | {100}


def test_the_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    r = random.Random(12)
    a, b, c = ([f"w{r.randrange(3000)}" for _ in range(100)] for _ in range(3))

    def near(x):
        return ["own", *x[1:]]

    rows = [(1, a), (2, near(a)), (2, b), (3, c), (3, near(c)), (None, near(b))]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    got = [(x.doc_id, x.text.split()) for x in simhash.keep_one(spark, df, "").collect()]
    assert (1, a) in got and (2, b) in got and (2, near(a)) not in got and (None, near(b)) in got
    assert sum(i == 3 for i, _ in got) == 1 and len(got) == 4


def test_the_near_duplicate_stage_keeps_one_of_equal_texts(spark):
    """Copies went only if some different text was near them; texts without words are copies as well."""
    r = random.Random(13)
    a, b, c = ([f"w{r.randrange(3000)}" for _ in range(100)] for _ in range(3))
    near = ["own", *b[1:]]
    rows = [(4, a), (2, a), (9, a), (5, b), (6, b), (7, near), (8, c), (1, []), (3, []), (None, c), (11, c), (8, c)]
    rows = [(i, " ".join(x)) for i, x in rows] + [(10, None), (12, " \t"), (13, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(x.doc_id) for x in simhash.keep_one(spark, df, "").collect())
    # a row told twice with text and id is one document, and one without an id stays
    assert got == sorted(["2", "5", "8", "8", "None", "1"])
    found = {(x.id, x.component_id, x.kept) for x in jaccard.near_copies(df).collect()}
    assert found >= {(4, 2, False), (2, 2, True), (9, 2, False), (8, 8, True), (None, 8, False), (11, 8, False), (3, 1, False)}


def bits_apart(a, b):
    return int(np.bitwise_count(np.frombuffer(a, np.uint8)[:16] ^ np.frombuffer(b, np.uint8)[:16]).sum())


@pytest.mark.parametrize("few, many", [(32, 2048), (1, 2048), (1, 1)])
def test_near_duplicate_candidates_are_groups_of_fingerprints_that_share_bytes(spark, monkeypatch, few, many):
    """The stage's candidates against all pairs of its SimHash fingerprints; all pairs at 0.8 are among them."""
    r = random.Random(21)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 5)):
            texts.append(" ".join(base))
            base = [f"x{r.randrange(99)}" if r.random() < 0.015 else w for w in base]
    texts = list(dict.fromkeys([*texts, "one", "one two", "One  two", ""]))
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    prints = [wideprints.wide_print(jaccard.shingles(t.encode())) for t in texts]
    near, links = [], []
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            near.append((i, j))
        a, b = (np.frombuffer(prints[x], np.uint8).reshape(8, 8) for x in (i, j))
        if ((a == b).sum(axis=1) >= 2).any() and bits_apart(prints[i], prints[j]) <= wideprints.MAX_BITS:
            links.append((i, j))
    root = list(range(len(texts)))
    for i, j in links * len(texts):
        root[i] = root[j] = min(root[i], root[j])
    want = {}
    for i, x in enumerate(root):
        want.setdefault(x, set()).add(i)
    monkeypatch.setattr(wideprints, "FEW", few)
    monkeypatch.setattr(wideprints, "MANY", many)
    places = np.arange(len(texts))
    keys = np.concatenate([wideprints.NUMBER | np.frombuffer(p, np.uint8)[wideprints.LEFT].astype(np.int32) << 8
                           | np.frombuffer(p, np.uint8)[wideprints.RIGHT] for p in prints])
    which = np.repeat(places, len(wideprints.LEFT))[np.argsort(keys, kind="stable")]
    cores = np.stack([np.frombuffer(p[:16], np.uint64) for p in prints])[which]
    pairs = which[wideprints.list_links(np.sort(keys), cores)]
    assert {tuple(sorted(p)) for p in pairs.tolist()} <= set(links)
    here = list(range(len(texts)))
    for i, j in pairs.tolist() * len(texts):
        here[i] = here[j] = min(here[i], here[j])
    assert here == root
    df = spark.createDataFrame([(str(i).encode(), t.encode()) for i, t in enumerate(texts)], "node binary, text binary")
    got = {}
    for g in wideprints.candidate_groups(df, jaccard.shingles).collect():
        got.setdefault(bytes(g.key), set()).add(int(g.node))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert len(near) > 15 and all(root[i] == root[j] for i, j in near)


def test_near_copies_are_told_by_few_links():
    """Each list of one group gave a forest of its own: about as many links as lists times texts."""
    r = np.random.default_rng(4)
    bits = r.integers(0, 2, 512) ^ (r.random((300, 512)) < 0.04)
    prints = np.packbits(bits.astype(np.uint8), axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(p) for p in prints], pa.binary())], ["print"])
    filed = pa.Table.from_batches(wideprints.file_worker([batch])).sort_by("key")
    keys = filed["key"].to_numpy()
    edges = set()
    for task in range(50):
        lists = filed.filter(pa.array(keys % 50 == task)).combine_chunks().to_batches(max_chunksize=64)
        for out in wideprints.link_worker(lists):
            edges |= {tuple(e.values()) for e in out.to_pylist()}
    root = {bytes(p[:16]): bytes(p[:16]) for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    assert len({top(x) for x in root}) == 1
    assert len(edges) < 20 * len(prints)


def test_unrelated_fingerprints_do_not_link_by_chance():
    """At 38 of 128 bits about one in 300,000 pairs does, which joined most of a few million texts into one group."""
    r = np.random.default_rng(8)
    cores = r.integers(0, 1 << 63, (6000, jaccard.WORDS), dtype=np.uint64) << 1 | r.integers(0, 2, (6000, jaccard.WORDS), dtype=np.uint64)
    keys = np.zeros(len(cores), dtype=np.int32)
    assert len(wideprints.list_links(keys, cores, jaccard.MAX_BITS)) == 0
    assert len(wideprints.list_links(keys, cores[:, :2], 38)) > 20


def family(r, n, words=120):
    """Word lists that go back to one text, some by way of others, at all kinds of distances."""
    out = [[f"w{r.randrange(3000)}" for _ in range(words)]]
    while len(out) < n:
        base = list(r.choice(out[:4]))
        for at in r.sample(range(words), r.choice([1, 2, 3, 8])):
            base[at] = f"x{r.randrange(10**9)}"
        out.append(base)
    return [" ".join(x) for x in out]


def near_classes(texts):
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("sides", [1, 2, 3])
def test_links_of_a_group_are_those_of_all_pairs(sides):
    r = random.Random(31)
    texts = [t for n in (40, 25, 1, 1) for t in family(r, n)] + ["", "one", "one two"]
    r.shuffle(texts)
    sets = [jaccard.shingles(t.encode()) for t in texts]
    side = np.array([r.randrange(sides) for _ in texts])
    edges = []
    for low, high in itertools.combinations_with_replacement(range(sides), 2):
        at = np.flatnonzero((side == low) | (side == high))
        edges += [(at[a], at[b]) for a, b in jaccard.forest([sets[i] for i in at], (side[at] > low).astype(np.int64))]
    want = near_classes(texts)
    assert 20 < len(set(want)) < 60
    assert all(want[a] == want[b] for a, b in edges)
    root = list(range(len(texts)))
    for a, b in edges * len(texts):
        root[a] = root[b] = min(root[a], root[b])
    assert root == want


def test_texts_with_many_shingles_of_their_own_are_compared_with_none(monkeypatch):
    """Each was compared with each other one before, in a single task."""
    r = random.Random(32)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{r.randrange(10**9)}" if i % 20 == k % 20 else w for i, w in enumerate(base)) for k in range(3000)]
    monkeypatch.setattr(jaccard.Packed, "shared", lambda *_: pytest.fail("compared"))
    sets = [jaccard.shingles(t.encode()) for t in texts]
    assert jaccard.forest(sets, np.zeros(len(sets), dtype=np.int64)) == []


def test_a_large_group_is_dealt_out_in_blocks(spark, monkeypatch):
    """Tasks hold two blocks at most; the links are the same."""
    r = random.Random(33)
    texts = family(r, 60) + family(r, 12)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(set(near_classes(texts)))
    assert 10 < len(want) < 50
    assert sorted(x.doc_id for x in simhash.keep_one(spark, df, "").collect()) == want
    monkeypatch.setattr(jaccard, "BLOCK", 1200)
    assert sorted(x.doc_id for x in simhash.keep_one(spark, df, "").collect()) == want
    seen = []
    monkeypatch.setattr(jaccard, "forest", lambda sets, sides: seen.append((len(sets), int(sides.sum()))) or [])
    rows = [(b"k", low, high, bytes([i]), side, b"\0" * 8) for low, high, side, n in
            ((0, 0, False, 3), (0, 1, False, 3), (0, 1, True, 2), (0, 2, False, 3), (1, 1, False, 2)) for i in range(n)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "low", "high", "node", "side", "set"), x)) for x in rows])
    assert sum(b.num_rows for b in jaccard.bucket_worker([batch.slice(0, 4), batch.slice(4)])) == 0
    assert seen == [(3, 0), (5, 2), (2, 0)]


def test_marks_tell_which_texts_need_no_shuffle(spark):
    rows = spark.range(20000).select(F.col("id"), jaccard.node_of(F.col("id").cast("string")).alias("node"))
    got = jaccard.with_marks(rows, rows.filter("id % 100 = 3").select("node")).collect()
    assert sorted(x.id for x in got) == list(range(20000))
    assert {x.id for x in got if x.marked} >= set(range(3, 20000, 100))
    assert sum(x.marked for x in got) < 210
    assert not any(x.marked for x in jaccard.with_marks(rows, rows.filter("id < 0").select("node")).collect())


def test_components_of_a_long_chain(spark):
    n = 3000
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(n, n + 1)], "a long, b long")
    got = dict(components.components(edges).collect())
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n}


@pytest.mark.parametrize("hot", [500, 1])
def test_substring_dedup(docs, texts, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_BUCKET", hot)
    first = {}
    cut = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    for i, w in cut.items():
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = substrings.substring_dedup(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.id is None:
            assert r.n_removed == 0
            continue
        w = cut[r.id]
        stay = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < r.id:
                stay[p : p + 50] = [False] * 50
        body = b" ".join(x for x, s in zip(w, stay) if s)
        assert (r.n_words, r.n_removed) == (len(w), stay.count(False))
        assert r.kept_sha256 == hashlib.sha256(body).hexdigest()
        assert r.kept is None or r.kept.encode() == body
    assert substrings.substring_dedup(empty).count() == 0


def test_packing(docs, rows, texts, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    ids[None] = [*library.encode(rows[-1][1], add_special_tokens=False).ids, 2]
    got = packing.pack(docs).collect()
    want = []
    for r in rows:
        n = len(ids[r[0]])
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[r[0]][a:b], dtype="<u4").tobytes())
            want.append((r[0], k, a, b - a, crc))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(ids[r[0]]) for r in rows)
    assert len(filled) <= -(-total // 1024) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    r = random.Random(seed)
    most = r.choice([150, 700, 1024])
    histogram = {r.randint(1, most): r.choice([1, 2, 50, 3000]) for _ in range(r.choice([1, 5, 300]))}
    plan = packing.plan_sequences(histogram, groups=r.choice([4, 64, 512]))
    assert plan.taken == histogram
    used, pieces = {}, 0
    sizes = {}
    for length, rank, sequence, offset in plan.runs:
        sizes.setdefault(length, []).append((rank, sequence, offset))
    for length, runs in sizes.items():
        runs.sort()
        for (rank, sequence, offset), after in zip(runs, [*runs[1:], (histogram[length], 0, 0)]):
            for k in range(after[0] - rank):
                used.setdefault(sequence + k, []).append((offset, length))
                pieces += 1
    assert pieces == sum(histogram.values()) and len(used) == plan.sequences
    for found in used.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", None, 0, "answer", '{"limit": 3, "query": "x"}', "extra"),
            (1, "b", "a", 2, "answer", '{"query": "é", "limit": 99}', "extra"),
            (1, "b", "a", 9, "answer", "{}", "extra"),
            (1, "c", "b", 4, "nobody", '{"z":1,"a":[1, 2]}', "extra"),
            (1, "d", "gone", 6, "answer", "not json", "extra"),
            (2, "a", "b", 0, "answer", '{"limit": true, "query": "x"}', "extra"),
            (2, "b", "a", 1, "answer", None, "extra"),
            (2, "c", "a", 2, "configure", '{"text": "t"}', "extra"),
            (3, None, None, 0, "answer", "{}", "extra"),
            (None, "a", None, 0, "answer", "{}", "extra"),
            (4, "a", None, None, "answer", '{"limit": 1, "query": ""}', "extra"),
        ],
        "conv_id long, call_id string, parent_id string, turn long, name string, arguments string, depth string",
    )
    results = spark.createDataFrame(
        [(1, "a", 1, 'say "hi"'), (1, "a", 3, "again"), (1, "b", 1, "early"), (5, "q", 1, "alone"), (None, "a", 1, "n")],
        "conv_id long, call_id string, turn long, content string",
    )
    schemas = spark.createDataFrame(toolcalls.TOOL_SCHEMAS, "name string, schema string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(calls, results, schemas).collect()}
    brief = {k: (r.depth, r.status, r.copies, r.error) for k, r in got.items()}
    assert {k: r.position for k, r in got.items() if r.position is not None} == {
        (1, "a"): 0, (1, "d"): 1, (1, "b"): 2, (1, "c"): 3, (4, "a"): 0,
    }
    assert brief == {
        (1, "a"): (0, "linked", 1, None),
        (1, "b"): (1, "result_before_call", 2, "arguments.limit is too large"),
        (1, "c"): (2, "no_result", 1, "unknown tool"),
        (1, "d"): (0, "no_result", 1, "unknown parent"),
        (2, "a"): (None, "no_result", 1, "parents run in a circle"),
        (2, "b"): (None, "no_result", 1, "parents run in a circle"),
        (2, "c"): (None, "no_result", 1, "parents run in a circle"),
        (4, "a"): (0, "no_result", 1, "arguments.query is too short"),
        (5, "q"): (None, "no_call", None, None),
    }
    assert got[1, "a"].json == (
        '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"answer","result":"say \\"hi\\""}'
    )
    assert json.loads(got[1, "c"].json)["arguments"] == {"a": [1, 2], "z": 1}
    assert got[1, "d"].json is None
    none = toolcalls.link_tool_calls(calls.limit(0), results.limit(0), schemas.limit(0))
    assert none.count() == 0


@pytest.mark.parametrize(
    "arguments, schema, want",
    [
        ('"\\ud800"', "{}", (None, "arguments hold half a surrogate pair")),
        ('{"\\udfff":1}', "{}", (None, "arguments hold half a surrogate pair")),
        ('"\\ud83d\\ude00"', "{}", ('"\U0001f600"', None)),
        ("[" * 100_000, "{}", (None, "arguments are nested too deeply")),
        ("1" * 5000, '{"type":"integer","minimum":7}', ("1" * 5000, None)),
        ("1e999", '{"maximum":5}', ("1E+999", "arguments is too large")),
        ("NaN", "{}", (None, "arguments are not JSON")),
        ("-Infinity", "{}", (None, "arguments are not JSON")),
        ("true", '{"enum":[1]}', ("true", "arguments is none of the allowed values")),
        ("[1.0]", '{"enum":[[1]]}', ("[1.0]", None)),
        ("[true]", '{"enum":[[1],{"a":1}]}', ("[true]", "arguments is none of the allowed values")),
        ("null", '{"type":"null"}', ("null", None)),
        ("null", '{"type":["string","null"]}', ("null", None)),
        ("3", '{"type":["string","null"]}', ("3", "arguments is not of type string or null")),
        ("3.0", '{"type":"integer"}', ("3.0", None)),
        ("3.5", '{"type":"integer"}', ("3.5", "arguments is not of type integer")),
        ("3", '{"type":"whole"}', ("3", "schema has an unknown type")),
        ("3", '{"type":[3]}', ("3", "schema has an unknown type")),
        ("3", '{"type":7}', ("3", "schema has a wrong type")),
        ("3", "no JSON", ("3", "schema is not JSON")),
        ("3", "true", ("3", None)),
        ("3", "false", ("3", "arguments is not allowed")),
        ("3", "[]", ("3", "schema is neither an object nor a truth value")),
        ("3", '{"minimum":"2"}', ("3", "schema has a wrong minimum")),
        ("3", '{"minimum":true}', ("3", "schema has a wrong minimum")),
        ('"ab"', '{"minLength":2.5}', ('"ab"', "arguments is too short")),
        ("{}", '{"required":"ab"}', ("{}", "schema has a wrong required")),
        ("{}", '{"required":[1]}', ("{}", "schema has a wrong required")),
        ('{"a":1}', '{"properties":{"a":3}}', ('{"a":1}', "schema is neither an object nor a truth value")),
        ('{"b":"x"}', '{"additionalProperties":{"type":"number"}}', ('{"b":"x"}', "arguments.b is not of type number")),
        ('{"b":1,"a":2,"b":3}', "{}", ('{"a":2,"b":3}', None)),
        ('"\\u0001\\u007f é"', "{}", ('"\\u0001\x7f é"', None)),
        (None, "{}", (None, "arguments are not JSON")),
        ("{}", None, ("{}", "unknown tool")),
    ],
)
def test_every_argument_and_schema_has_a_defined_result(arguments, schema, want):
    assert toolcalls.checked(arguments, schema) == want


def plain_links(calls, results, schemas):
    """Rows of link_tool_calls from lists of dictionaries with unique identifiers."""
    asked = {(c["conv_id"], c["call_id"]): c for c in calls}
    told = {(r["conv_id"], r["call_id"]): r for r in results}
    depth = {}
    for k, c in asked.items():
        seen, at = [k], c
        while (up := (at["conv_id"], at["parent_id"])) in asked and up not in seen:
            seen.append(up)
            at = asked[up]
        depth[k] = None if up in seen else len(seen) - 1
    order = sorted((k for k in asked if depth[k] is not None), key=lambda k: (depth[k], asked[k]["turn"], k[1]))
    place = {k: [o for o in order if o[0] == k[0]].index(k) for k in order}
    out = []
    for k in asked.keys() | told.keys():
        c, r = asked.get(k), told.get(k)
        status = "no_call" if not c else "no_result" if not r else "result_before_call" if r["turn"] < c["turn"] else "linked"
        text, error = toolcalls.checked(c["arguments"], schemas.get(c["name"])) if c else (None, None)
        if c and depth[k] is None:
            error = "parents run in a circle"
        elif c and c["parent_id"] is not None and (k[0], c["parent_id"]) not in asked:
            error = "unknown parent"
        told_json = None
        if text is not None:
            whole = {"arguments": json.loads(text), "id": k[1], "name": c["name"], "result": r and r["content"]}
            told_json = json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out.append((*k, c and c["name"], depth.get(k), place.get(k), status, error, told_json))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tool_calls(spark, seed):
    r = random.Random(seed)
    names = ["answer", "configure", "odd", "nobody"]
    schemas = dict(toolcalls.TOOL_SCHEMAS) | {"odd": r.choice(['{"type":["null"]}', "not JSON", "true"])}
    values = ["{}", '{"query":"q","limit":2}', '{"text":"\\t\\u0001 é"}', '"\\ud800"', "nope", "null", '{"b":[1,{"z":0,"a":1}]}']
    calls, results = [], []
    for conv in range(8):
        ids = [f"c{i}" for i in range(r.randint(1, 12))]
        for t, i in enumerate(ids):
            up = r.choice([None, *ids, "gone"] if r.random() < 0.3 else [None, *ids[:t]])
            calls.append({"conv_id": conv, "call_id": i, "parent_id": up, "turn": t, "name": r.choice(names), "arguments": r.choice(values)})
        for i in [*ids, "alone"]:
            if r.random() < 0.7:
                results.append({"conv_id": conv, "call_id": i, "turn": r.randint(0, 12), "content": r.choice(["ok", 'a "b"\n\x02', "", None])})
    made = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, turn long, name string, arguments string")
    told = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    known = spark.createDataFrame(list(schemas.items()), "name string, schema string")
    fields = ("conv_id", "call_id", "name", "depth", "position", "status", "error", "json")
    got = [tuple(row[f] for f in fields) for row in toolcalls.link_tool_calls(made, told, known).collect()]
    assert sorted(got, key=str) == plain_links(calls, results, schemas)


def test_depths_of_a_long_chain(spark):
    n = 500
    calls = spark.createDataFrame(
        [(1, str(i), str(i - 1) if i else None) for i in range(n)], "conv_id long, call_id string, parent_id string"
    )
    got = {int(r.call_id): r.depth for r in toolcalls.depths(calls).collect()}
    assert got == {i: i for i in range(n)}


def test_tool_calls_show_repeated_results_and_rows_without_identifier(spark, tmp_path):
    calls = spark.createDataFrame(
        [(1, "a", None, 0, "answer", "{}"), (3, None, None, 0, "answer", "{}"), (None, "a", None, 0, None, None)],
        "conv_id long, call_id string, parent_id string, turn long, name string, arguments string",
    )
    results = spark.createDataFrame(
        [(1, "a", 1, "x"), (1, "a", 3, "y"), (5, "q", 1, "z"), (None, "a", 1, "n")],
        "conv_id long, call_id string, turn long, content string",
    )
    schemas = spark.createDataFrame(toolcalls.TOOL_SCHEMAS, "name string, schema string")
    got = {(r.conv_id, r.call_id): (r.copies, r.result_copies) for r in toolcalls.link_tool_calls(calls, results, schemas).collect()}
    assert got == {(1, "a"): (1, 2), (5, "q"): (None, 1)}
    lost = [(r.conv_id, r.call_id, r.name, r.status, r.json) for r in toolcalls.without_identifier(calls, results).collect()]
    assert sorted(lost, key=str) == sorted(
        [
            (3, None, "answer", "no_identifier", '{"arguments":"{}","name":"answer"}'),
            (None, "a", None, "no_identifier", '{"arguments":null,"name":null}'),
            (None, "a", None, "no_identifier", '{"result":"n"}'),
        ],
        key=str,
    )
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (None, 0, "user", "lost"), (None, 1, "assistant", "gone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    status = sorted(r.status for r in toolcalls.op4_tool_calls(spark, str(tmp_path)).collect())
    assert status == ["linked", "no_identifier", "no_identifier"]
