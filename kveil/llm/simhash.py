"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most ``d`` of their 8 bytes,
so they share at least ``8 - d`` positional bytes. A posting list per (position, byte) would hold
1/256 of everything, so lists are intersected: sharing 5 of 8 positions means sharing 3 of the first
or 3 of the last four, and 8 lists of three positions meet every pair. Within a list the shared
positional bytes of each pair are tallied, pairs reaching the guaranteed minimum are kept, and
their bits are compared.

A list longer than ``HOT_LIST`` is filed again by every choice of the remaining positions that brings
the shared ones to the minimum. Lists of five positions hold at most 2**24 fingerprints by
construction; there the partners of a fingerprint are looked up by flipping its other bits, so the
work is linear. Only a spanning forest of the links of each list leaves a task, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow, table
from kveil.llm.components import components
from kveil.llm.jaccard import near_copies, node_of, with_marks
from kveil.session import cut_lineage

BYTES = 8
SHINGLE = 3
MAX_BITS = 3
HOT_LIST = 2048
WORDS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the shingles of a text's words, A-Z lower-cased; no words: zero.

    A bit is 1 if it is set in over half of the hashes. Long texts are taken in stretches of words.
    """
    words = (text or b"").lower().split()  # of bytes: lower-cases A-Z only and splits at the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, WORDS_AT_ONCE):
        end = min(n, at + WORDS_AT_ONCE)
        if n == 1:
            parts = [b" ".join(words)] if len(words) <= shingle else [b" ".join(words[:shingle])]
        else:
            columns = [words[at + k : end + k] for k in range(shingle)]
            parts = map(b" ".join, zip(*columns))
        hashes = np.fromiter((digest(p, seed) for p in parts), dtype="<u8", count=end - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"]
        )


def with_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, fingerprints, f"id {kind}, print long")


def filed(prints: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """A row per fingerprint and choice of byte positions: the number of the choice, and those bytes."""

    def masked(positions: tuple[int, ...]) -> Column:
        mask = sum(0xFF << (8 * p) for p in positions)
        return F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))

    lists = [F.struct(F.lit(i).alias("list"), masked(c).alias("key")) for i, c in enumerate(choices)]
    return prints.select("print", F.explode(F.array(*lists)).alias("f")).select("f.list", "f.key", "print")


def flips(positions: tuple[int, ...], bits: int = MAX_BITS) -> np.ndarray:
    """All numbers with up to ``bits`` bits set outside the given byte positions, without zero."""
    free = [1 << (8 * p + k) for p in range(BYTES) if p not in positions for k in range(8)]
    return np.array(
        [sum(c) for r in range(1, bits + 1) for c in itertools.combinations(free, r)], dtype=np.uint64
    )


def forest_by_tally(prints: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints of one list.

    For each fingerprint reached, the positional bytes it shares with all unreached ones are
    tallied; of those with at least ``8 - bits`` the bits are compared.
    """
    edges: list[tuple[int, int]] = []
    as_bytes = prints.view(np.uint8).reshape(-1, BYTES)
    rest = np.arange(len(prints))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            shared = (as_bytes[rest] == as_bytes[at]).sum(axis=1)
            near = np.flatnonzero(shared >= BYTES - bits)
            near = near[np.bitwise_count(prints[rest[near]] ^ prints[at]) <= bits]
            if len(near):
                found = rest[near]
                edges.extend((int(prints[at]), int(p)) for p in prints[found])
                queue.extend(found.tolist())
                rest = np.delete(rest, near)
    return edges


def forest_by_flips(prints: np.ndarray, changes: np.ndarray) -> list[tuple[int, int]]:
    """The same for a long list of sorted fingerprints that share all bytes but those the changes touch."""
    edges: list[tuple[int, int]] = []
    free = np.ones(len(prints), dtype=bool)
    for first in range(len(prints)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            at = queue.pop()
            wanted = prints[at] ^ changes
            places = np.searchsorted(prints, wanted)
            places = np.unique(places[(places < len(prints)) & (prints[np.minimum(places, len(prints) - 1)] == wanted)])
            found = places[free[places]]
            free[found] = False
            edges.extend((int(prints[at]), int(p)) for p in prints[found])
            queue.extend(found.tolist())
    return edges


def list_worker(choices: list[tuple[int, ...]]):
    """Reads lists sorted by number, key and fingerprint as they stream by; yields their links."""

    def links(number: int, prints: np.ndarray) -> list[tuple[int, int]]:
        changes = flips(choices[number]) if len(choices[number]) >= BYTES - MAX_BITS else None
        if changes is not None and len(prints) > len(changes):
            return forest_by_flips(prints, changes)
        return forest_by_tally(prints)

    def as_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, key = (batch.column(c).to_numpy() for c in ("list", "key"))
            prints = batch.column("print").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(prints)]
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                here = (int(number[s]), int(key[s]))
                if here != last:
                    if sum(map(len, held)) > 1:
                        edges += links(last[0], np.sort(np.concatenate(held)))
                    held, last = [], here
                held.append(prints[s:e])
                if len(edges) > 1 << 16:
                    yield as_batch(edges)
                    edges = []
            held = [h.copy() for h in held]
            if edges:
                yield as_batch(edges)
        if last is not None and sum(map(len, held)) > 1:
            yield as_batch(links(last[0], np.sort(np.concatenate(held))))

    return work


def links_in(lists: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lists.repartition(tasks, "list", "key").sortWithinPartitions("list", "key", "print")
    return map_arrow(rows, list_worker(choices), "a long, b long")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``print`` as all pairs within MAX_BITS bits would."""
    need = BYTES - MAX_BITS
    half = BYTES // 2
    few = [c for block in (range(half), range(half, BYTES)) for c in itertools.combinations(block, -(-need // 2))]
    lists = cut_lineage(filed(prints, few))
    sizes = lists.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = lists.join(sizes, ["list", "key"])
    hot = cut_lineage(sized.filter(f"n > {HOT_LIST}").select("print").distinct())
    out = links_in(sized.filter(f"n <= {HOT_LIST}").select("list", "key", "print"), few)
    if not hot.isEmpty():
        more = list(itertools.combinations(range(BYTES), need))
        out = out.union(links_in(filed(hot, more), more))
    return out


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: component_id is the least id reachable over links.

    Fingerprints link at MAX_BITS or fewer differing bits; texts of one fingerprint are one node, so
    copies of any number cost one row. Texts without words have fingerprint zero and link like any
    other. Null texts have no words. A null id is never a component_id unless all ids of the
    component are null. Repeated rows get the same answer each; an empty table gives an empty one.
    No other column is read.
    """
    rows = cut_lineage(with_fingerprints(df, id_col, text_col))
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("id").alias("least")))
    found = components(near_links(nodes.select("print")))
    classes = nodes.join(found, nodes["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = classes.join(least, "root").select("print", "component_id")
    return rows.join(of_print, "print").select(
        "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates, the document with the least id.

    Near-duplicates have a Jaccard similarity of 0.8 or more on five-word shingles. Candidates come from SimHash
    fingerprints of these shingles by lists of byte positions, see ``wideprints``, and are verified exactly, see
    ``jaccard``. One fingerprint and three bits, the contract of op6, find few of those: at 0.8 about 10 of the
    64 bits are expected to differ, so several fingerprints with a wider budget are taken.
    Equal texts are near-duplicates, whether or not another text is near them.
    Documents without an id stay; those without words are near-duplicates of each other. A document is
    known by its id and text, so others with its id and another text stay or go by themselves; of two
    near-duplicates with one id, one stays.
    """
    drop = near_copies(docs).filter("id IS NOT NULL AND NOT kept").select("id", "node").distinct()
    drop = cut_lineage(drop)
    row = F.struct(*map(col, docs.columns)).alias("row")
    told = with_marks(docs.select(row, col("doc_id").alias("id"), node_of(col("text")).alias("node")), drop)
    some = told.filter("marked").join(drop, ["id", "node"], "left_anti")
    # the others stay where they are, so their texts are not shuffled
    return told.filter("NOT marked").select("row.*").union(some.select("row.*"))


def op6_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
