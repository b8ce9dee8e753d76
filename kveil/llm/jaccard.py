"""Near copies by exact Jaccard similarity of five-word shingles, inside groups found through SimHash.

Candidates come from SimHash fingerprints over the same shingles, filed under byte positions, see ``wideprints``.
Texts that are linked there, directly or over others, meet in one group, and only those ship their text and their
shingles: a bitmap of their hashes, of one size however many they are, keeps most others from the shuffle.
Within a group every link is verified by the exact similarity, and all links that matter are looked
for: from each text reached, all unreached ones are compared. Only a spanning forest leaves a task.

A group with over ``BLOCK`` shingles is dealt out in blocks of about that many; each two blocks are compared in a task
of their own, so no task holds more than two. Texts with over a fifth of shingles that no other text has are left out
of the comparison, since none can be their near copy. The others cost one pass over the shingles of the unreached texts each,
so a group of near copies costs one pass, and one of texts that are not near the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow
from kveil.llm.components import components
from kveil.llm.wideprints import candidate_groups
from kveil.session import cut_lineage

SHINGLE = 5
# Least similarity as a fraction, so that the comparison is one of integers.
LEAST = (4, 5)
BATCH_BYTES = 16 << 20
# What candidates are judged by: words of the fingerprints, and how many of their bits may differ.
WORDS, MAX_BITS = 3, 57
# Shingles of a group that are compared in one task, and twice as many when it has more.
BLOCK = 1 << 21
MARK_BYTES = 3


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words, A-Z lower-cased.

    Fewer words are one run; a text without words has one, empty run.
    """
    words = (text or b"").lower().split()
    parts = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), dtype=np.uint64))


def shingle_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def as_batch(batch: pa.RecordBatch, sets: list[bytes]) -> pa.RecordBatch:
        columns = [batch.column(c) for c in ("key", "node", "blocks")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], ["key", "node", "blocks", "set"])

    for batch in batches:
        sets, size, start = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            sets.append(shingles(text.as_py()).tobytes())
            size += len(sets[-1])
            if size > BATCH_BYTES:
                yield as_batch(batch.slice(start, len(sets)), sets)
                sets, size, start = [], 0, k + 1
        yield as_batch(batch.slice(start), sets)


class Packed:
    """Shingles of some texts in one array."""

    def __init__(self, texts: np.ndarray, first: np.ndarray, shingles: np.ndarray) -> None:
        """``first`` and ``shingles`` are of all texts: those of text ``i`` are ``shingles[first[i] : first[i + 1]]``."""
        self.texts = texts
        counts = first[texts + 1] - first[texts]
        self.starts = np.cumsum(counts) - counts
        self.shingles = shingles[np.repeat(first[texts] - self.starts, counts) + np.arange(counts.sum())]

    def shared(self, marks: np.ndarray) -> np.ndarray:
        """How many shingles of each text are marked with one."""
        return np.add.reduceat(marks[self.shingles], self.starts, dtype=np.int64)


def forest(sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links, as pairs of places, that connect the texts as all their pairs at LEAST or more would.

    Texts of two sides are only compared with those of the other side, texts of one side with each other.
    """
    up, down = LEAST
    sizes = np.array([len(s) for s in sets])
    shingles = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sets)), sizes)
    kinds = int(shingles.max()) + 1
    both_sides = sides.min() != sides.max()
    while len(shingles):  # until few shingles are left that no text to compare with has
        if both_sides:
            side = sides[owner]
            there = np.zeros((2, kinds), dtype=bool)
            there[side, shingles] = True
            useful = there[1 - side, shingles]
        else:
            useful = np.bincount(shingles, minlength=kinds)[shingles] > 1
        hopeful = np.bincount(owner[useful], minlength=len(sets)) * down >= sizes * up
        useful &= hopeful[owner]
        before, shingles, owner = len(shingles), shingles[useful], owner[useful]
        if len(shingles) * 100 > before * 99:
            break
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    free = first[1:] > first[:-1]
    places = np.flatnonzero(free)
    # what a text of each side is compared with
    against = [places[sides[places] != s] if both_sides else places for s in (0, 1)]
    packs = [Packed(p, first, shingles) for p in (against if both_sides else against[:1])]
    marks = np.zeros(kinds, dtype=np.uint8)
    edges: list[tuple[int, int]] = []
    for seed in places.tolist():
        if not free[seed]:
            continue
        free[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            which = int(sides[at]) if both_sides else 0
            others = packs[which].texts
            if not len(others):
                continue
            own = shingles[first[at] : first[at + 1]]
            marks[own] = 1
            shared = packs[which].shared(marks)
            marks[own] = 0
            alike = free[others] & (shared * down >= (sizes[others] + sizes[at] - shared) * up)
            found = others[alike].tolist()
            free[found] = False
            edges += [(at, f) for f in found]
            queue += found
            unreached = free[others]
            if 2 * np.count_nonzero(unreached) <= len(others):
                packs[which] = Packed(others[unreached], first, shingles)
    return edges


def bucket_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads groups, or two blocks of one, sorted by ``key, low, high`` as they stream by; yields their links."""

    def links(two_blocks: bool, texts: list[tuple[bytes, bool, bytes]]) -> pa.RecordBatch:
        nodes = [t[0] for t in texts]
        sets = [np.frombuffer(t[2], dtype=np.uint64) for t in texts]
        sides = np.array([t[1] for t in texts], dtype=np.int64)
        alone = len(texts) < 2 or (two_blocks and sides.min() == sides.max())
        edges = [] if alone else forest(sets, sides)
        return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

    last, texts = [None, 0, 0], []
    for batch in batches:
        for *key, node, side, data in zip(*(batch.column(c) for c in ("key", "low", "high", "node", "side", "set"))):
            key = [k.as_py() for k in key]
            if key != last:
                yield links(last[1] != last[2], texts)
                last, texts = key, []
            texts.append((node.as_py(), side.as_py(), data.as_py()))
    yield links(last[1] != last[2], texts)


def node_of(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def with_marks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` and whether their ``node`` may be among ``nodes``, as ``marked``; one that is among them is always marked.

    A bitmap has a bit for each possible value of a node's first MARK_BYTES bytes, 2 MB in all, so it can travel to every
    task whatever the number of nodes. The more nodes there are, the more rows are marked that need not be.
    """

    def place(node: Column) -> Column:
        return F.conv(F.hex(F.substring(node, 1, MARK_BYTES)), 16, 10).cast("long")

    at = place(F.col("node"))
    maps = nodes.groupBy(F.bitmap_bucket_number(at).alias("__part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")
    )
    told = rows.withColumn("__bit", F.bitmap_bit_position(at)).withColumn("__part", F.bitmap_bucket_number(at))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)).cast("long") % 2 == 1
    return (
        told.join(F.broadcast(maps), "__part", "left")
        .withColumn("marked", F.coalesce(marked, F.lit(False)))
        .select(*rows.columns, "marked")
    )


def near_links(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) between texts, by ``node_of``, that connect them as all pairs of near copies would."""
    rows = df.select(node_of(col(text_col)).alias("node"), col(text_col).cast("binary").alias("text"))
    members = candidate_groups(rows, shingles, WORDS, MAX_BITS)
    large = members.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    # at most one row for each BLOCK shingles of the input
    members = members.join(F.broadcast(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    some = with_marks(rows, members).filter("marked").groupBy("node").agg(F.first("text").alias("text"))
    full = members.join(some, "node").select("key", "node", "blocks", "text")
    sets = map_arrow(full, shingle_worker, "key binary, node binary, blocks int, set binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.select("*", block.alias("block")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node",
        (F.col("block") > F.col("other")).alias("side"), "set",
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return cut_lineage(map_arrow(dealt, bucket_worker, "a binary, b binary"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component_id, kept) of the rows whose text is equal to another row's or a near copy of another text.

    Texts link at a Jaccard similarity of LEAST or more; component_id is the least id reachable over
    links, null if the component has no id. Equal texts are one node. Of each component the row with
    the least id is kept, of different texts with that id the one with the least node. Rows told
    twice with text and id get the same answer. Null texts have no words. Texts without words have
    one, empty shingle and so are near copies of each other.
    """
    found = components(near_links(df, text_col)).select("node", "root")
    rows = cut_lineage(df.select(col(id_col).alias("id"), node_of(col(text_col)).alias("node")))
    # a text that links to no other is a component of its own, with as many rows as it has copies
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(found, "node", "left_anti")
    roots = found.union(cut_lineage(copies.select("node", F.col("node").alias("root"))))
    linked = cut_lineage(rows.join(roots, "node"))
    row = F.struct("id", "node")
    least = linked.groupBy("root").agg(F.min(F.when(F.col("id").isNotNull(), row)).alias("first"))
    kept = F.coalesce(row == F.col("first"), F.lit(True))
    return linked.join(least, "root").select("id", "node", F.col("first.id").alias("component_id"), kept.alias("kept"))
