"""Groups of texts that may be near copies, by SimHash fingerprints filed under their byte positions.

Each distinct text gets ``PRINTS`` fingerprints of 64 bits over its distinct five-word shingles, one per mixing
of the shingles' hashes. At a Jaccard similarity of 0.8 two fingerprints differ in 15 % of their bits, about 10
of 64, and share each of their bytes with probability 0.27. The count filter asks for ``NEED`` shared positional
bytes of one fingerprint: a posting list holds the fingerprints alike in one choice of two positions, so
every pair that passes meets in a list. One fingerprint of eight shares two bytes with probability 0.68 at 0.8, so
all eight miss 1 pair in 8,000 there, fewer above. The first ``WORDS`` fingerprints travel along, and pairs of a list link
if at most ``MAX_BITS`` of these bits differ (of 128: 19 expected at 0.8, 64 for unrelated texts). Texts linked
directly or over others are one group, inside which pairs are verified elsewhere.

Unrelated texts also link by chance, and such links grow with the square of the number of texts: with 38 of 128 bits there
were 276 among 38,796 texts and 5,692 among 193,226. Among millions they would join most texts into one group. Callers with
many texts take more words: 57 of 192 bits is the same share, and chance links are a hundred times fewer.

A list of copies costs one pass, since only a spanning forest of its links is looked for; lists of unrelated
texts hold 1/65536 of all. A task joins the links of all its lists and tells of each group by a star around its least core.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.llm.common import map_arrow
from kveil.llm.components import components
from kveil.session import cut_lineage

PRINTS = 8
BYTES = 8
NEED = 2
WORDS = 2
MAX_BITS = 38
CHUNK = 4096
# lists up to FEW are compared by shifts, up to MANY by all pairs first
FEW = 32
MANY = 2048
# links of one task that are held to be made stars
HELD_LINKS = 1 << 17
PLACES = list(itertools.combinations(range(BYTES), NEED))
LEFT = np.array([p * BYTES + i for p in range(PRINTS) for i, _ in PLACES])
RIGHT = np.array([p * BYTES + j for p in range(PRINTS) for _, j in PLACES])
NUMBER = np.arange(len(LEFT), dtype=np.int32) << 16


def wide_print(hashes: np.ndarray) -> bytes:
    """``PRINTS`` SimHash fingerprints of distinct 64-bit hashes; a bit is 1 if set in over half of them."""
    ones = np.zeros(PRINTS * 64, dtype=np.int64)
    step = np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), CHUNK):
        x = hashes[at : at + CHUNK, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def print_worker(shingles: Callable[[bytes | None], np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py())
                prints.append(wide_print(hashes))
                sizes.append(len(hashes))
            columns = [batch.column("node"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "print", "size"])

    return work


def core_names(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def file_worker(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    """A row per fingerprint and choice of positions: the choice's number above its two bytes, and the core."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK // 16):
            told = b"".join(whole.column("print").slice(at, CHUNK // 16).to_pylist())
            prints = np.frombuffer(told, dtype=np.uint8).reshape(-1, PRINTS * BYTES)
            keys = NUMBER | prints[:, LEFT].astype(np.int32) << 8 | prints[:, RIGHT]
            core = np.ascontiguousarray(prints[:, : 8 * words]).view(np.int64)
            columns = [keys.ravel(), *(np.repeat(core[:, k], len(LEFT)) for k in range(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", *core_names(words)])


def apart(cores: np.ndarray, other: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(cores[..., 0] ^ other[..., 0]).astype(np.uint16)
    for k in range(1, cores.shape[-1]):
        bits += np.bitwise_count(cores[..., k] ^ other[..., k])
    return bits


def forest(cores: np.ndarray, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """Links, as pairs of places, that connect the cores of one list as all its links would."""
    rest = np.arange(len(cores))
    if len(cores) <= MANY:
        linked = np.zeros(len(cores), dtype=bool)
        for i in range(0, len(cores), 64):
            linked[i : i + 64] = (apart(cores[i : i + 64, None], cores[None]) <= max_bits).sum(axis=1) > 1
        rest = rest[linked]
    edges = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = apart(cores[rest], cores[at]) <= max_bits
            found, rest = rest[near], rest[~near]
            edges.append(np.stack([np.full(len(found), at), found], axis=1))
            queue.extend(found.tolist())
    return edges


def list_links(keys: np.ndarray, cores: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Links of whole lists sorted by key, as pairs of places."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    edges = [e + s for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]) for e in forest(cores[s : s + n], max_bits)]
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
    k, c = keys[few], cores[few]
    for shift in range(1, int(sizes[sizes <= FEW].max(initial=1))):
        at = np.flatnonzero(k[shift:] == k[:-shift])
        at = at[apart(c[at], c[at + shift]) <= max_bits]
        edges.append(np.stack([few[at], few[at + shift]], axis=1))
    return np.concatenate(edges) if edges else np.empty((0, 2), dtype=np.int64)


def stars(ends: np.ndarray) -> np.ndarray:
    """Links, as rows of two cores, that join each core of the given links with the least one it reaches."""
    cores, places = np.unique(ends.reshape(-1, ends.shape[1] // 2), axis=0, return_inverse=True)
    a, b = places.reshape(-1, 2).T
    root = np.arange(len(cores))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(cores)))
    return np.concatenate([cores[root[leaf]], cores[leaf]], axis=1)


def link_worker(
    batches: Iterator[pa.RecordBatch], words: int = WORDS, max_bits: int = MAX_BITS
) -> Iterator[pa.RecordBatch]:
    """Reads lists sorted by key as they stream by; yields links that connect the cores as those in the lists.

    The many lists that hold the same group tell of it by the same few links, those to its least core.
    """
    found, many = np.empty((0, 2 * words), dtype=np.uint64), 0  # links held, and how many of them are stars already

    def linked(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        keys, cores = (np.concatenate(x) for x in zip(*held))
        return cores[list_links(keys, cores, max_bits)].reshape(-1, 2 * words)

    def as_batch(ends: np.ndarray) -> pa.RecordBatch:
        told = np.ascontiguousarray(ends).view(np.uint8)
        sides = [pa.array([bytes(e) for e in told[:, s : s + 8 * words]], pa.binary()) for s in (0, 8 * words)]
        return pa.RecordBatch.from_arrays(sides, ["a", "b"])

    def lists() -> Iterator[np.ndarray]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy().copy()
            cores = np.stack([batch.column(c).to_numpy() for c in core_names(words)], axis=1).view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            if last or (held and held[-1][0][-1] != keys[0]):
                yield linked([*held, (keys[:last], cores[:last])])
                held = []
            held.append((keys[last:], cores[last:]))
        if held:
            yield linked(held)

    for ends in lists():
        found = np.concatenate([found, ends])
        if len(found) > many + HELD_LINKS:
            found = stars(found)
            many = len(found)
            if many > HELD_LINKS:
                yield as_batch(found)
                found, many = found[:0], 0
    yield as_batch(stars(found))


def candidate_groups(
    texts: DataFrame, shingles: Callable[[bytes | None], np.ndarray], words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(key, node, size) of the texts ``(node, text)`` that may be near copies of another.

    ``key`` is their group, ``size`` their number of shingles.
    """
    told = map_arrow(texts, print_worker(shingles), "node binary, print binary, size long")
    prints = cut_lineage(told.distinct())
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(["key int", *(f"{c} long" for c in core_names(words))])
    filed = map_arrow(prints.select("print"), partial(file_worker, words=words), schema)
    lists = filed.repartition(tasks, "key").sortWithinPartitions("key")
    links = map_arrow(lists, partial(link_worker, words=words, max_bits=max_bits), "a binary, b binary")
    found = components(cut_lineage(links))
    cores = prints.select("node", "size", F.substring("print", 1, 8 * words).alias("core"))
    grouped = cores.join(found, cores["core"] == found["node"], "left").select(
        F.coalesce(found["root"], "core").alias("key"), cores["node"], "size"
    )
    grouped = cut_lineage(grouped)
    # a table of its own, so that Spark can split the rows of a large group in the join
    sizes = cut_lineage(grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    return cut_lineage(grouped.join(sizes, "key"))
