"""Best-fit packing of token sequences by linear grouping.

Documents become token pieces of at most ``capacity``. What is packed is the histogram of their
lengths, at most ``capacity`` numbers whatever the corpus size, so planning fits in the driver:

1. lengths above ``small`` are sorted, cut into ``groups`` groups of equal cardinality and rounded up
   to the largest of their group;
2. for the few sizes that remain, configurations of one sequence are sought that leave as little
   room as they can, and each is used as often as the numbers allow;
3. actual pieces take the places of rounded ones, which leaves their true room;
4. small pieces go, longest first, where they fit best.

The plan is a list of runs: pieces of one length, by their rank among that length, to consecutive
sequences at one offset. Ranks are found in Spark, and each piece then looks up its run.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow, table
from kveil.llm.tokens import ByteTokens
from kveil.session import cut_lineage

CAPACITY = 1024
END_ID = 2
GROUPS = 512
SMALL = 200
RANK_ROWS = 50_000  # pieces that are numbered together


@dataclass
class Plan:
    """Runs of pieces, and the number of sequences used so far."""

    capacity: int
    sequences: int = 0
    taken: dict[int, int] = field(default_factory=dict)
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first rank, sequence, offset

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.runs.append((length, rank, sequence, offset))
        self.taken[length] = rank + n

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Lengths with counts, longest first, cut into groups of equal cardinality: members by rounded length."""
    each = max(1, -(-sum(n for _, n in lengths) // groups))
    out: dict[int, list[tuple[int, int]]] = {}
    room, rounded = 0, 0
    for length, n in lengths:
        while n:
            if not room:
                room, rounded = each, length
            take = min(n, room)
            out.setdefault(rounded, []).append((length, take))
            room, n = room - take, n - take
    return out


def fullest(sizes: list[int], counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The configuration with one piece of ``first`` that leaves least room, of long pieces if it can.

    Reachable sums are bits of one number per size; walking back through them gives the pieces.
    """
    room = capacity - first
    everything = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size in reversed(sizes):  # short ones first, so that walking back meets long ones first
        if size > room:
            break
        before, most = reach, min(counts[size] - (size == first), room // size)
        for _ in range(most):
            wider = (reach | (reach << size)) & everything
            if wider == reach:
                break
            reach = wider
        layers.append((size, before, most))
    at, used = reach.bit_length() - 1, {first: 1}
    for size, before, most in reversed(layers):
        while most and at >= size and not (at == 0):
            # stay in this layer while the rest is still reachable with it
            if not within(before, at - size, size, most - 1):
                break
            used[size] = used.get(size, 0) + 1
            at, most = at - size, most - 1
    return used


def within(reach: int, at: int, size: int, most: int) -> bool:
    """Whether ``at`` is a sum in ``reach`` plus up to ``most`` pieces of ``size``."""
    return any(at - k * size >= 0 and reach >> (at - k * size) & 1 for k in range(most + 1))


def configurations(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Configurations with how often each is used, until no piece is left."""
    counts = dict(counts)
    sizes = sorted(counts, reverse=True)
    while sizes:
        used = fullest(sizes, counts, sizes[0], capacity)
        times = min(counts[s] // k for s, k in used.items())
        for s, k in used.items():
            counts[s] -= k * times
        sizes = [s for s in sizes if counts[s]]
        yield used, times


def fill_best(plan: Plan, room: dict[int, list[tuple[int, int]]], smalls: list[tuple[int, int]]) -> None:
    """Small pieces, longest first, each into the open sequence with the least sufficient room."""
    rooms = sorted(room)
    for size, n in smalls:
        while n:
            at = next((i for i, r in enumerate(rooms) if r >= size), None)
            if at is None:
                per = plan.capacity // size
                bins = -(-n // per)
                room.setdefault(plan.capacity, []).append((plan.open(bins), bins))
                rooms = sorted(room)
                continue
            free = rooms[at]
            first, bins = room[free].pop()
            if not room[free]:
                del room[free], rooms[at]
            per = free // size
            whole = min(bins, n // per)
            parts = [(first, whole, per)] if whole else []
            n -= whole * per
            left = bins - whole
            if left and 0 < n < per:
                parts.append((first + whole, 1, n))
                left, n = left - 1, 0
            if left:
                give_back(room, rooms, free, (first + bins - left, left))
            for start, many, pieces in parts:
                for k in range(pieces):
                    plan.place(size, many, start, plan.capacity - free + k * size)
                give_back(room, rooms, free - pieces * size, (start, many))


def give_back(room: dict, rooms: list[int], free: int, segment: tuple[int, int]) -> None:
    if free:
        if free not in room:
            insort(rooms, free)
        room.setdefault(free, []).append(segment)


def plan_sequences(
    histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL
) -> Plan:
    """Runs that put all pieces of a histogram of lengths into sequences."""
    plan = Plan(capacity)
    histogram = {length: n for length, n in histogram.items() if n}
    if n := histogram.pop(capacity, 0):
        plan.place(capacity, n, plan.open(n), 0)
    ordered = sorted(histogram.items(), reverse=True)
    members = equal_groups([x for x in ordered if x[0] > small], groups)
    queues = {rounded: list(reversed(runs)) for rounded, runs in members.items()}
    counts = {rounded: sum(n for _, n in runs) for rounded, runs in members.items()}
    room: dict[int, list[tuple[int, int]]] = {}
    for used, times in configurations(counts, capacity):
        segments = [(plan.open(times), times, 0)]
        for rounded in (s for s, k in used.items() for _ in range(k)):
            queue, after = queues[rounded], []
            for first, n, filled in segments:
                while n:
                    length, many = queue.pop()
                    take = min(n, many)
                    if take < many:
                        queue.append((length, many - take))
                    plan.place(length, take, first, filled)
                    after.append((first, take, filled + length))
                    first, n = first + take, n - take
            segments = after
        for first, n, filled in segments:
            if filled < capacity:
                room.setdefault(capacity - filled, []).append((first, n))
    fill_best(plan, room, [x for x in ordered if x[0] <= small])
    return plan


def piece_worker(vocabulary: str, capacity: int, end_id: int):
    """Token pieces of texts: only texts of more than ``capacity`` tokens are cut, the first piece may be short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(vocabulary)
        for batch in batches:
            rows: list[int] = []
            cells: list[tuple[int, int, int, int]] = []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(tokens.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                if cuts[-1] != len(ids):
                    cuts.append(len(ids))
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    cells.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            piece, start, length, crc = np.array(cells, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int32())),
                    pa.array(piece.astype(np.int32)),
                    pa.array(np.ascontiguousarray(start)),
                    pa.array(np.ascontiguousarray(length)),
                    pa.array(np.ascontiguousarray(crc)),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return work


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(rows, piece_worker(vocabulary, capacity, end_id), schema)


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Pieces with their rank from 0 among those of their length; frequent lengths are numbered in parts."""
    parts = max(1, -(-total // RANK_ROWS))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)))
    within_part = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    sizes = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("rank", F.row_number().over(within_part) - 1)
    return numbered.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))


def place_worker(plan: Plan, names: list[str]):
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 4)
    # one order for all lengths: a length's pieces start where those of shorter ones end
    lengths = sorted(plan.taken)
    first = dict(zip(lengths, np.cumsum([0, *(plan.taken[x] for x in lengths)]).tolist()))
    starts = np.array([first[length] for length in runs[:, 0].tolist()], dtype=np.int64) + runs[:, 1]
    base = np.zeros(plan.capacity + 1, dtype=np.int64)
    for length, at in zip(lengths, first.values()):
        base[length] = at

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = base[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            run = np.searchsorted(starts, at, side="right") - 1
            sequence, offset = runs[run, 2] + at - starts[run], runs[run, 3]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return work


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    small: int = SMALL,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Each text's ids end in ``END_ID``, so an empty or null text is one piece of length 1. Rows are
    told apart by nothing but being rows: null and repeated ids are packed like others. An empty
    table gives an empty table. No other column is read.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut_lineage(token_pieces(df, id_col, text_col, vocabulary, capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(histogram, capacity, groups, small)
    names = ["id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)
    rows = ranked(pieces, sum(histogram.values())).select(*names, "rank")
    return map_arrow(rows, place_worker(plan, names), f"{kinds}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as pieces with their places in training sequences."""
    return pack(docs).withColumnRenamed("id", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
