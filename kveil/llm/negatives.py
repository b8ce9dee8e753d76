"""Hard-negative mining with Kronecker-packed products: exact integer scores, several candidates a multiplication.

Components are integers. Those of several candidates, biased so that none is negative, are put side by side
into fields of one 64-bit integer per dimension. An anchor's component times that integer is the product with
every candidate at once, and the sum over the dimensions holds one exact score per field. Fields are wide
enough for the largest sum that the table allows, so nothing carries over; a bias on the sum keeps every
field from going negative.

Anchors meet all candidates in blocks: anchors are dealt into groups of bounded size and candidates into
slices, and each task reads one group and then streams the blocks of one slice, keeping only the best few
rows per anchor. Blocks have the same size whatever labels or vectors they hold, so a hot label is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow, table
from kveil.session import cut_lineage

BLOCK = 512  # rows of a block, of anchors or of candidates
GROUP = 4096  # anchors that a task holds, on average
SLICE = 1 << 20  # candidates that a task reads, at most on average
WORD_BITS = 63
NONE = np.iinfo(np.int64).min  # the score of no row
BLOCK_SCHEMA = "kind int, ids array<long>, labels array<long>, words array<long>, positives array<long>, bounds array<long>"


@dataclass(frozen=True)
class Fields:
    """Layout of packed integers: ``per_word`` fields of ``width`` bits for components of ``low`` and more."""

    dims: int
    low: int
    width: int
    per_word: int

    @staticmethod
    def of(dims: int, low: int, high: int, most: float) -> "Fields":
        """For components ``low..high`` and anchors whose absolute components sum to ``most`` or less."""
        largest = (int(most * (1 + 1e-9)) + 1) * max(high - low, 1)
        width = largest.bit_length() + 1
        reach = (int(most) + 1) * max(abs(low), abs(high), 1)
        if width > WORD_BITS or reach.bit_length() > 55:
            raise ValueError(f"scores of components {low}..{high} in {dims} dimensions do not fit in a long")
        return Fields(dims, low, width, WORD_BITS // width)

    def pack(self, values: np.ndarray) -> np.ndarray:
        """Rows of components as words: one row of words per ``per_word`` rows, the last filled up with the least."""
        n = -(-len(values) // self.per_word) * self.per_word
        biased = np.zeros((n, self.dims), np.int64)
        biased[: len(values)] = values - self.low
        words = np.zeros((n // self.per_word, self.dims), np.int64)
        for j in range(self.per_word):
            words |= biased[j :: self.per_word] << (j * self.width)
        return words

    def scores(self, anchors: np.ndarray, words: np.ndarray, count: int) -> np.ndarray:
        """Inner products, anchors down and the ``count`` packed rows across."""
        half = 1 << (self.width - 1)
        products = anchors @ words.T + sum(half << (j * self.width) for j in range(self.per_word))
        out = np.empty((len(anchors), words.shape[0] * self.per_word), np.int64)
        for j in range(self.per_word):
            out[:, j :: self.per_word] = (products >> (j * self.width)) & ((1 << self.width) - 1)
        out += self.low * anchors.sum(axis=1, keepdims=True) - half
        return out[:, :count]


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Arrays of integers as rows of a matrix; short ones end in zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def one_row(fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([fields], schema=ARROW_BLOCK)


ARROW_BLOCK = pa.schema(
    [("kind", pa.int32())]
    + [(n, pa.list_(pa.int64())) for n in ("ids", "labels", "words", "positives", "bounds")]
)


def candidate_worker(fields: Fields):
    """Rows of (id, label, values) to blocks of packed words, in order of id within a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            words = fields.pack(matrix(batch.column("values"), fields.dims)[order])
            labels = batch.column("label").to_numpy()[order]
            yield one_row({"kind": 1, "ids": ids[order], "labels": labels, "words": words.ravel()})

    return work


def anchor_worker(fields: Fields, keep: int):
    """Rows of (id, label, values, positives, bounds) to blocks of plain components; ``keep`` positives a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row = {"kind": 0, "ids": batch.column("id").to_numpy(), "labels": batch.column("label").to_numpy()}
            row["words"] = matrix(batch.column("values"), fields.dims).ravel()
            for name in ("positives", "bounds"):
                held = np.full((batch.num_rows, keep), NONE, np.int64)
                lists = batch.column(name)
                at = np.arange(keep)[None, :] < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]
                held[at] = lists.flatten().to_numpy(zero_copy_only=False)
                row[name] = held.ravel()
            yield one_row(row)

    return work


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


class Best:
    """The best few rows per place, by falling score and then rising id."""

    def __init__(self, places: int, keep: int):
        self.score = np.full((places, keep), NONE, np.int64)
        self.id = np.full((places, keep), NONE, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates across, in order of id; those of score NONE do not count. ``scores`` is used up."""
        keep = self.score.shape[1]
        better = scores.max(axis=1, initial=NONE) >= np.maximum(self.score[:, -1], NONE + 1)
        rows = np.flatnonzero(better)
        if not len(rows):
            return
        scores, each = scores[rows], np.arange(len(rows))
        found, who = [], []
        for _ in range(min(keep, scores.shape[1])):
            at = scores.argmax(axis=1)
            found.append(scores[each, at].copy())
            who.append(ids[at])
            scores[each, at] = NONE
        score = np.concatenate([self.score[rows], np.stack(found, axis=1)], axis=1)
        name = np.concatenate([self.id[rows], np.stack(who, axis=1)], axis=1)
        order = np.lexsort((name, ~score), axis=-1)[:, :keep]  # ~x falls as x rises, without overflow
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.id[rows] = np.take_along_axis(name, order, 1)


class Anchors:
    """One block of anchors and what it has found so far."""

    def __init__(self, row: dict, fields: Fields, positives: int, negatives: int, share: tuple[int, int] | None):
        self.ids, self.labels = row["ids"], row["labels"]
        self.values = row["words"].reshape(-1, fields.dims)
        self.fields, self.share = fields, share
        n = len(self.ids)
        self.positives = row["positives"].reshape(n, positives)
        self.bounds = row["bounds"].reshape(n, positives)
        self.best = [Best(n, positives)] if share is None else [Best(n, negatives) for _ in range(positives)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, words: np.ndarray) -> None:
        scores = self.fields.scores(self.values, words.reshape(-1, self.fields.dims), len(ids))
        same = self.labels[:, None] == labels[None, :]
        if self.share is None:
            self.best[0].add(np.where(same & (self.ids[:, None] != ids[None, :]), scores, NONE), ids)
            return
        scores[same] = NONE
        least, most = self.share
        for p, best in enumerate(self.best):
            bound = self.bounds[:, p]
            known = bound != NONE
            bound = np.where(known, bound, 0)
            low = np.where(known, -((-least * bound) // 100), 1)
            high = np.where(known, (most * bound) // 100, 0)
            inside = (scores >= low[:, None]) & (scores <= high[:, None])
            if inside.any():
                best.add(np.where(inside, scores, NONE), ids)

    def result(self) -> pa.RecordBatch:
        parts = []
        for p, best in enumerate(self.best):
            row, rank = np.nonzero(best.score != NONE)
            own = (best.id, best.score) if self.share is None else (self.positives[:, [p]], self.bounds[:, [p]])
            at = rank if self.share is None else np.zeros_like(rank)
            parts.append((self.ids[row], own[0][row, at], own[1][row, at], best.id[row, rank], best.score[row, rank]))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], names=names)


def meet_worker(fields: Fields, positives: int, negatives: int, share: tuple[int, int] | None):
    """A partition's blocks, those of anchors first, to the best rows of every anchor among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[Anchors] = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for i in range(batch.num_rows):
                lists = {n: batch.column(n)[i].values for n in ARROW_BLOCK.names[1:]}
                row = {n: None if v is None else v.to_numpy(zero_copy_only=False) for n, v in lists.items()}
                if kinds[i] == 0:
                    anchors.append(Anchors(row, fields, positives, negatives, share))
                else:
                    for a in anchors:
                        a.meet(row["ids"], row["labels"], row["words"])
        for a in anchors:
            yield a.result()

    return work


def meet(anchors: DataFrame, candidates: DataFrame, groups: int, slices: int, worker) -> DataFrame:
    """Every block of anchors against every block of candidates: one partition per group and slice."""

    def share(n: int) -> Column:
        return F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("g", share(groups)).withColumn("s", all_of(slices))
    right = candidates.withColumn("s", share(slices)).withColumn("g", all_of(groups))
    both = left.unionByName(right).withColumn("part", F.col("g") * slices + F.col("s"))
    dealt = both.repartitionById(groups * slices, "part").sortWithinPartitions("kind", F.col("ids")[0])
    shape = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return map_arrow(dealt.drop("g", "s", "part"), worker, shape)


def quantised(df: DataFrame, id_col: str, label: Column, vector: Column, scale: float = 256.0) -> DataFrame:
    """(id, label, values): every component x becomes floor(scale * x).

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of rows that
    share an id the first by label and values counts.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    rows = df.select(col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(~bad).select("id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("values"))
    first = F.min(F.struct("label", "values")).alias("f")
    return rows.groupBy("id").agg(first).select("id", "f.label", "f.values")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    share: tuple[int, int] = (50, 95),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has long columns id and label and an array of longs, values, with unique ids, see ``quantised``.
    A score is the inner product with the anchor; higher come first, ties by id. An anchor's positives are its first
    few other rows of the same label; for each of them the first few rows of another label are returned whose
    score is between the two shares (in percent) of the positive's. Vectors of different lengths are compared as if the
    shorter ended in zeros. Anchors without such rows give none, and an empty table gives an empty one.
    Scores that may not fit in a long are an error.
    """
    rows = cut_lineage(rows)
    size = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.abs(v.cast("double")))
    facts = rows.agg(
        F.max(F.size("values")).alias("dims"),
        F.min(F.array_min("values")).alias("low"),
        F.max(F.array_max("values")).alias("high"),
        F.count(F.lit(1)).alias("rows"),
        F.max(F.when(is_anchor, size)).alias("most"),
        F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    dims, low, high = max(facts.dims or 0, 1), min(facts.low or 0, 0), max(facts.high or 0, 0)
    fields = Fields.of(dims, low, high, facts.most or 0.0)
    packed = cut_lineage(map_arrow(rows, candidate_worker(fields), BLOCK_SCHEMA))
    groups = max(1, ceil(facts.anchors / GROUP))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, ceil(facts.rows / SLICE), min(ceil(tasks / groups), ceil(facts.rows / BLOCK)))
    anchors = rows.filter(is_anchor)

    def of(side: DataFrame, bound: tuple[int, int] | None) -> DataFrame:
        blocks = map_arrow(side.select("id", "label", "values", "positives", "bounds"), anchor_worker(fields, positives), BLOCK_SCHEMA)
        return meet(blocks, packed, groups, slices, meet_worker(fields, positives, negatives, bound))

    none = F.array().cast("array<long>")
    near = of(anchors.withColumns({"positives": none, "bounds": none}), None)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score")))
    chosen = near.groupBy("anchor_id").agg(listed.alias("l"))
    chosen = chosen.select(F.col("anchor_id").alias("id"), F.col("l.positive_id").alias("positives"), F.col("l.positive_score").alias("bounds"))
    far = of(anchors.join(cut_lineage(chosen), "id"), share)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", label, F.col("embedding"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
