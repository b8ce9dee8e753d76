"""The greedy k-member method on blocks of encoded rows, many blocks in step.

Runs inside Arrow tasks; needs NumPy and PyArrow only. Arrays are ``(blocks, rows)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CENTROID, MEMBER, REMAINDER = "Centroid", "Member", "Remainder"
# kinds of rows are compared where a block has this many rows of each or more on average
FEW_KINDS = 3


def clusters_before(block: np.ndarray, base: int, rem: int, k: int) -> np.ndarray:
    """Clusters in all blocks before each given one; the first ``rem`` blocks have ``base + 1`` rows."""
    long_before = np.minimum(block, rem)
    return long_before * ((base + 1) // k) + (block - long_before) * (base // k)


def side_by_side(table: pa.Table, by: str, key: str, numerics: int, categories: list[str]) -> tuple:
    """The groups of a table in step: (table in order, (groups, rows) index, valid, sizes, numbers, categories, seeds)."""
    table = table.take(pc.sort_indices(table, sort_keys=[(by, "ascending"), (key, "ascending")]))
    group = table[by].to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    slot = np.arange(sizes.max())[None, :]
    valid = slot < sizes[:, None]
    rows = np.where(valid, starts[:, None] + slot, 0)
    number = [table[f"__n{i}"].to_numpy(zero_copy_only=False).astype(float)[rows] for i in range(numerics)]
    category = [tuple(a[rows] for a in category_arrays(table, i, q)) for i, q in enumerate(categories)]
    seeds = np.where(valid, table["__hash"].to_numpy()[rows], np.iinfo(np.int64).max).argmin(axis=1)
    return table, group[starts], valid, sizes, number, category, seeds


def block_worker(
    base: int,
    rem: int,
    k: int,
    payload: list[str],
    key: str,
    numerics: int,
    categories: list[str],
    share: float,
    bounds: tuple[list[str], list[str]] | None = None,
) -> Callable[[pa.Table], pa.Table]:
    """The function that clusters the blocks of one group of them; ``bounds`` names columns to profile clusters by.

    Adds ``__no``, ``__kind``, and ``__again`` for the rows of each block's worst clusters, the given share of all, with
    their cluster's loss per row. Only clusters of exactly k rows are told to go again.
    """

    def work(table: pa.Table) -> pa.Table:
        table, block, valid, sizes, number, category, seeds = side_by_side(table, "__block", key, numerics, categories)
        local, info, own = cluster_all(number, category, valid, sizes, seeds, k)
        again, loss = worst_clusters(local, own, valid, sizes, k, share)
        names = local[valid] + np.repeat(clusters_before(block, base, rem, k), sizes)
        out = table.select([*payload, "__block"])
        out = out.append_column("__no", pa.array(names, pa.int64()))
        out = out.append_column("__kind", pa.array(info[valid].astype(np.int32)))
        out = with_bounds(out, table, bounds)
        out = out.append_column("__again", pa.array(again[valid]))
        return out.append_column("__loss", pa.array(loss[valid]))

    return work


def cluster_bounds(table: pa.Table, no: pa.Array, numbers: list[str], categories: list[str]) -> dict[str, pa.Array]:
    """Per row, the profile of its cluster: size, bounds of its numbers, nodes and texts in no tree, and counts."""
    columns, wanted = {"no": no}, [("no", "count")]
    for i, p in enumerate(numbers):
        columns[f"n{i}"] = table[p]
        wanted += [(f"n{i}", f) for f in ("min", "max", "count")]
    for i, p in enumerate(categories):
        name, values = f"__c{i}_pre", table[p].combine_chunks()
        pre = table[name].combine_chunks() if name in table.column_names else pa.nulls(len(no), pa.int32())
        columns |= {f"p{i}": pre, f"c{i}": values}
        columns[f"u{i}"] = pc.if_else(pc.is_null(pre), values, pa.scalar(None, values.type))
        wanted += [(f"p{i}", f) for f in ("min", "max", "count")]
        wanted += [(f"c{i}", "count"), (f"u{i}", "min"), (f"u{i}", "max")]
    found = pa.table(columns).group_by("no").aggregate(wanted)
    at = pc.index_in(no, value_set=found["no"].combine_chunks())
    return {f"__{name}": found[name].take(at) for name in found.column_names if name != "no"}


def with_bounds(out: pa.Table, table: pa.Table, bounds: tuple[list[str], list[str]] | None) -> pa.Table:
    if bounds is not None:
        for name, column in cluster_bounds(table, out["__no"].combine_chunks(), *bounds).items():
            out = out.append_column(name, column)
    return out


def worst_clusters(
    label: np.ndarray, own: np.ndarray, valid: np.ndarray, sizes: np.ndarray, k: int, share: float
) -> tuple[np.ndarray, np.ndarray]:
    """(is the row's cluster among its block's worst, loss per row of the cluster); ties go to the least number."""
    each = np.arange(len(label))[:, None]
    count = np.zeros((len(label), own.shape[1] + 1), np.int64)
    np.add.at(count, (each, np.where(valid, label, 0)), valid)
    loss = np.where(count[:, 1:] == k, even(own), -1.0)
    rank = np.argsort(np.argsort(-loss, axis=1, kind="stable"), axis=1, kind="stable")
    told = (rank < np.floor(share * (sizes // k))[:, None]) & (loss > 0)
    place = np.where(valid, label - 1, 0)
    return told[each, place] & valid, loss[each, place]


def exchange_worker(
    k: int,
    payload: list[str],
    key: str,
    numerics: int,
    categories: list[str],
    bounds: tuple[list[str], list[str]] | None = None,
) -> Callable[[pa.Table], pa.Table]:
    """The function that clusters pools of rows once more and keeps what loses less than before."""

    def work(table: pa.Table) -> pa.Table:
        table, _, valid, sizes, number, category, seeds = side_by_side(table, "__pool", key, numerics, categories)
        local, info, own = cluster_all(number, category, valid, sizes, seeds, k)
        old_no, old_kind, old_loss = (table[c].to_numpy() for c in ("__no", "__kind", "__loss"))
        no, kind, start = old_no.copy(), old_kind.copy(), 0
        for g, size in enumerate(sizes):
            here = slice(start, start + size)
            start += size
            if round(k * own[g, : size // k].sum(), 9) < round(old_loss[here].sum(), 9):
                no[here] = np.unique(old_no[here])[local[g, :size] - 1]
                kind[here] = info[g, :size]
        out = table.select([*payload, "__block"])
        out = out.append_column("__no", pa.array(no)).append_column("__kind", pa.array(kind))
        return with_bounds(out, table, bounds)

    return work


def category_arrays(table: pa.Table, i: int, column: str) -> tuple[np.ndarray, ...]:
    """Node number per row and, per level, bounds and height drop of the nodes above it.

    A value in no tree, NULL among them, gets a number of its own above all nodes.
    """
    n = table.num_rows
    if f"__c{i}_pre" in table.column_names:
        pre = table[f"__c{i}_pre"].to_numpy(zero_copy_only=False).astype(float)
        lists = [table[f"__c{i}_{f}"].combine_chunks() for f in ("lo", "hi", "h")]
        lengths = np.nan_to_num(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(float))
        lengths = lengths.astype(np.int64)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    else:
        pre, lengths = np.full(n, np.nan), np.zeros(n, np.int64)
        flat = [np.empty(0)] * 3
    depth = max(1, lengths.max(initial=0))
    inside = np.arange(depth)[None, :] < lengths[:, None]
    lo = np.full((n, depth), np.inf)
    hi = np.full((n, depth), -np.inf)
    height = np.zeros((n, depth))
    for target, source in zip((lo, hi, height), flat):
        target[inside] = source
    stray = np.isnan(pre)
    if stray.any():
        codes = table[column].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        pre = np.where(stray, 1e12 + codes, pre)
        lo[stray, 0] = hi[stray, 0] = pre[stray]
        inside[stray, 0] = True
    above = np.concatenate([np.ones((n, 1)), height[:, :-1]], axis=1)
    return pre, lo, hi, np.where(inside, height - above, 0.0)


class OpenCluster:
    """Bounds of one group of rows per block, held side by side."""

    def __init__(self, number: list, category: list, at: tuple):
        self.lo = [v[at] for v in number]
        self.hi = [v[at] for v in number]
        self.filled = [(~np.isnan(v[at])).astype(int) for v in number]
        self.nodes = [(lo[at], hi[at], drop[at]) for _, lo, hi, drop in category]
        self.size = 1

    def add(self, number: list, category: list, at: tuple) -> None:
        for i, v in enumerate(number):
            self.lo[i] = np.fmin(self.lo[i], v[at])
            self.hi[i] = np.fmax(self.hi[i], v[at])
            self.filled[i] = self.filled[i] + ~np.isnan(v[at])
        for i, (pre, *_) in enumerate(category):
            lo, hi, drop = self.nodes[i]
            value = pre[at][..., None]
            self.nodes[i] = (lo, hi, drop * ((value >= lo) & (value <= hi)))
        self.size += 1

    def own_loss(self) -> np.ndarray:
        parts = [number_loss(hi - lo, f, self.size) for lo, hi, f in zip(self.lo, self.hi, self.filled)]
        parts += [1.0 + drop.sum(axis=-1) for _, _, drop in self.nodes]
        return reduce(np.add, parts)


def number_loss(spread: np.ndarray, filled: np.ndarray, size) -> np.ndarray:
    mixed = (filled > 0) & (filled < size)
    return np.where(mixed, 1.0, np.where(np.isnan(spread), 0.0, spread))


def union_loss(c: OpenCluster, number: list, category: list, holes: list[bool]) -> np.ndarray:
    """Per-row loss of each block's group joined by each of the block's rows."""
    total = None
    for v, lo, hi, filled, hole in zip(number, c.lo, c.hi, c.filled, holes):
        lo, hi = lo[:, None], hi[:, None]
        if hole:
            spread = np.fmax(hi, v) - np.fmin(lo, v)
            part = number_loss(spread, filled[:, None] + ~np.isnan(v), c.size + 1)
        else:
            part = np.maximum(hi, v)
            part -= np.minimum(lo, v)
        total = part if total is None else np.add(total, part, out=total)
    for (pre, *_), (lo, hi, drop) in zip(category, c.nodes):
        total = np.ones_like(pre) if total is None else np.add(total, 1.0, out=total)
        for d in range(lo.shape[-1]):
            if drop[:, d].any():
                hit = (pre >= lo[:, d, None]) & (pre <= hi[:, d, None])
                total += hit * drop[:, d, None]
    return total


def even(loss: np.ndarray) -> np.ndarray:
    """Equal losses compare equal whatever order their terms were added in, so ties go to the least key."""
    return np.round(loss, 9)


def cluster_blocks(
    number: list, category: list, valid: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Runs the greedy method on all blocks in step; returns local cluster number and kind per row."""
    return cluster_all(number, category, valid, sizes, seeds, k)[:2]


def kinds_of_rows(number: list, category: list, valid: np.ndarray) -> np.ndarray:
    """A number per row, the same for rows of a block that are alike in all values; numbers go by first row."""
    blocks, width = valid.shape
    code = np.where(valid, 0, 1)
    for v in [*number, *(pre for pre, *_ in category)]:
        _, own = np.unique(v, return_inverse=True)
        _, code = np.unique(code * (own.max() + 1) + own.reshape(v.shape), return_inverse=True)
        code = code.reshape(v.shape)
    _, first, code = np.unique(code + np.arange(blocks)[:, None] * (code.max() + 1), return_index=True, return_inverse=True)
    first_slot = first % width
    return first_slot[code.reshape(valid.shape)]


def cluster_all(
    number: list, category: list, valid: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``cluster_blocks``, and the loss per row of each cluster before leftovers join it: (blocks, clusters).

    Rows that are alike lose the same, and the least key of them goes first. Blocks of few kinds of rows therefore
    compare kinds, and in blocks of one kind rows follow by key; the result is that of comparing rows.
    """
    blocks, width = valid.shape
    told = kinds_of_rows(number, category, valid)
    found = np.zeros((blocks, width), bool)
    found[np.nonzero(valid)[0], told[valid]] = True
    many = found.sum(axis=1)
    label, kind = np.zeros((blocks, width), np.int64), np.full((blocks, width), 1, np.int64)
    own = np.zeros((blocks, int(sizes.max()) // k))
    for some, work in (
        ((many == 1) & (sizes >= k), cluster_alike),
        ((many > 1) & (many * FEW_KINDS <= sizes), cluster_kinds),
    ):
        if some.any():
            part = [v[some] for v in number], [tuple(x[some] for x in c) for c in category]
            made = work(*part, valid[some], sizes[some], seeds[some], k, told[some])
            label[some], kind[some] = made[:2]
            own[some, : made[2].shape[1]] = made[2]
            many[some] = 0
    rest = many > 0
    if rest.any():
        part = [v[rest] for v in number], [tuple(x[rest] for x in c) for c in category]
        made = cluster_rows(*part, valid[rest], sizes[rest], seeds[rest], k)
        label[rest], kind[rest] = made[:2]
        own[rest, : made[2].shape[1]] = made[2]
    return label, kind, own


def cluster_alike(number, category, valid, sizes, seeds, k, told):
    """Blocks whose rows are all alike: every loss is the same, so rows follow by key."""
    blocks, width = valid.shape
    slot = np.broadcast_to(np.arange(width), valid.shape)
    inside = valid & (slot < (sizes // k * k)[:, None])
    label = np.where(inside, slot // k + 1, np.where(valid, 1, 0))
    kind = np.where(inside & (slot % k == 0), 0, np.where(valid & ~inside, 2, 1))
    c = OpenCluster(number, category, (np.arange(blocks), np.zeros(blocks, np.int64)))
    for _ in range(k - 1):
        c.add(number, category, (np.arange(blocks), np.zeros(blocks, np.int64)))
    return label, kind, np.repeat(c.own_loss()[:, None], int(sizes.max()) // k, axis=1)


def cluster_kinds(number, category, valid, sizes, seeds, k, told):
    """``cluster_all`` by comparing kinds of rows: one row of each, with the place of its next free row."""
    blocks, width = valid.shape
    each = np.arange(blocks)
    by_kind = np.argsort(np.where(valid, told, width), axis=1, kind="stable")
    ordered = np.take_along_axis(np.where(valid, told, width), by_kind, 1)
    change = np.c_[np.ones(blocks, bool), ordered[:, 1:] != ordered[:, :-1]] & (ordered < width)
    count = change.sum(axis=1)
    most = int(count.max())
    start = np.full((blocks, most), width, np.int64)
    g, at = np.nonzero(change)
    start[g, (np.cumsum(change, axis=1) - 1)[g, at]] = at
    end = np.minimum(np.c_[start[:, 1:], np.full(blocks, width)], sizes[:, None])
    by_kind = np.c_[by_kind, np.full(blocks, width)]
    real = np.arange(most) < count[:, None]
    place = np.where(real, by_kind[each[:, None], start], width)
    one = np.where(real, place, place[:, :1])
    free = np.where(real, 0.0, np.inf)
    few_number = [np.take_along_axis(v, one, 1) for v in number]
    few_category = [(p[each[:, None], one], *(x[each[:, None], one] for x in xs)) for p, *xs in category]
    holes = [bool(np.isnan(v[valid]).any()) for v in number]
    label, kind = np.zeros((blocks, width), np.int64), np.full((blocks, width), 1, np.int64)
    last = (each, (np.take_along_axis(told, seeds[:, None], 1) == one).argmax(axis=1))

    def take(loss: np.ndarray, active: np.ndarray, no: int, what: int) -> tuple:
        best = np.where(loss == loss.min(axis=1)[:, None], place, width + 1)
        at = (each, best.argmin(axis=1))
        g, j = each[active], at[1][active]
        row = place[g, j]
        label[g, row], kind[g, row] = no, what
        start[g, j] += 1
        done = start[g, j] >= end[g, j]
        place[g, j] = np.where(done, width, by_kind[g, np.minimum(start[g, j], width)])
        free[g[done], j[done]] = np.inf
        return at

    previous, done = OpenCluster(few_number, few_category, last), []
    for no in range(1, int(sizes.max()) // k + 1):
        active = sizes - (no - 1) * k >= k
        at = take(free - even(union_loss(previous, few_number, few_category, holes)), active, no, 0)
        c = OpenCluster(few_number, few_category, at)
        while c.size < k:
            at = take(even(union_loss(c, few_number, few_category, holes)) + free, active, no, 1)
            c.add(few_number, few_category, at)
        done.append((c, active))
        previous = OpenCluster(few_number, few_category, at)
    own = np.stack([c.own_loss() for c, _ in done], axis=1)
    place_leftovers(label, kind, valid, done, own, number, category, k)
    return label, kind, own


def cluster_rows(
    number: list, category: list, valid: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cluster_all`` by comparing rows."""
    blocks, width = valid.shape
    each = np.arange(blocks)
    label = np.zeros((blocks, width), np.int64)
    kind = np.full((blocks, width), 1, np.int64)
    place = np.broadcast_to(np.arange(width), valid.shape).copy()
    taken = np.where(valid, 0.0, np.inf)
    holes = [bool(np.isnan(v[valid]).any()) for v in number]
    full_number, full_category = number, category
    previous = OpenCluster(number, category, (each, seeds))
    done = []
    for no in range(1, int(sizes.max()) // k + 1):
        used = (no - 1) * k
        active = sizes - used >= k
        if width - used <= 0.8 * taken.shape[1]:
            keep = np.argsort(taken, axis=1, kind="stable")[:, : width - used]
            place, taken, number, category = shrink(keep, place, taken, number, category)
        at = (each, (even(union_loss(previous, number, category, holes)) - taken).argmax(axis=1))
        c = OpenCluster(number, category, at)
        mark(label, kind, place, taken, at, active, no, 0)
        while c.size < k:
            at = (each, (even(union_loss(c, number, category, holes)) + taken).argmin(axis=1))
            c.add(number, category, at)
            mark(label, kind, place, taken, at, active, no, 1)
        done.append((c, active))
        previous = OpenCluster(number, category, at)
    own = np.stack([c.own_loss() for c, _ in done], axis=1)
    place_leftovers(label, kind, valid, done, own, full_number, full_category, k)
    return label, kind, own


def mark(label, kind, place, taken, at, active, no, what) -> None:
    g, j = at[0][active], at[1][active]
    label[g, place[g, j]] = no
    kind[g, place[g, j]] = what
    taken[g, j] = np.inf


def shrink(keep, place, taken, number, category):
    """Drops rows that are taken; the order of the others stays."""
    row = np.take_along_axis
    deep = keep[..., None]
    return (
        row(place, keep, 1),
        row(taken, keep, 1),
        [row(v, keep, 1) for v in number],
        [(row(p, keep, 1), row(lo, deep, 1), row(hi, deep, 1), row(d, deep, 1)) for p, lo, hi, d in category],
    )


def place_leftovers(label, kind, valid, done, own, number, category, k) -> None:
    """Gives every free row to the finished cluster whose loss it raises least, ties to the first."""
    free = valid & (label == 0)
    if not free.any():
        return
    live = np.stack([a for _, a in done], axis=1)
    g, j = np.nonzero(free)
    total = np.zeros((len(g), len(done)))
    for i, v in enumerate(number):
        value = v[g, j][:, None]
        lo = np.stack([c.lo[i] for c, _ in done], axis=1)[g]
        hi = np.stack([c.hi[i] for c, _ in done], axis=1)[g]
        filled = np.stack([c.filled[i] for c, _ in done], axis=1)[g] + ~np.isnan(value)
        total += number_loss(np.fmax(hi, value) - np.fmin(lo, value), filled, k + 1)
    for i, (pre, *_) in enumerate(category):
        value = pre[g, j][:, None, None]
        lo, hi, drop = (np.stack([c.nodes[i][f] for c, _ in done], axis=1)[g] for f in range(3))
        total += 1.0 + (drop * ((value >= lo) & (value <= hi))).sum(axis=-1)
    gain = even((k + 1) * total - k * own[g])
    gain[~live[g]] = np.inf
    label[g, j] = gain.argmin(axis=1) + 1
    kind[g, j] = 2
