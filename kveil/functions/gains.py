"""Rises of information loss of a block of groups joined by each of a block of rows, as NumPy matrices.

The same rules as ``metrics.LossModel``, for Arrow tasks that compare blocks with blocks. Groups and
rows come as Arrow struct arrays with the fields described there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbers(items: pa.StructArray, name: str) -> np.ndarray:
    return pc.cast(items.field(name), pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def codes(groups: pa.StructArray, rows: pa.StructArray, names: tuple[str, str, str]) -> list[np.ndarray]:
    """Texts as numbers that are equal exactly if the texts are; nulls as -1, of rows as -2."""
    lo, hi, own = names
    parts = [groups.field(lo), groups.field(hi), rows.field(own)]
    found = pa.concat_arrays([pc.cast(p, pa.string()) for p in parts]).dictionary_encode().indices
    flat = found.to_numpy(zero_copy_only=False).astype(float)
    n = len(groups)
    pieces = (flat[:n], flat[n : 2 * n], flat[2 * n :])
    return [np.where(np.isnan(x), none, x) for x, none in zip(pieces, (-1, -1, -2))]


def paths_of(groups: pa.StructArray, q: dict) -> np.ndarray:
    """Bounds and heights of the nodes above each group: (field, group, depth), NaN beyond the path."""
    paths = np.full((3, len(groups), max(1, q["depth"])), np.nan)
    for f, name in enumerate(("anc_pre", "anc_last", "anc_height")):
        lists = groups.field(q[name])
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        inside = np.arange(paths.shape[2])[None, :] < lengths[:, None]
        paths[f][inside] = lists.flatten().to_numpy(zero_copy_only=False)
    return paths


def number_terms(q: dict, groups: pa.StructArray, rows: pa.StructArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joined, own) loss of one numeric column; ``q`` holds its field names and the domain's width."""
    lo, hi, nn = (numbers(groups, q[f])[:, None] for f in ("lo", "hi", "nn"))
    v = numbers(rows, q["v"])[None, :]

    def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b - a) / q["width"] if q["width"] > 0 else np.zeros_like(b - a)

    joined = np.where(nn < size, 1.0, spread(np.fmin(lo, v), np.fmax(hi, v)))
    joined = np.where(np.isnan(v), np.where(nn > 0, 1.0, 0.0), joined)
    own = np.where(nn == 0, 0.0, np.where(nn < size, 1.0, spread(lo, hi)))
    return joined, own


def category_terms(q: dict, groups: pa.StructArray, rows: pa.StructArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joined, own) loss of one category; ``q`` holds its field names and the depth of its tree."""
    lo, hi, mapped, nn = (numbers(groups, q[f])[:, None] for f in ("lo", "hi", "mapped", "nn"))
    pre = numbers(rows, q["pre"])[None, :]
    ulo, uhi, u = codes(groups, rows, (q["ulo"], q["uhi"], q["u"]))
    ulo, uhi, u = ulo[:, None], uhi[:, None], u[None, :]
    paths = paths_of(groups, q)

    def height(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = np.broadcast_shapes(a.shape, b.shape)
        if not q["depth"]:
            return np.ones(shape)
        shared = np.zeros(shape, dtype=int)
        for d in range(q["depth"]):
            shared += (paths[0][:, d, None] <= a) & (paths[1][:, d, None] >= b)
        found = np.take_along_axis(paths[2], np.maximum(shared - 1, 0), axis=1)
        return np.where(a == b, 0.0, found)

    same = (mapped == 0) & (nn == size) & (ulo == u) & (uhi == u)
    in_tree = np.where(mapped == size, height(np.fmin(lo, pre), np.fmax(hi, pre)), 1.0)
    as_text = np.where(u >= 0, np.where(same, 0.0, 1.0), np.where(nn == 0, 0.0, 1.0))
    joined = np.where(np.isnan(pre), as_text, in_tree)
    mixed = (mapped > 0) | (nn < size)
    own = np.where(mixed, 1.0, np.where(ulo == uhi, 0.0, 1.0))
    own = np.where(nn == 0, 0.0, np.where(mapped == size, height(lo, hi), own))
    return joined, own


def gain_matrix(
    groups: pa.StructArray, rows: pa.StructArray, size: str, numeric: list[dict], category: list[dict]
) -> np.ndarray:
    """Groups down, rows across, to nine places."""
    n = numbers(groups, size)[:, None]
    parts = [number_terms(q, groups, rows, n) for q in numeric]
    parts += [category_terms(q, groups, rows, n) for q in category]
    joined = sum((j for j, _ in parts), np.zeros((len(groups), len(rows))))
    own = sum((o for _, o in parts), np.zeros((len(groups), 1)))
    return np.round((n + 1) * joined - n * own, 9)


def best_worker(size: str, numeric: list[dict], category: list[dict], id_type: pa.DataType):
    """For each pair of a block of groups, in the order of ties, and a block of rows, the best group of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, groups, rows in zip(batch.column("row_block"), batch.column("groups"), batch.column("rows")):
                groups, rows = groups.values, rows.values
                gain = gain_matrix(groups, rows, size, numeric, category)
                # the first least gain is the one to take
                best = np.where(np.isnan(gain), np.inf, gain).argmin(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), block.as_py()), pa.int64()),
                        pc.cast(rows.field("__id"), id_type),
                        pa.array(gain[best, np.arange(len(rows))]),
                        pc.cast(groups.field("__no").take(pa.array(best)), pa.int64()),
                        pc.cast(groups.field("__name").take(pa.array(best)), pa.string()),
                    ],
                    names=["row_block", "id", "delta", "no", "name"],
                )

    return work
