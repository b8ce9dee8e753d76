"""Distances and information loss as column expressions.

Two metrics. ``paper`` is the published one: numeric spread over the domain, and height of the
lowest common ancestor over height of the tree. ``reference`` is the literal scalar form that
divides integers and rounds to two places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from kveil.sources.config import Roles

METRICS = ("paper", "reference")


def total(columns: list[Column]) -> Column:
    return reduce(add, columns, F.lit(0.0))


def _int_divide(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def numeric_distance(a: Column, b: Column, lo: Column, hi: Column, metric: str = "paper") -> Column:
    """Distance of two values of a column whose domain is ``lo..hi``."""
    if metric == "reference":
        gap = F.abs(a.cast("long") - b.cast("long"))
        spread = F.abs(hi.cast("long") - lo.cast("long"))
        return F.coalesce(F.round(_int_divide(gap, spread).cast("double"), 2), F.lit(0.0))
    both_null = a.isNull() & b.isNull()
    spread = hi.cast("double") - lo.cast("double")
    return (
        F.when(both_null, 0.0)
        .when(a.isNull() | b.isNull(), 1.0)
        .when(spread > 0, F.abs(a.cast("double") - b.cast("double")) / spread)
        .otherwise(0.0)
    )


def numeric_loss_reference(lo: Column, hi: Column, size: Column) -> Column:
    spread = F.abs(hi.cast("long") - lo.cast("long"))
    return F.coalesce(F.round(_int_divide(spread, size.cast("long")).cast("double"), 2), F.lit(0.0))


def category_distance_reference(lca_level: Column, levels: Column) -> Column:
    """Level of the common ancestor over levels of the tree; 0 when a value is in no tree."""
    return F.coalesce(F.round(lca_level.cast("double") / levels.cast("double"), 2), F.lit(0.0))


def category_loss_reference(levels: int) -> Column:
    return F.round(F.lit(1.0) / F.lit(float(levels)), 2) if levels else F.lit(0.0)


def shared_depth(anc_pre: Column, anc_last: Column, lo: Column, hi: Column, depth: int) -> Column:
    """How many nodes of a root-to-node path span every preorder number in ``lo..hi``.

    Written out per level, so it stays inside generated code.
    """
    hits = [
        F.when((F.get(anc_pre, F.lit(i)) <= lo) & (F.get(anc_last, F.lit(i)) >= hi), 1).otherwise(0)
        for i in range(depth)
    ]
    return reduce(add, hits, F.lit(0))


# A group of rows is described by these fields per column; see operators.cohorts.
#   numeric:  lo, hi, nn          (nn = rows that are not NULL)
#   category: lo, hi, mapped, nn, ulo, uhi, anc_pre, anc_last, anc_height
# ``lo``/``hi`` of a category are preorder numbers in its tree, ``mapped`` counts rows found in
# it, ``ulo``/``uhi`` bound the texts that are not, and the ``anc_`` arrays are the path of ``lo``.
# One row is described by ``v`` (numeric) or by ``pre`` and ``u`` (category).
Getter = Callable[[str, str], Column]


@dataclass(frozen=True)
class LossModel:
    """Loss of a group's quasi-identifiers, alone or joined by one more row."""

    roles: Roles
    domain: dict[str, tuple]
    depths: dict[str, int] = field(default_factory=dict)

    def width(self, q: str) -> float:
        """Greatest minus least value of a numeric column's domain, at least 0."""
        low, high = self.domain[q]
        return 0.0 if low is None else max(0.0, float(high) - float(low))

    def _spread(self, q: str, lo: Column, hi: Column) -> Column:
        width = self.width(q)
        if width <= 0:
            return F.lit(0.0)
        return (hi.cast("double") - lo.cast("double")) / F.lit(width)

    def own_loss(self, group: Getter, size: Column) -> Column:
        """Per-row loss of a group, between 0 and the number of quasi-identifiers."""
        return total(self.own_terms(group, size))

    def own_terms(self, group: Getter, size: Column) -> list[Column]:
        """The parts of ``own_loss``, from 0 to 1 each: numeric columns first, then categories."""
        terms = []
        for q in self.roles.numeric_quasi:
            nn = group(q, "nn")
            terms.append(
                F.when(nn == 0, 0.0)
                .when(nn < size, 1.0)
                .otherwise(self._spread(q, group(q, "lo"), group(q, "hi")))
            )
        for q in self.roles.category_quasi:
            terms.append(
                F.when(group(q, "nn") == 0, 0.0)
                .when(group(q, "mapped") == size, self._height(q, group, group(q, "lo"), group(q, "hi")))
                .when((group(q, "mapped") > 0) | (group(q, "nn") < size), 1.0)
                .when(group(q, "ulo") == group(q, "uhi"), 0.0)
                .otherwise(1.0)
            )
        return terms

    def union_loss(self, group: Getter, size: Column, row: Getter) -> Column:
        """Per-row loss of the group once the row has joined it."""
        terms = []
        for q in self.roles.numeric_quasi:
            nn, v = group(q, "nn"), row(q, "v")
            spread = self._spread(q, F.least(group(q, "lo"), v), F.greatest(group(q, "hi"), v))
            terms.append(
                F.when(v.isNull(), F.when(nn > 0, 1.0).otherwise(0.0))
                .when(nn < size, 1.0)
                .otherwise(spread)
            )
        for q in self.roles.category_quasi:
            pre, u = row(q, "pre"), row(q, "u")
            lo, hi = F.least(group(q, "lo"), pre), F.greatest(group(q, "hi"), pre)
            same_text = (
                (group(q, "mapped") == 0)
                & (group(q, "nn") == size)
                & (group(q, "ulo") == u)
                & (group(q, "uhi") == u)
            )
            terms.append(
                F.when(
                    pre.isNotNull(),
                    F.when(group(q, "mapped") == size, self._height(q, group, lo, hi)).otherwise(1.0),
                )
                .when(u.isNotNull(), F.when(same_text, 0.0).otherwise(1.0))
                .otherwise(F.when(group(q, "nn") == 0, 0.0).otherwise(1.0))
            )
        return total(terms)

    def gain(self, group: Getter, size: Column, row: Getter) -> Column:
        """Rise of the group's information loss when the row joins it."""
        return (size + 1) * self.union_loss(group, size, row) - size * self.own_loss(group, size)

    def _height(self, q: str, group: Getter, lo: Column, hi: Column) -> Column:
        depth = self.depths.get(q, 0)
        if depth == 0:
            return F.lit(1.0)
        d = shared_depth(group(q, "anc_pre"), group(q, "anc_last"), lo, hi, depth)
        return F.when(lo == hi, 0.0).otherwise(F.get(group(q, "anc_height"), d - 1))
