from kveil.functions.casting import CATEGORY, NUMERIC, quoted, to_category, to_numeric, typed
from kveil.functions.metrics import (
    category_distance_reference,
    category_loss_reference,
    numeric_distance,
    numeric_loss_reference,
)

__all__ = [
    "CATEGORY",
    "NUMERIC",
    "quoted",
    "to_category",
    "to_numeric",
    "typed",
    "category_distance_reference",
    "category_loss_reference",
    "numeric_distance",
    "numeric_loss_reference",
]
