"""Row functions over Arrow batches, as the core has them."""

from ..functions.arrow import over_batches, over_slices

__all__ = ["over_batches", "over_slices"]
