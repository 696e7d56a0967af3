"""All queries of the library's own operators."""

from . import documents, reading, spans, store, sounds  # noqa: F401  (each registers its queries)
from ._register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
