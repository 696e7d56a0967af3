"""Span analytics on Spark: text spans, lexical lookup, keyed storage and exports."""
