"""Training-data operators: search, scoring, deduplication, extraction, mixing, encoding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
