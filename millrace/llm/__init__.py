"""Training-data operators: deduplication, scoring, filtering and mixing at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
