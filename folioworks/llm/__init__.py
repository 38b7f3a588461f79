"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it is present.
"""
