"""Operators for text that language models are trained on.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only if it can be imported.
"""
