"""Operators of a training-data pipeline: counting, scoring, filtering, deduplicating and packing text.

Nothing outside this subpackage (and the pipeline file at the repository top)
imports it; its registered queries are in :mod:`quillspan.llm.queries`.
"""
