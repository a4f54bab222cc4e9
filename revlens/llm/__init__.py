"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own interface; ``queries`` registers the
thin ``opN_*`` queries over the driver's tables.  Nothing outside this subpackage
imports it, apart from ``corpus_pipeline.py`` and the guarded import of the entry file.
"""
