"""Operators for large training-data corpora (one module per operator).

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; the
queries are registered by ``__spark_entry__.py`` when it can be imported.
"""
