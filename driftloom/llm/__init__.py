"""Operators for preparing large text and embedding corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
