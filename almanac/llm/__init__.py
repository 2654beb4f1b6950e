"""Operators for large-scale training-data pipelines.

One module per operator; ``entry.py`` registers their queries.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
