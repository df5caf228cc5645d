"""Training-data operators: each module holds one operator and the thin query that applies it.

Nothing outside this subpackage imports it, apart from the guarded hook in ``__spark_entry__.py``
and ``corpus_pipeline.py``, which counts as part of it.
"""
