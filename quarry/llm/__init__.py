"""Operators for preparing language-model training data at scale.

Each module holds one operator with its own general interface; ``entries`` registers one
query per operator, and ``sql`` holds the DuckDB twins. Nothing outside this folder (and
``corpus_pipeline.py``) imports it.
"""
