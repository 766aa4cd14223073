"""Training-data operators: deduplication, filtering, formatting and encoding of text corpora.

Nothing outside this subpackage imports it. `queries.py` registers one query for each operator.
"""
