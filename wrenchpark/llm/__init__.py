"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Each
module holds one operator with a general interface; ``queries.py`` registers
the ``opN_*`` queries that apply them to whole tables.
"""
