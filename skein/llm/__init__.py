"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns DataFrames; the thin
``opN_*`` queries over the standard tables are in :mod:`skein.llm.queries`.
"""
