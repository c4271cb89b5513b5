"""Operators for preparing language-model training corpora.

Nothing outside this subpackage (and the top-level ``corpus_pipeline``) imports
it; it can be removed without touching the rest of the library.
"""
