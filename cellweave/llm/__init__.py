"""Operators for training-data pipelines over large document corpora.

Nothing outside this subpackage imports it.
"""
