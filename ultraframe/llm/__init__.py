"""Operators for preparing language-model training data, all as Spark jobs.

Nothing outside this subpackage imports it; it can be deleted whole.
"""
