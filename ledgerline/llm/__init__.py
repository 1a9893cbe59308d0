"""Operators for large training-text corpora, built on Spark DataFrames.

Nothing else in ``ledgerline`` imports this subpackage.
"""
