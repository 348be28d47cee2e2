"""Operators for preparing large text corpora (training-data pipelines).

Nothing else in the library imports this subpackage.
"""
