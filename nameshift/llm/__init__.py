"""Operators of a training-data pipeline: cleaning, scoring, tokens and archives.

Nothing else in the package imports this subpackage.
"""
