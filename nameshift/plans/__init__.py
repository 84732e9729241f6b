"""Whole jobs: attack inputs, the six strategies, metrics."""
