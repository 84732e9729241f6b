"""Robustness analytics for text and code classifiers, as Spark jobs."""

from nameshift.session import build_session, scratch_dir, stage

__all__ = ["build_session", "scratch_dir", "stage"]
