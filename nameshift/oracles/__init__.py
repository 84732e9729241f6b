"""The same results as plain SQL, written against the test tables."""

from nameshift.oracles.statements import ORACLES

__all__ = ["ORACLES"]
