"""Renaming by whole tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nameshift.functions.lexing import segments


def rename_one(tokens: Column, name: Column, substitute: Column) -> Column:
    """Every token equal to ``name`` becomes ``substitute``."""
    return F.transform(tokens, lambda t: F.when(t == name, substitute).otherwise(t))


def rename_many(tokens: Column, mapping: Column) -> Column:
    """All renames of ``mapping`` at once, so a swap of two names works."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping, t), t))


def rename_text(text: Column, mapping: Column, lang: str = "c") -> Column:
    """T11 on the text itself: layout, comments and literals stay as they are."""
    return F.array_join(rename_many(segments(text, lang), mapping), "")
