"""Which names may be renamed, and which words may replace them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameshift.functions.lexing import WORD
from nameshift.functions.reserved import NAME_RULE_LANGUAGES, reserved_table, reserved_words

#: ``\\z`` is the very end; ``$`` would let a final line break pass.
IDENTIFIER = rf"^{WORD}\z"
SPACES = " \t\n\x0b\f\r"
#: Words that may stand before a declared name besides user types.
TYPE_WORDS = "char const double enum float int long register short signed static struct union unsigned void volatile".split()
DECLARATION_ENDS = ["=", ";", ",", ")", "["]


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def has_inner_blank(name: Column) -> Column:
    """P7."""
    return F.contains(stripped(name), F.lit(" "))


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def is_valid_name(name: Column, lang: str) -> Column:
    """P8 / P9 for one known language: a column predicate that needs no join."""
    if lang not in NAME_RULE_LANGUAGES:
        return F.lit(False)
    return is_identifier(name) & ~name.isin(reserved_words(lang))


def filter_valid_names(df: DataFrame, name: str = "name", lang: str = "lang") -> DataFrame:
    """P7 + P8 where the language is a column: identifier form, and no reserved word of that language."""
    reserved = (
        reserved_table(df.sparkSession)
        .where(F.col("kind") != "operator")
        .select(F.col("lang").alias(lang), F.col("word").alias(name))
        .distinct()
    )
    return (
        df.where(F.col(lang).isin(*NAME_RULE_LANGUAGES) & ~has_inner_blank(F.col(name)) & is_identifier(F.col(name)))
        .join(F.broadcast(reserved), [lang, name], "left_anti")
    )


def is_uid(text: Column, compat: bool = False) -> Column:
    """P10: a plain ASCII identifier of the C rule set. ``compat`` leaves the last character unchecked."""
    word = stripped(text)
    form = r"""^[A-Za-z_](?:[0-9A-Za-z_]*[^'" \n\r])?\z""" if compat else r"^[A-Za-z_][0-9A-Za-z_]*\z"
    return word.rlike(form) & ~word.isin(reserved_words("c", with_operators=True))


def identifiers(tokens: Column, lang: str, mode: str = "all") -> Column:
    """Names of a sample in first-seen order.

    ``all`` takes every valid word. ``declared`` takes words that follow a type word, another word or ``*``
    and stand before one of ``= ; , ) [``.
    """
    if mode == "all":
        return F.filter(F.array_distinct(tokens), lambda t: is_valid_name(t, lang))
    not_a_type = [w for w in reserved_words(lang) if w not in TYPE_WORDS]

    def declared(token: Column, i: Column) -> Column:
        before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
        type_before = (before == "*") | (is_identifier(before) & ~before.isin(not_a_type))
        keep = is_valid_name(token, lang) & type_before & after.isin(DECLARATION_ENDS)
        return F.when((i > 0) & keep, token)

    return F.array_distinct(F.filter(F.transform(tokens, declared), lambda t: t.isNotNull()))
