"""Lexical column functions. Everything stays inside the JVM: one regex pass per text, then array functions.

Loops inside the patterns are possessive, so that a very long literal or comment costs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r" \t\n\r\f\x0B"
WORD = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*+"
NUMBER = r"\p{Nd}[\p{L}\p{N}_.]*+"
OPERATOR = r"\.\.\.|>>=|<<=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]="
COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
LINE_STRING = r'"(?:[^"\\\n]++|\\[^\n])*+"' + r"|'(?:[^'\\\n]++|\\[^\n])*+'"

TOKEN = f"{COMMENT}|{LINE_STRING}|{WORD}|{NUMBER}|{OPERATOR}|[^{BLANK}]"
PY_COMMENT = r"#[^\n]*+"
PY_OPERATOR = r"\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|->|:=|<<|>>|<=|>=|==|!=|[-+*/%&|^@]="

C_SEGMENT = (
    rf"{COMMENT}|'(?:[^\\']++|\\[\s\S])*+'" + r'|"(?:[^\\"]++|\\[\s\S])*+"' + r"""|[^/'"]++|[\s\S]"""
)
_TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
PY_TOKEN = f"{PY_COMMENT}|{_TRIPLE}|{LINE_STRING}|{WORD}|{NUMBER}|{PY_OPERATOR}|[^{BLANK}]"
PY_SEGMENT = rf"\n[ \t]*+(?:{_TRIPLE}|{LINE_STRING})|{_TRIPLE}|{LINE_STRING}|#[^\n]*+|" + r"""[^\n#"']++|[\s\S]"""

PIECE = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+|_|\p{L}"


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_pattern(lang: str) -> str:
    """Tokens and comments of a language: Python has its own rules, all others the C rules."""
    return PY_TOKEN if lang == "python" else TOKEN


def is_comment(segment: Column, lang: str = "c") -> Column:
    return segment.startswith("#") if lang == "python" else segment.startswith("//") | segment.startswith("/*")


def drop_blank_lines(text: Column) -> Column:
    """Lines holding only blanks are removed."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]")), "\n")


def strip_comments(text: Column, lang: str) -> Column:
    """Remove comments (and, for Python, strings that stand alone), then blank lines.

    C family: a comment becomes one blank; literals are kept whole even if they look like comments.
    Python: a comment vanishes; a string that opens its line is dropped.
    """
    if lang == "ruby":
        return text
    if lang == "python":
        parts = F.transform(
            extract_all(F.concat(F.lit("\n"), text), PY_SEGMENT),
            lambda s: F.when(s.startswith("#"), F.lit(""))
            .when(s.rlike("^\n[ \t]*[\"']"), F.lit("\n"))
            .otherwise(s),
        )
    else:
        parts = F.transform(extract_all(text, C_SEGMENT), lambda s: F.when(is_comment(s), F.lit(" ")).otherwise(s))
    return drop_blank_lines(F.array_join(parts, ""))


def unescape_newlines(text: Column) -> Column:
    """T4: a written backslash-n becomes a line break. Opt-in, since it also changes string literals."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def line_tokens(text: Column) -> Column:
    """T5: non-empty lines, each with a written line-end mark."""
    return F.transform(F.filter(F.split(text, "\n"), lambda line: line != ""), lambda line: F.concat(line, F.lit("\\n")))


def tokenize(text: Column, lang: str = "c") -> Column:
    """Lexical tokens in order; comments are left out, literals stay whole."""
    return F.filter(extract_all(text, token_pattern(lang)), lambda t: ~is_comment(t, lang))


def tokenize_with_newlines(text: Column, lang: str = "c") -> Column:
    """T6 plus a token per line break, for statement boundaries."""
    return F.filter(extract_all(text, rf"\n|{token_pattern(lang)}"), lambda t: ~is_comment(t, lang))


def segments(text: Column, lang: str = "c") -> Column:
    """The whole text cut into tokens, comments and blanks."""
    return extract_all(text, rf"{token_pattern(lang)}|[{BLANK}]++")


def span_text(text: Column, start_line: Column, start: Column, end_line: Column, end: Column) -> Column:
    """Text between two (line, column) points, 0-based, end exclusive; lines are joined without a break."""
    lines = F.split(text, "\n")
    first = F.get(lines, start_line)
    middle = F.slice(lines, start_line + 2, F.greatest(end_line - start_line - 1, F.lit(0)))
    return F.when(start_line == end_line, F.substring(first, start + 1, end - start)).otherwise(
        F.concat(
            F.substring(first, start + 1, F.length(first)),
            F.array_join(middle, ""),
            F.substring(F.get(lines, end_line), F.lit(1), end),
        )
    )


def pieces(word: Column) -> Column:
    """Sub-word pieces: case and digit runs, underscores, single other letters."""
    return extract_all(word, PIECE)


def truncate(tokens: Column, block_size: int) -> Column:
    """What fits into the model window."""
    return F.slice(tokens, 1, block_size)


def first_seen_distinct(values: Column) -> Column:
    """Distinct values, first occurrence kept, order kept."""
    return F.array_distinct(values)


def count_substring(text: Column, name: Column) -> Column:
    """T17 (compat): non-overlapping occurrences of ``name`` anywhere in the text."""
    return F.when(
        F.length(name) > 0, ((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("long")
    ).otherwise(F.length(text) + F.lit(1).cast("long"))


def count_token(tokens: Column, name: Column) -> Column:
    """Whole-token occurrences."""
    return F.size(F.filter(tokens, lambda t: t == name)).cast("long")
