"""Complexity and duplication of source text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = ["if", "elif", "elsif", "unless", "for", "foreach", "while", "until", "do", "switch", "case", "catch", "except", "rescue", "select", "and", "or"]
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_ELSE_IF = f"{_L}else\\s+if{_R}"
#: Tokens of which no two overlap, so that one scan counts them all. A run of question marks is one.
_APART = "|".join([f"{_L}(?:{'|'.join(_WORDS)}){_R}", "&&", "\\|\\|", "\\?(?!\\?)", "=>"])
#: Every token adds one; ``else if`` counts on top of its ``if``.
TOKENS = [_ELSE_IF, _APART]

#: Comments, and literals by quote character. Possessive groups are loops in Java's engine, where
#: others recurse once per character and overflow the stack on long literals.
_STRIP = (
    "//[^\\n]*+|#[^\\n]*+|/\\*[\\s\\S]*?(?:\\*/|\\z)"
    '|(")(?:""[\\s\\S]*?(?:"{3}|\\z)|(?:[^"\\\\]++|\\\\[\\s\\S]|\\\\\\z)*+(?:"|\\z))'
    "|(')(?:''[\\s\\S]*?(?:'{3}|\\z)|(?:[^'\\\\]++|\\\\[\\s\\S]|\\\\\\z)*+(?:'|\\z))"
    "|(`)(?:[^`\\\\]++|\\\\[\\s\\S]|\\\\\\z)*+(?:`|\\z)"
)


def strip_strings_and_comments(code: Column) -> Column:
    """Code without comments, with every string literal emptied, in one scan."""
    return F.regexp_replace(code, _STRIP, "$1$1$2$2$3$3")


def complexity_tokens(code: Column) -> Column:
    # few texts have an else, which is cheap to tell
    branches = F.when(code.contains("else"), F.regexp_count(code, F.lit(_ELSE_IF))).otherwise(F.when(code.isNotNull(), 0))
    return F.regexp_count(code, F.lit(_APART)) + branches


def cyclomatic_complexity(code: Column) -> Column:
    return F.lit(1) + complexity_tokens(strip_strings_and_comments(code))


def significant_lines(content: Column) -> Column:
    trimmed = F.transform(F.split(content, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.filter(trimmed, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#") & ~x.startswith("*"))


def line_chunks(content: Column, window: int = 5, least: int = 50) -> Column:
    """Distinct windows of consecutive significant lines that are long enough."""
    lines = significant_lines(content)
    starts = F.when(F.size(lines) >= window, F.sequence(F.lit(1), F.size(lines) - window + 1)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(lines, i, window), "\n"))
    return F.array_distinct(F.filter(chunks, lambda c: F.length(c) >= least))


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"))) + 1
