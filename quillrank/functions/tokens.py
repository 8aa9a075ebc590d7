"""Text and query tokens as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates tokens: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """The tokens of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda t: t != "")


def first_token(line: Column) -> Column:
    """The first token of a line, empty if it has none."""
    return F.coalesce(F.try_element_at(tokens(line), F.lit(1)), F.lit(""))


def is_negated(token: Column) -> Column:
    return F.startswith(token, F.lit("-"))


def bare(token: Column) -> Column:
    """The token without one leading minus sign."""
    return F.when(is_negated(token), F.substring(token, 2, 1 << 30)).otherwise(token)


def term_bucket(term: Column, buckets: int = 6_000_000, short: int = 15) -> Column:
    """A dictionary bucket: terms longer than `short` use the upper half."""
    half = buckets // 2
    return F.pmod(F.xxhash64(term), F.lit(half)) + F.when(F.length(term) > short, F.lit(half)).otherwise(F.lit(0))
