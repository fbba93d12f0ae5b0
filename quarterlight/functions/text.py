"""Labels, tokens and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(x: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(x: Column) -> Column:
    """Upper-case alphanumeric tokens."""
    return F.array_remove(F.split(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+"), "")


def tokens_with_prefix(x: Column, prefixes: list[str]) -> Column:
    starts = lambda t: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: t.startswith(p))
    return F.filter(tokens(x), starts)


def german_number(x: Column) -> Column:
    """1.234,5 -> 1234.5; dashes, blanks and other text are null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(x), "\\.", ""), ",", ".")
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("double"))


def quantile_label(tau: float) -> str:
    return f"q{tau:.3f}"
