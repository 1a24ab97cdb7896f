"""Search-term functions (X1-X3, X8), all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_terms(search: Column) -> Column:
    """Split a search on single spaces the way Java's String.split(" ") does.

    Trailing empty strings are dropped (so a search of only spaces has no
    terms), leading and inner empties are kept, duplicates removed.
    NULL stays NULL (no search).
    """
    stripped = F.regexp_replace(search, " +$", "")
    return (F.when(search.isNull(), F.lit(None).cast("array<string>"))
            .when(search.rlike("^ +$"), F.array().cast("array<string>"))
            .otherwise(F.array_distinct(F.split(stripped, " "))))


def strip_spaces(c: Column) -> Column:
    """Remove every space."""
    return F.replace(c, F.lit(" "), F.lit(""))


def contains_all(text: Column, terms: Column) -> Column:
    """Every term is a case-sensitive substring of the space-free text (X3; '' always matches)."""
    return F.forall(terms, lambda t: F.coalesce(F.contains(strip_spaces(text), t), F.lit(False)))


def name_matches(item_id: Column, terms: Column) -> Column:
    """all terms in the id; an empty term fails the item."""
    return contains_all(item_id, terms) & ~F.coalesce(F.array_contains(terms, F.lit("")), F.lit(False))


def any_name_matches(names: Column, terms: Column) -> Column:
    """one name of the list holds all terms (false for an empty list).

    A NULL name fails its own entry only (X8).
    """
    return F.exists(F.coalesce(names, F.array().cast("array<string>")),
                    lambda c: F.coalesce(contains_all(c, terms), F.lit(False)))
