"""A q-gram index over names, for searches whose terms must occur in a name.

``name_index`` lists, per kind of item, the names that hold each run of q
characters: a cosmetic's name is its id, a content's names are the cosmetics it
mentions; every distinct name is indexed once. A request with a term of q
characters or more probes one posting list, that of the rarest gram of all its
terms (a name that holds the terms holds every gram of them); the exact rule then
decides on the names found, and names lead to items by an equi-join. So a
search costs its posting list and not the item table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.config import CONTENT, COSMETIC
from affinity.functions.text import contains_all, strip_spaces

_NO_TEXTS = "array<string>"


def grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters of a text; none of a shorter or null one."""
    n = F.char_length(text)
    runs = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(n >= q, F.array_distinct(runs)).otherwise(F.array().cast(_NO_TEXTS))


def named_items(items: DataFrame) -> DataFrame:
    """The item side with a row per item and name: adds _kind and _name. Null names are none."""
    cosmetics = items.filter(F.col("i_item_type") == COSMETIC).withColumn("_name", F.col("i_item_id"))
    contents = items.filter(F.col("i_item_type") == CONTENT).withColumn("_name", F.explode(F.array_distinct("i_cosmetics")))
    return cosmetics.unionByName(contents).withColumn("_kind", F.col("i_item_type")).filter("_name IS NOT NULL")


def found_by_name(items: DataFrame) -> DataFrame:
    """``named_items`` with ``i_cosmetics`` cut, for contents, to the names below the row's own in code point order.

    A list with n names would else travel n times; the row's name and those below it are
    what decides whether the row is the one at which its content counts.
    """
    below = F.filter("i_cosmetics", lambda c: c < F.col("_name"))
    return named_items(items).withColumn("i_cosmetics", F.when(F.col("_kind") == CONTENT, below).otherwise(F.col("i_cosmetics")))


def name_index(items: DataFrame, q: int) -> DataFrame:
    """(_kind, _gram, _name): the posting lists of all distinct names."""
    names = named_items(items).select("_kind", "_name").distinct()
    return names.select("_kind", F.explode(grams(strip_spaces(F.col("_name")), q)).alias("_gram"), "_name")


def has_long_term(terms: Column, q: int) -> Column:
    return F.exists(F.coalesce(terms, F.array().cast(_NO_TEXTS)), lambda t: F.char_length(t) >= q)


def probes(searches: DataFrame, index: DataFrame, key: str, q: int) -> DataFrame:
    """(key, _kind, _gram): each search's rarest gram; searches with a gram that no name holds have none."""
    asked = searches.select(key, F.col("item_type").alias("_kind"),
                            F.explode(F.array_distinct(F.flatten(F.transform("terms", lambda t: grams(t, q))))).alias("_gram"))
    lists = (index.join(asked.select("_kind", "_gram").distinct(), ["_kind", "_gram"], "left_semi")
             .groupBy("_kind", "_gram").agg(F.count(F.lit(1)).alias("_n")))
    return (asked.join(lists, ["_kind", "_gram"], "left")
            .groupBy(key, "_kind").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
            .filter("_least.n > 0").select(key, "_kind", F.col("_least.gram").alias("_gram")))


def search_pairs(searches: DataFrame, items: DataFrame, predicate: Column, key: str, q: int, index: DataFrame | None = None) -> DataFrame:
    """(search, item) pairs that satisfy ``predicate``, each once; every search has a term of q characters or more.

    ``index`` is a stored ``name_index`` of the same items; without it the lists are made anew.
    """
    index = name_index(items, q) if index is None else index
    found = (searches.join(probes(searches, index, key, q), key).join(index, ["_kind", "_gram"])
             .filter(contains_all(F.col("_name"), F.col("terms"))))
    # a content whose names match more than once counts at the least of them
    earlier = F.exists("i_cosmetics", lambda c: contains_all(c, F.col("terms")))
    once = (F.col("i_item_type") == COSMETIC) | ~earlier
    met = found.join(found_by_name(items), ["_kind", "_name"]).filter(once)
    # the name met is all that the predicate needs of a content's list
    met = met.withColumn("i_cosmetics", F.when(F.col("_kind") == CONTENT, F.array("_name")).otherwise(F.col("i_cosmetics")))
    return met.filter(predicate).drop("_kind", "_name", "_gram")
