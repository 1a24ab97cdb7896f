"""Candidate items per request: predicates F4-F15, black lists F16-F18, pair join J6.

Requests and items meet in ``candidate_pairs`` by the most selective key that a
request has, and the whole predicate is evaluated inside the join:

* a white list: exploded and equi-joined on ``item_id``;
* a brand: equi-joined on (``item_type``, ``brand``);
* a related cosmetic: equi-joined with the contents' mentions;
* a search with a term of ``Params.gram_size`` characters or more: one posting
  list of the q-gram index over names (``operators/name_index.py``);
* categories: equi-joined on (``item_type``, category), each pair at the least
  category that both sides share;
* all else (no filter, or terms shorter than a gram): joined on ``item_type`` -- a
  key with two or three values, i.e. maximally skewed. The request side is
  broadcast when its row count is below ``Params.broadcast_rows`` (items stream,
  no shuffle); above it the item side is salted over ``salt_buckets`` and the
  requests replicated per salt, so no single task holds a whole item kind.

Callers then cut to a bounded top-k per request before any further shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.config import CONTENT, COSMETIC, UNAVAILABLE_ENTITY_ID, Params
from affinity.functions.text import any_name_matches, name_matches, search_terms
from affinity.operators.name_index import has_long_term, name_index, search_pairs
from affinity.operators.overlap import split_equi_join, tasks
from affinity.session import stage

# request columns carried through candidate generation
REQUEST_COLS = ["request_id", "user_id", "num", "item_type", "search", "result_type", "cosmetic",
                "brand", "categories", "white_list", "black_list"]
ITEM_COLS = ["item_id", "item_type", "categories", "brand", "cosmetics"]


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Add ``terms`` (X1) to a request table."""
    return requests.withColumn("terms", search_terms(F.col("search")))


def item_side(items: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Items with ``i_`` prefixed attributes so they never clash with request columns."""
    cols = [F.col(c).alias("i_" + c) for c in ITEM_COLS] + [F.col(c) for c in extra]
    return items.select(*cols)


# ---- predicates over a (request, item) row --------------------------------

def _type_ok() -> Column:
    return F.col("i_item_type") == F.col("item_type")


def _brand_ok() -> Column:
    """no brand asked -> pass; else equal brand; a brandless item fails."""
    return F.col("brand").isNull() | F.coalesce(F.col("brand") == F.col("i_brand"), F.lit(False))


def _white_ok() -> Column:
    """no list -> pass; else the id is listed."""
    return F.col("white_list").isNull() | F.coalesce(F.array_contains("white_list", F.col("i_item_id")),
                                                     F.lit(False))


def _black_ok() -> Column:
    """the id is not in the request's own black list."""
    return F.col("black_list").isNull() | ~F.coalesce(F.array_contains("black_list", F.col("i_item_id")),
                                                      F.lit(False))


def _categories_ok() -> Column:
    """F8: no categories asked -> pass; an item without categories fails; else any overlap."""
    return F.col("categories").isNull() | F.coalesce(F.arrays_overlap("categories", "i_categories"),
                                                     F.lit(False))


def _related_ok() -> Column:
    """the content mentions the requested cosmetic (NULL list = empty, Q4)."""
    return F.coalesce(F.array_contains("i_cosmetics", F.col("cosmetic")), F.lit(False))


def factor_search_ok() -> Column:
    """F9 + F11 + F13 as the factor scorers apply them (search absent = no terms)."""
    terms = F.coalesce(F.col("terms"), F.array().cast("array<string>"))
    cos = name_matches(F.col("i_item_id"), terms)
    con = F.when(F.col("cosmetic").isNotNull(), _related_ok()).otherwise(any_name_matches(F.col("i_cosmetics"), terms))
    return (F.when(F.col("i_item_type") == COSMETIC, cos)
            .when(F.col("i_item_type") == CONTENT, con).otherwise(F.lit(True)))


def overlap_search_ok() -> Column:
    """F10 + F12 + F13 as the overlap scorer applies them (search absent = pass)."""
    terms = F.col("terms")
    cos = F.when(terms.isNull(), F.lit(True)).otherwise(name_matches(F.col("i_item_id"), terms))
    con = (F.when(F.col("cosmetic").isNotNull(), _related_ok())
           .when(terms.isNull(), F.lit(True))
           .otherwise(any_name_matches(F.col("i_cosmetics"), terms)))
    return (F.when(F.col("i_item_type") == COSMETIC, cos)
            .when(F.col("i_item_type") == CONTENT, con).otherwise(F.lit(True)))


def factor_predicate() -> Column:
    """Everything but the seen/unavailable black list (applied by anti join)."""
    return (_type_ok() & factor_search_ok() & _brand_ok() & _white_ok() & _black_ok() & _categories_ok())


def overlap_predicate() -> Column:
    return (_type_ok() & overlap_search_ok() & _brand_ok() & _white_ok() & _black_ok() & _categories_ok())


# ---- the pair join -------------------------------------------------------

#: How a request meets its items, the most selective key first.
PATHS = ("white", "brand", "mention", "name", "category", "type")


def request_path(params: Params = Params()) -> Column:
    """The key by which a request (or signature) meets items, one of ``PATHS``."""
    t = F.col("item_type")
    return (F.when(F.col("white_list").isNotNull(), "white")
            .when(F.col("brand").isNotNull(), "brand")
            .when((t == CONTENT) & F.col("cosmetic").isNotNull(), "mention")
            .when(t.isin(CONTENT, COSMETIC) & has_long_term(F.col("terms"), params.gram_size), "name")
            .when(F.col("categories").isNotNull(), "category")
            .otherwise("type"))


def _bounded_rows(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (counted on the executors, stops at limit + 1)."""
    return df.limit(limit + 1).count() <= limit


def candidate_pairs(left: DataFrame, items: DataFrame, predicate: Column, params: Params = Params(),
                    left_rows: int | None = None, paths: Mapping[str, int] | frozenset[str] | None = None,
                    index: DataFrame | None = None) -> DataFrame:
    """(left row, item) pairs satisfying ``predicate``, each once.

    ``left`` carries the request filter columns (item_type, terms, white_list,
    ...) and a unique ``sig`` or ``request_id``; ``items`` comes from
    ``item_side``. ``left_rows`` is a known upper bound of ``left``'s row count;
    without it the count is probed (one small job). ``paths`` names the paths that
    occur at all (default: any); as a mapping it bounds the rows of each, and few rows
    of a brand, category or type are broadcast, so that no item is shuffled.
    ``index`` is a stored ``name_index`` of ``items``. On the paths of a mention and, for
    contents, of a name, ``i_cosmetics`` is the one name that the pair met by.
    """
    key = "sig" if "sig" in left.columns else "request_id"
    path = request_path(params)
    of = lambda name: left.filter(path == name)
    same_type = F.col("i_item_type") == F.col("item_type")

    bounds = paths if isinstance(paths, Mapping) else {}
    few = lambda name: name in bounds and bounds[name] <= params.broadcast_rows
    beside = lambda name, df: F.broadcast(df) if few(name) else df

    def by_type(open_: DataFrame) -> DataFrame:
        small = few("type") if "type" in bounds else left_rows <= params.broadcast_rows if left_rows is not None else _bounded_rows(open_, params.broadcast_rows)
        if small:
            return items.join(F.broadcast(open_), same_type & predicate, "inner")
        # at least a bucket per shuffle task, so the work spreads over any cluster
        n = max(params.salt_buckets, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted_items = items.withColumn("_isalt", F.pmod(F.xxhash64("i_item_id"), F.lit(n)))
        fanned = open_.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return salted_items.join(fanned, same_type & (F.col("_isalt") == F.col("_rsalt")) & predicate, "inner")

    def by_category(asking: DataFrame) -> DataFrame:
        """An item that shares several categories counts at the least of them."""
        asked = asking.withColumn("_asked", F.explode(F.array_distinct("categories")))
        held = items.withColumn("_held", F.explode(F.array_distinct("i_categories")))
        once = F.array_min(F.array_intersect("categories", "i_categories")) == F.col("_asked")
        return held.join(beside("category", asked), same_type & (F.col("_held") == F.col("_asked")) & once & predicate, "inner")

    def by_mention(asking: DataFrame) -> DataFrame:
        named = items.filter(F.col("i_item_type") == CONTENT).withColumn("_named", F.explode(F.array_distinct("i_cosmetics")))
        # the name met is all that the predicate needs of the list: lists do not travel with each of their names
        met = named.drop("i_cosmetics").join(asking, same_type & (F.col("_named") == F.col("cosmetic")), "inner")
        return met.withColumn("i_cosmetics", F.array("_named")).filter(predicate)

    ways = {
        "white": lambda df: df.withColumn("_wid", F.explode(F.array_distinct("white_list")))
        .join(items, F.col("_wid") == F.col("i_item_id"), "inner").filter(predicate),
        "brand": lambda df: items.join(beside("brand", df), same_type & (F.col("i_brand") == F.col("brand")) & predicate, "inner"),
        "mention": by_mention,
        "name": lambda df: search_pairs(df, items, predicate, key, params.gram_size, index),
        "category": by_category,
        "type": by_type,
    }
    columns = [*left.columns, *items.columns]
    out = None
    for name in PATHS:
        if paths is None or name in paths:
            pairs = ways[name](of(name)).select(*columns)
            out = pairs if out is None else out.unionByName(pairs)
    return left.limit(0).join(items.limit(0), same_type).select(*columns) if out is None else out


#: Columns that a request's candidates follow from, its own black list aside.
SIG_FILTERS = ["item_type", "search", "terms", "cosmetic", "brand", "categories", "white_list"]
#: Item kinds that are worth a filter on the item table.
KINDS = 16


def signature(df: DataFrame) -> Column:
    """A digest of a request's filters (sets sorted, black list excluded): a key of fixed size."""
    return F.base64(F.unhex(F.sha2(F.to_json(F.struct(
        F.col("item_type"), F.col("search"), F.col("cosmetic"), F.col("brand"),
        F.array_sort(F.array_distinct("categories")).alias("categories"),
        F.array_sort(F.array_distinct("white_list")).alias("white_list"))), 256)))


def request_candidates(requests: DataFrame, items: DataFrame, predicate: Column, params: Params = Params()) -> DataFrame:
    """(request_id, i_item_id): the candidates of every request, each (request row, item row) once.

    The predicate runs once per distinct filter signature and item; requests meet
    their signature's candidates by a plain join, laid out as a grid where many
    requests share many candidates, and own black lists are applied there.
    ``items`` comes from ``item_side``; kinds that no request asks for are left out.
    """
    reqs = stage(requests.select(signature(requests).alias("sig"), "request_id", "black_list", *SIG_FILTERS), "candidate_requests")
    paths = {r["path"]: r["n"] for r in reqs.groupBy(request_path(params).alias("path")).agg(F.count_distinct("sig").alias("n")).collect()}
    kinds = [r["item_type"] for r in reqs.select("item_type").distinct().limit(KINDS + 1).collect()]
    if len(kinds) <= KINDS:
        items = items.filter(F.col("i_item_type").isin(*[k for k in kinds if k is not None]))
    # read by each path, and twice by the index
    items = stage(items, "candidate_items")
    index = stage(name_index(items, params.gram_size), "name_index") if "name" in paths else None
    sigs = (reqs.groupBy("sig").agg(*[F.first(c).alias(c) for c in SIG_FILTERS])
            .withColumn("black_list", F.lit(None).cast("array<string>")))
    found = stage(candidate_pairs(sigs, items, predicate, params, sum(paths.values()), paths, index).select("sig", "i_item_id"),
                  "signature_candidates")
    pairs = split_equi_join(reqs.select("sig", "request_id", "black_list"), found, "sig", "request_id", "i_item_id", params.hot_key_pairs,
                            tasks(reqs))
    return pairs.filter(_black_ok()).select("request_id", "i_item_id")


# ---- black lists ---------------------------------------------------------

def request_black_rows(requests: DataFrame) -> DataFrame:
    """F7 as rows: (request_id, item_id) of each request's own black list."""
    return requests.select("request_id", F.explode(F.array_distinct("black_list")).alias("item_id"))


def seen_black_rows(requests: DataFrame, seen: DataFrame) -> DataFrame:
    """F16 per request: the user's seen items."""
    return requests.select("request_id", "user_id").join(seen, "user_id", "inner").select("request_id", "item_id")


def full_black_rows(requests: DataFrame, seen: DataFrame, unavailable: DataFrame | None = None,
                    hot_key_pairs: int = Params.hot_key_pairs) -> DataFrame:
    """own black list, seen items and, where given, the unavailable items of every request.

    The scorers leave ``unavailable`` out here and take those items out of the
    item table once, which gives the same answers without a row per request and item.
    """
    rows = request_black_rows(requests).unionByName(seen_black_rows(requests, seen)).distinct()
    if unavailable is None:
        return rows
    # both sides are distinct, so a row per request and item needs no shuffle of its own;
    # what they share is left to the unavailable side
    every = F.lit(UNAVAILABLE_ENTITY_ID).alias("_list")
    gone, asking = unavailable.select("item_id").distinct(), requests.select("request_id").distinct()
    rest = rows.join(gone.select(F.col("item_id").alias("_gone")), F.col("item_id").eqNullSafe(F.col("_gone")), "left_anti")
    crossed = split_equi_join(asking.select("request_id", every), gone.select("item_id", every), "_list", "request_id", "item_id",
                              hot_key_pairs, tasks(requests))
    return rest.unionByName(crossed.select("request_id", "item_id"))


def black_counts(black_rows: DataFrame) -> DataFrame:
    return black_rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_black"))
