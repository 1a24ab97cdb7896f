"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each reads the driver's tables through the fixture adapter and runs the
library operator over the whole tables. Output columns are long form and
aliased exactly like the DuckDB oracle in ``affinity.oracle``; vector-based
scores are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.config import Params
from affinity.functions import text as tx
from affinity.operators import candidates as cd
from affinity.operators import entities as en
from affinity.operators import events as ev
from affinity.operators import overlap as ov
from affinity.operators import weights as wt
from affinity.plans import model as md
from affinity.plans import scoring as sc
from affinity.plans.overlap_scorer import overlap_batch, score_overlap_batch, scored_users
from affinity.plans.serve import engine_scorers, nested_results, serve, write_results
from affinity.session import checkpoint_dir, stage
from affinity.sources import events as src
from affinity.sources.fixtures import Tables, load

P = Params()
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _data(t: Tables) -> md.TrainingData:
    return md.TrainingData(t.users, t.items, t.log, t.property_log.unionByName(t.constraint_log))


def _stats(t: Tables):
    return wt.pair_stats(md.valid_training_log(_data(t), P), P)


def _given_model(t: Tables, tables=md.TABLES) -> md.Model:
    """The model with the given vectors (embeddings) instead of ALS factors;
    ``tables`` are staged, the rest stay lazy."""
    return md.materialize(md.train(_data(t), P, user_factors=t.user_vectors, item_factors=t.item_vectors), tables)


FACTOR_TABLES = ("user_factors", "item_model")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("request_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("request_id", F.col("i_item_id").alias("item_id"))


# ---- sources, projections, filters --------------------------------------

@register("users_view")
def q_users_view(spark, sf_dir):
    t = load(spark, sf_dir)
    return en.users_view(en.property_fold(t.property_log, "user"))


@register("items_view")
def q_items_view(spark, sf_dir):
    """U1 over P2 and P3: the item table folded from property events."""
    return _items_text(en.items_from_properties(load(spark, sf_dir).entity_log))


def _items_text(items: DataFrame) -> DataFrame:
    return items.select("item_id", "item_type", F.array_join(F.array_sort("categories"), "|").alias("categories_text"),
                        "brand", F.size("cosmetics").alias("n_cosmetics").cast("int"), "upload_date") \
        .withColumn("n_cosmetics", F.when(F.col("n_cosmetics") >= 0, F.col("n_cosmetics")))


@register("events_view_play_own_rate_scrap")
def q_events_view(spark, sf_dir):
    t = load(spark, sf_dir)
    typed = ev.typed_events(t.log, P)
    cols = lambda kind, df: df.select(
        F.lit(kind).alias("kind"), "user_id", "item_id", ev.epoch_millis("ts").alias("ts_ms"), "event_id",
        (F.col("rating") if kind == "rate" else F.lit(None).cast("double")).alias("rating"),
        (F.col("scrap") if kind == "scrap" else F.lit(None).cast("boolean")).alias("scrap"))
    out = None
    for kind in ("play", "own", "rate", "view", "scrap"):
        part = cols(kind, typed[kind])
        out = part if out is None else out.unionByName(part)
    return out


@register("property_fold")
def q_property_fold(spark, sf_dir):
    t = load(spark, sf_dir)
    f = en.property_fold(t.property_log, "user")
    return f.select("entity_id", F.col("properties")["a"].alias("prop_a"), F.col("properties")["b"].alias("prop_b"))


@register("property_fold_incremental")
def q_property_fold_incremental(spark, sf_dir):
    """A1 from a snapshot of the earlier half of the time span and the events since."""
    log = load(spark, sf_dir).property_log
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = log.agg(((F.min(at) + F.max(at)) / 2).cast("long")).first()[0] or 0
    earlier = F.coalesce(at <= cut, F.lit(False))
    snapshot = en.fold_state(log.filter(earlier), "user").staged()
    f = en.fold_properties(en.merge_fold_states(snapshot, en.fold_state(log.filter(~earlier), "user")))
    return f.select("entity_id", F.col("properties")["a"].alias("prop_a"), F.col("properties")["b"].alias("prop_b"))


@register("valid_events")
def q_valid_events(spark, sf_dir):
    t = load(spark, sf_dir)
    known = md.TrainingData(t.registered_users, t.registered_items, t.log)
    return md.valid_training_log(known, P).select("event", "user_id", "item_id", "event_id")


@register("orphan_events")
def q_orphan_events(spark, sf_dir):
    t = load(spark, sf_dir)
    o = ev.orphan_events(ev.training_log(t.log, P), t.registered_users, t.registered_items)
    return o.select("event_id", "event", "user_id", "item_id", "missing")


# ---- aggregations -------------------------------------------------------

def _part_query(part):
    def q(spark, sf_dir):
        return wt.affinity_part(_stats(load(spark, sf_dir)), part, P)
    return q


for _name, _part in [("affinity_view", "view"), ("affinity_play", "play"), ("affinity_own", "own"),
                     ("affinity_rate_latest", "rate"), ("affinity_scrap_latest", "scrap"),
                     ("affinity_rate_own", "rate_own")]:
    register(_name)(_part_query(_part))


@register("affinity_total")
def q_affinity_total(spark, sf_dir):
    return wt.affinity_from_stats(_stats(load(spark, sf_dir)), P)


@register("popularity_parts")
def q_popularity_parts(spark, sf_dir):
    return wt.popularity_parts(_stats(load(spark, sf_dir)), P)


@register("popularity_total")
def q_popularity_total(spark, sf_dir):
    return wt.popularity_from_stats(_stats(load(spark, sf_dir)), P)


# ---- black lists, recent items -------------------------------------------

@register("seen_items")
def q_seen(spark, sf_dir):
    return ev.seen_items(load(spark, sf_dir).log, P)


@register("recent_items")
def q_recent(spark, sf_dir):
    return ev.recent_items(load(spark, sf_dir).log, P)


@register("unavailable_items")
def q_unavailable(spark, sf_dir):
    return ev.unavailable_items(load(spark, sf_dir).constraint_log)


@register("blacklist_full")
def q_blacklist_full(spark, sf_dir):
    t = load(spark, sf_dir)
    reqs = t.requests
    return cd.full_black_rows(reqs, ev.seen_items(t.log, P), ev.unavailable_items(t.constraint_log))


# ---- candidate predicates -----------------------------------------------

@register("search_terms")
def q_search_terms(spark, sf_dir):
    """X1 for the request table and for every part name as a search text (with blanks at its end)."""
    t = load(spark, sf_dir)
    names = t.raw("part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("request_id"),
                                 F.concat("p_name", F.lit("  ")).alias("search"))
    reqs = cd.prepare_requests(t.requests.select("request_id", "search").unionByName(names))
    return reqs.select("request_id", F.explode("terms").alias("term"))


def _cand_query(kind, asking=None):
    """Candidates of all requests, or of those that ask in one way; without seen and unavailable items."""
    def q(spark, sf_dir):
        t = load(spark, sf_dir)
        reqs = cd.prepare_requests(t.requests)
        if asking is not None:
            reqs = reqs.filter(asking)
        pred = cd.factor_predicate() if kind == "factor" else cd.overlap_predicate()
        return _pairs(cd.request_candidates(reqs, cd.item_side(t.items), pred, P))
    return q


register("candidates_factor")(_cand_query("factor"))
register("candidates_overlap")(_cand_query("overlap"))
register("whitelist_filter")(_cand_query("factor", "white_list IS NOT NULL"))
register("brand_filter")(_cand_query("factor", "brand IS NOT NULL"))
register("category_filter")(_cand_query("factor", "categories IS NOT NULL"))
register("search_cosmetic")(_cand_query("factor", "item_type = 'cosmetic' AND search IS NOT NULL"))
register("search_content_factor")(_cand_query("factor", "item_type = 'content' AND cosmetic IS NULL AND categories IS NULL"))
register("search_content_overlap")(_cand_query("overlap", "item_type = 'content' AND cosmetic IS NULL AND categories IS NULL"))
register("related_cosmetic")(_cand_query("factor", "item_type = 'content' AND cosmetic IS NOT NULL"))


# ---- overlap -------------------------------------------------------------

def _items_staged(t: Tables) -> Tables:
    """The item table written once, where a query reads it several times."""
    t.items = stage(t.items, "items")
    return t


def _own_events(t: Tables) -> DataFrame:
    return md.valid_training_log(_data(t), P).filter(F.col("event") == "own")


@register("owned_set")
def q_owned(spark, sf_dir):
    t = load(spark, sf_dir)
    return ov.owned(_own_events(t))


@register("overlap_score")
def q_overlap(spark, sf_dir):
    t = _items_staged(load(spark, sf_dir))
    return ov.overlap_scores(_own_events(t), t.items, P)


@register("overlap_scorer")
def q_overlap_scorer(spark, sf_dir):
    t = _items_staged(load(spark, sf_dir))
    own = _own_events(t)
    batch = overlap_batch(t.requests, ov.owners(own), params=P)
    return _ranked(score_overlap_batch(batch, t.items, ov.overlap_scores(own, t.items, P, scored_users(batch)), P))


# ---- model and scorers ---------------------------------------------------

@register("item_model")
def q_item_model(spark, sf_dir):
    m = _given_model(load(spark, sf_dir), ("item_model",))
    return m.item_model.select("item_id", "item_type", F.col("features").isNotNull().alias("has_features"),
                               "popularity")


@register("id_dictionary")
def q_id_dictionary(spark, sf_dir):
    aff = wt.affinity_from_stats(_stats(load(spark, sf_dir)), P)
    return md.id_dictionary(aff, "user_id", "uidx")


@register("profile")
def q_profile(spark, sf_dir):
    t = load(spark, sf_dir)
    typed = ev.typed_events(t.log, P)
    return ev.profile({"users": t.users, "items": t.items, **typed})


def _factor_batch(t: Tables, m: md.Model) -> sc.RequestBatch:
    return sc.factor_batch(t.requests, m.user_factors, m.item_model, t.log, P)


def _unavailable(t: Tables) -> DataFrame:
    return sc.stage_unavailable(ev.unavailable_items(t.constraint_log))


def _items(t: Tables, m: md.Model) -> DataFrame:
    return sc.available_items(m.item_model, _unavailable(t), P)


@register("route")
def q_route(spark, sf_dir):
    t = load(spark, sf_dir)
    m = _given_model(t, FACTOR_TABLES)
    return _factor_batch(t, m).reqs.select("request_id", "route")


@register("popular_topn")
def q_popular(spark, sf_dir):
    t = load(spark, sf_dir)
    m = _given_model(t, FACTOR_TABLES)
    return _ranked(sc.score_popular(_factor_batch(t, m), _items(t, m), P))


@register("known_user_topn")
def q_known(spark, sf_dir):
    t = load(spark, sf_dir)
    m = _given_model(t, FACTOR_TABLES)
    return _ranked(sc.score_vectors(_factor_batch(t, m), _items(t, m), "uvec", False, P))


@register("similar_topn")
def q_similar(spark, sf_dir):
    t = load(spark, sf_dir)
    m = _given_model(t, FACTOR_TABLES)
    return _ranked(sc.score_vectors(_factor_batch(t, m), _items(t, m), "qvec", True, P))


@register("recommend_factor")
def q_recommend(spark, sf_dir):
    t = load(spark, sf_dir)
    m = _given_model(t, FACTOR_TABLES)
    return _ranked(sc.recommend_batch(_factor_batch(t, m), m.item_model, _unavailable(t), P))


def _blended(t: Tables, m: md.Model) -> DataFrame:
    return serve(t.requests, engine_scorers(m, t.log, ev.unavailable_items(t.constraint_log), P))


@register("recommend_blended")
def q_blended(spark, sf_dir):
    t = load(spark, sf_dir)
    return _ranked(_blended(t, _given_model(t)))


# ---- results, ALS ----------------------------------------------------------

@register("result_nested")
def q_result_nested(spark, sf_dir):
    t = load(spark, sf_dir)
    nested = nested_results(_blended(t, _given_model(t)))
    return nested.select("request_id", _results_text("itemScores").alias("results"))


def _results_text(scores: str) -> Column:
    """Items with their scores in thousandths, taken from the six decimals that the ranked answers show."""
    line = lambda s: F.concat(s["item"], F.lit("="), F.round(F.round(s["score"], 6) * 1000, 0).cast("long").cast("string"))
    return F.array_join(F.transform(scores, line), "|")


@register("result_sink")
def q_result_sink(spark, sf_dir):
    """Results written as JSON documents, one per request, and read back."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "results")
    write_results(serve(t.requests, {"popular": _popular_scorer(t)}), path)
    back = spark.read.schema("request_id string, itemScores array<struct<item:string,score:double>>").json(path)
    return (back.select("request_id", F.posexplode("itemScores").alias("pos", "s"))
            .select("request_id", F.col("s.item").alias("item_id"), F.round("s.score", 6).alias("score"),
                    (F.col("pos") + 1).cast("int").alias("rank")))


def _popular_scorer(t: Tables, params: Params = P):
    m = _given_model(t, FACTOR_TABLES)
    return lambda reqs: sc.score_popular(sc.factor_batch(reqs, m.user_factors, m.item_model, t.log, params), _items(t, m), params)


def _als(t: Tables):
    aff = wt.affinity_from_stats(_stats(t), P)
    return md.als_factors(aff, P)


@register("als_user_factors")
def q_als_users(spark, sf_dir):
    uf, _ = _als(load(spark, sf_dir))
    return uf.select("user_id", F.size("features").alias("rank"))


@register("als_item_factors")
def q_als_items(spark, sf_dir):
    _, itf = _als(load(spark, sf_dir))
    return itf.select("item_id", F.size("features").alias("rank"))


@register("als_residuals")
def q_als_residuals(spark, sf_dir):
    """Users of the fit, and those whose vector does not solve its normal equations (always 0)."""
    aff = stage(wt.affinity_from_stats(_stats(load(spark, sf_dir)), P), "affinity")
    uf, itf = md.als_factors(aff, P)
    left = md.als_residuals(aff, uf, itf, P)
    return left.agg(F.count("*").alias("users"), F.count_if(F.col("residual") > F.col("scale") * 1e-5).alias("broken"))


@register("als_recommend")
def q_als_recommend(spark, sf_dir):
    """The blend over trained factors: requests answered, and how often an answer breaks a rule (always 0)."""
    t = load(spark, sf_dir)
    answers = stage(_ranked(_blended(t, md.materialize(md.train(_data(t), P)))), "answers")
    reqs = t.requests.select("request_id", "user_id", "num", F.col("item_type").alias("asked"), "black_list")
    found = answers.join(reqs, "request_id").join(t.items.select("item_id", "item_type"), "item_id", "left")
    per_request = answers.groupBy("request_id").agg(F.max("rank").alias("last"), F.count("*").alias("n"),
                                                    F.count_distinct("item_id").alias("items"))
    wrong = lambda c: F.count_if(c)
    rows = found.agg(wrong(~F.coalesce(F.col("item_type") == F.col("asked"), F.lit(False))).alias("wrong_type"),
                     wrong(F.col("rank") > F.col("num")).alias("beyond_num"),
                     wrong(F.coalesce(F.array_contains("black_list", F.col("item_id")), F.lit(False))).alias("black_listed"))
    gaps = per_request.agg(wrong((F.col("last") != F.col("n")) | (F.col("n") != F.col("items"))).alias("gaps"))
    return rows.withColumn("_k", F.lit(1)).join(gaps.withColumn("_k", F.lit(1)), "_k").drop("_k")


# ---- sources and sinks: JSON events, JSON requests, model tables ----------

def _scratch(spark, name: str) -> str:
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:12]}"


@register("events_json_source")
def q_events_json(spark, sf_dir):
    """The interaction log written as JSON event documents, read back and normalised."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "events")
    src.write_events_json(src.log_to_json_events(t.log), path)
    log, _ = src.normalize(src.read_events_json(spark, path))
    return log.select("event_id", "event", "user_id", "target_type", "item_id", "rating",
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@register("property_events_json_source")
def q_property_json(spark, sf_dir):
    """S8 + A1: property events as JSON documents, read back, folded."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "props")
    src.write_events_json(src.property_log_to_json_events(t.property_log), path)
    _, props = src.normalize(src.read_events_json(spark, path))
    f = en.property_fold(props, "user")
    return f.select("entity_id", F.col("properties")["a"].alias("prop_a"), F.col("properties")["b"].alias("prop_b"))


@register("requests_json_source")
def q_requests_json(spark, sf_dir):
    """The request table as JSON objects with the query API's field names, read back."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "requests")
    src.requests_to_json(t.requests.unionByName(t.user_requests())).write.mode("overwrite").json(path)
    r = src.read_requests_json(spark, path)
    text = lambda c: F.array_join(F.array_sort(c), "|")
    return r.select("request_id", "user_id", "num", "item_type", "search", "result_type", "cosmetic", "brand",
                    text("categories").alias("categories_text"), text("white_list").alias("white_text"),
                    text("black_list").alias("black_text"))


@register("requests_json_anonymous")
def q_requests_anonymous(spark, sf_dir):
    """One request document per order without an id, many of them equal; each is a request of its own."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "requests")
    docs = t.raw("orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
                                  F.lit(3).alias("num"), F.col("o_orderpriority").alias("search"))
    docs.write.mode("overwrite").json(path)
    r = src.read_requests_json(spark, path)
    return r.groupBy("user_id", "num", "search").agg(F.count_distinct("request_id").alias("n_requests"))


@register("events_json_mixed")
def q_events_json_mixed(spark, sf_dir):
    """Documents without ids at equal times and events of other entities; equal to the plain log's users' part."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "events")
    docs = src.log_to_json_events(t.log)
    other = docs.withColumn("entityType", F.lit("robot"))
    bare = docs.filter("cast(eventId AS long) % 2 = 0").withColumn("eventId", F.lit(None).cast("string"))
    src.write_events_json(docs.unionByName(other).unionByName(bare), path)
    log, _ = src.normalize(src.read_events_json(spark, path))
    return log.groupBy("event", "user_id", "item_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@register("training_from_events")
def q_training_from_events(spark, sf_dir):
    """S3-S5, P1-P3, U1, Q11 and training: entities and interactions as JSON documents, read, folded, trained."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "training")
    src.write_events_json(src.log_to_json_events(t.log).unionByName(src.property_log_to_json_events(t.entity_log)), path)
    data = md.read_training(*src.normalize(src.read_events_json(spark, path)))
    return wt.affinity_from_stats(wt.pair_stats(md.valid_training_log(data, P), P), P)


# ---- extension points ------------------------------------------------------

@register("score_hook_popular")
def q_score_hook(spark, sf_dir):
    """A hook that prefers the less popular."""
    t = load(spark, sf_dir)
    hooked = replace(P, score_hooks={"popular": lambda s: F.lit(1.0) - s})
    return _ranked(_popular_scorer(t, hooked)(t.requests))


@register("affinity_other_weights")
def q_other_weights(spark, sf_dir):
    """Other weights per event."""
    other = replace(P, view_weight=2.0, play_weight=0.5, own_weight=7.0, scrap_weight=-1.0)
    t = load(spark, sf_dir)
    return wt.affinity_from_stats(wt.pair_stats(md.valid_training_log(_data(t), other), other), other)


@register("similar_events_by_type")
def q_similar_by_type(spark, sf_dir):
    """Requests for cosmetics look at the user's own events on cosmetics only."""
    t = load(spark, sf_dir)
    typed = replace(P, similar_events_by_type={"cosmetic": ("own",)})
    m = _given_model(t, FACTOR_TABLES)
    batch = sc.factor_batch(t.requests, m.user_factors, m.item_model, t.log, typed)
    return _ranked(sc.score_vectors(batch, _items(t, m), "qvec", True, typed))


@register("model_tables_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Model tables saved as Parquet and loaded back."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "model")
    md.save(md.train(_data(t), P, user_factors=t.user_vectors, item_factors=t.item_vectors), path)
    m = md.load(spark, path)
    return m.item_model.select("item_id", "item_type", F.col("features").isNotNull().alias("has_features"),
                               "popularity")


@register("model_tables_compared")
def q_model_compared(spark, sf_dir):
    """Every model table as saved against the one loaded back, row by row."""
    t = load(spark, sf_dir)
    path = _scratch(spark, "model")
    saved = md.materialize(md.train(_data(t), P, user_factors=t.user_vectors, item_factors=t.item_vectors))
    md.save(saved, path)
    return md.differences(saved, md.load(spark, path))


@register("profile_samples")
def q_profile_samples(spark, sf_dir):
    """Two sample rows of each training table."""
    t = load(spark, sf_dir)
    return ev.sample_rows({"users": t.users, "items": t.items, **ev.typed_events(t.log, P)})


@register("nonempty_guards")
def q_nonempty_guards(spark, sf_dir):
    """what the guards say of the training inputs, and of one without rows."""
    t = load(spark, sf_dir)
    inputs = {"users": t.users, "items": t.items, "views": ev.typed_events(t.log, P)["view"],
              "nothing": t.items.filter(F.col("item_type") == "none")}

    def guard(name, df):
        try:
            ev.require_nonempty(df, name)
        except ValueError as e:
            return name, False, str(e)
        return name, True, None

    return spark.createDataFrame([guard(*x) for x in inputs.items()], "table_name string, passes boolean, message string")


@register("null_cosmetic_names")
def q_null_names(spark, sf_dir):
    """A null name among a content's cosmetics fails its own entry only.

    Each content is searched by the words of its first cosmetic, in all its
    names and in the others, each with a null before them.
    """
    content = load(spark, sf_dir).items.filter((F.col("item_type") == "content") & (F.size("cosmetics") > 0))
    first = F.array_min("cosmetics")
    null = F.array(F.lit(None).cast("string"))
    terms = F.split(first, " ")
    return content.select("item_id", tx.any_name_matches(F.concat(null, "cosmetics"), terms).alias("own"),
                          tx.any_name_matches(F.concat(null, F.filter("cosmetics", lambda c: c != first)), terms).alias("others"),
                          tx.any_name_matches(null, terms).alias("none"))
