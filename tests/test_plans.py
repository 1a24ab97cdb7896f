"""The physical plans have the shape the design relies on."""

import tempfile

from pyspark.sql import functions as F

from affinity.config import Params
from affinity.operators import candidates as cd
from affinity.operators import events as ev
from affinity.operators import overlap as ov
from affinity.operators import topn as tn
from affinity.operators import weights as wt
from affinity.plans import model as md
from affinity.plans import scoring as sc
from affinity.sources.fixtures import load
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_log(spark):
    path = tempfile.mkdtemp(prefix="affinity-log-", dir="/tmp") + "/log"
    load(spark, SF_SMALL).log.write.parquet(path)
    return spark.read.parquet(path)


def test_log_scan_pushes_filters_and_prunes_columns(spark):
    log = stored_log(spark)
    p = plan(ev.seen_items(log))
    assert "PushedFilters: [In(event" in p or "PushedFilters: [IsNotNull(event), In(event" in p, p
    assert "ReadSchema: struct<event:string,user_id:string,target_type:string,item_id:string>" in p, p


def test_latest_k_uses_map_side_partial_limit(spark):
    p = plan(ev.recent_items(stored_log(spark)))
    assert p.count("WindowGroupLimit") >= 2, p          # partial before the shuffle + final


def test_affinity_is_one_partial_plus_final_aggregation(spark):
    t = load(spark, SF_SMALL)
    stats = wt.pair_stats(md.valid_training_log(md.TrainingData(t.users, t.items, stored_log(spark))))
    p = plan(wt.affinity_from_stats(stats))
    assert "partial_sum" in p and "partial_max_by" in p, p
    assert "HashAggregate" in p and "SortAggregate" not in p, p


def test_overlap_keeps_the_requested_users_before_pairing(spark):
    t = load(spark, SF_SMALL)
    m = md.train(md.TrainingData(t.users, t.items, t.log), user_factors=t.user_vectors, item_factors=t.item_vectors)
    p = plan(m.overlap_for(t.requests.select("user_id")))
    joins = [line for line in p.splitlines() if "Join" in line]
    assert any("LeftSemi" in j for j in joins), p
    semi = min(i for i, j in enumerate(joins) if "LeftSemi" in j)
    assert "Inner" in joins[0] and semi > 0, p      # the pair join stands above the semi join


def test_cosmetic_hot_on_both_sides_is_a_grid(spark):
    owned = spark.createDataFrame([(f"u{i}", "hot") for i in range(300)] + [("u1", "cold")], "user_id string, cosmetic_id string")
    mentions = spark.createDataFrame([(f"c{i}", "hot") for i in range(200)] + [("c1", "cold")], "content_id string, cosmetic_id string")
    got = ov.overlap_of(owned, mentions, Params(hot_key_pairs=500))
    assert got.count() == 60_000 and got.filter("score = 10").count() == 1


def test_signature_ranking_survives_a_long_black_list(spark):
    n = 101_000
    scored = spark.range(n).selectExpr("'s' AS sig", "concat('i', lpad(id, 6, '0')) AS item_id", "cast(id % 1000 AS double) AS score")
    top = tn.top_n(scored, ["sig"], tn.by_score(), F.lit(100_500), 100_500, spread="item_id")
    plain = scored.orderBy(*tn.by_score()).limit(100_500).select("item_id")
    assert top.count() == 100_500 and top.select("item_id").exceptAll(plain).count() == 0


def test_pair_join_is_broadcast_not_cartesian(spark):
    t = load(spark, SF_SMALL)
    pairs = cd.candidate_pairs(cd.prepare_requests(t.requests), cd.item_side(t.items), cd.factor_predicate(),
                               Params(), left_rows=34)
    p = plan(pairs)
    assert "Broadcast" in p and "CartesianProduct" not in p, p


def test_salted_pair_join_splits_the_type_key(spark):
    t = load(spark, SF_SMALL)
    pairs = cd.candidate_pairs(cd.prepare_requests(t.requests), cd.item_side(t.items), cd.factor_predicate(),
                               Params(broadcast_rows=0, salt_buckets=4), left_rows=34)
    p = plan(pairs)
    assert "xxhash64" in p and "CartesianProduct" not in p, p


def test_factor_scoring_runs_as_arrow_cogroup(spark):
    t = load(spark, SF_SMALL)
    m = md.train(md.TrainingData(t.users, t.items, t.log), user_factors=t.user_vectors, item_factors=t.item_vectors)
    batch = sc.factor_batch(t.requests, m.user_factors, m.item_model, t.log, checkpoint=False)
    p = plan(sc.score_vectors(batch, m.item_model, "uvec", False))
    assert "FlatMapCoGroupsInArrow" in p, p


def test_literal_target_types_give_empty_seen_and_recent(spark):
    # Q2: the reference looks for target type 'item' only
    log = load(spark, SF_SMALL).log
    p = Params(target_types=("item",))
    assert ev.seen_items(log, p).count() == 0 and ev.recent_items(log, p).count() == 0
    assert ev.seen_items(log).count() > 0


def test_nested_text_rounds_the_shown_score(spark):
    from affinity.queries import _results_text
    df = spark.createDataFrame([([("a", 0.1034996), ("b", 0.1034994), ("c", 5.0)],)], "s array<struct<item:string,score:double>>")
    assert df.select(_results_text("s")).first()[0] == "a=104|b=103|c=5000"


def test_a_compact_file_of_many_rows_is_not_broadcast_unasked(spark):
    """1.2 million rows in a file below the broadcast threshold: their table would be built in the driver's memory."""
    folder = tempfile.mkdtemp(prefix="affinity-compact-", dir="/tmp")
    key = F.col("id")
    (spark.range(0, 1_200_000, 1, 1).select(
        key.alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"),
        F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet"))
    names = load(spark, folder).part_names
    plan = spark.range(10_000_000).join(names, F.col("id") == names.p_partkey)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_overlap_tasks_grow_with_the_pairs(spark, monkeypatch):
    owned = spark.range(40).selectExpr("concat('u', id) AS user_id", "concat('p', id % 2) AS cosmetic_id")
    mentions = spark.range(30).selectExpr("concat('c', id) AS content_id", "concat('p', id % 3) AS cosmetic_id")
    want = sorted(tuple(r) for r in ov.overlap_of(owned, mentions).collect())
    monkeypatch.setattr(ov, "TASK_PAIRS", 20)
    got = ov.overlap_of(owned, mentions)
    assert got.rdd.getNumPartitions() == 20  # 400 pairs: 40 owned x 10 mentions each
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 400


def test_a_recent_vector_travels_once(spark):
    t = load(spark, SF_SMALL)
    text = plan(sc._query_vectors(ev.recent_items(t.log), t.item_vectors))
    assert "Generate posexplode" not in text


def test_compared_model_rows_travel_as_digests(spark):
    rows = [("a", "content", None, None, ["x", None], None, [1.5, -2.25], 0.5), ("b", "cosmetic", [], "y", None, None, None, 0.0)]
    schema = ("item_id string, item_type string, categories array<string>, brand string, cosmetics array<string>, upload_date string, "
              "features array<double>, popularity double")
    pairs = "user_id string, cosmetic_id string"
    few = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = lambda rows: md.Model(few([("u", [1.0])], "user_id string, features array<double>"), few(rows, schema),
                                  few([("u", "a")] * 2, pairs), few([], "content_id string, cosmetic_id string"), None)
    other = [rows[0], rows[0], ("b", "cosmetic", None, "y", None, None, None, 0.0)]   # one twice; an empty list is not a null one
    got = md.differences(model(rows), model(other))
    exchanges = [line for line in plan(got).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("features" in line for line in exchanges)
    assert sorted(tuple(r) for r in got.collect()) == \
        [("item_model", 2, 1, 2), ("mentions", 0, 0, 0), ("owned", 2, 0, 0), ("user_factors", 1, 0, 0)]


def test_answers_of_each_scorer_are_staged(spark, monkeypatch):
    """a scorer's answers are written before the next scorer starts, so only one scorer's shuffle files are held."""
    from affinity.plans import serve as sv
    from tests.helpers import requests
    staged, real = [], sv.stage
    monkeypatch.setattr(sv, "stage", lambda df, name="table": staged.append(name) or real(df, name))
    reqs = requests(spark, [dict(request_id="r", user_id="u", num=2, item_type="cosmetic")])
    answer = lambda rows: lambda _: spark.createDataFrame(rows, "request_id string, item_id string, score double")
    out = sv.serve(reqs, {"a": answer([("r", "x", 1.5), ("r", "y", 1.0)]), "b": answer([("r", "y", 5.0), ("r", "z", 0.0)])})
    assert staged == ["serve_requests", "answers", "answers"]
    assert sorted((r.item_id, r.score, r["rank"]) for r in out.collect()) == [("x", 1.5, 2), ("y", 6.0, 1)]
