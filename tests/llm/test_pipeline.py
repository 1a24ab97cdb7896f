"""The corpus pipeline, stage by stage, against brute force on a small fixture; and as one run."""

import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from affinity.llm.queries import QUERIES, tokenizer_path  # noqa: E402
from tests.llm.test_decontaminate import brute as brute_hits  # noqa: E402
from tests.llm.test_near_dup import brute_classes  # noqa: E402
from tests.llm.test_replicate import brute as brute_copies  # noqa: E402
from tests.llm.texts import documents, words  # noqa: E402

ITEMS = [(1, " ".join(words(30, 777))), (2, "nothing of this kind occurs in any of the documents here at all")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of two kinds: words for good ones, shouting for bad ones; labels for half of them."""
    root = tmp_path_factory.mktemp("sf")
    seen, rows = set(), []
    for d, t in documents(30):
        if d not in seen:
            seen.add(d)
            rows.append((d, t))
    rows += [(500 + i, "BUY!! NOW!! " * (5 + i % 4) + f"X{i}!!") for i in range(25)]
    docs = [(d, t, "en", None if d % 17 == 0 else f"s{d % 3}", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, int(d < 500), 0) for d, _ in rows if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def rows_of(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return [tuple(r) for r in df.collect()]


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dup", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = step(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            kept = {r[0] for r in rows_of(out)}
            assert not any(d >= 500 for d in kept)
            assert all(d in kept for d, t, *_ in before if d < 500 and len((t or "").split()) > 20 and "Der Der" not in t)
        elif name == "near_dup":
            lead = {c for _, c in brute_classes([r[:2] for r in before])}
            assert sorted(rows_of(out), key=str) == sorted([r for r in before if r[0] in lead], key=str)
        elif name == "decontamination":
            hit = {d for d, _, n, _ in brute_hits([r[:2] for r in before], ITEMS) if n}
            assert hit and sorted(rows_of(out), key=str) == sorted([r for r in before if r[0] not in hit], key=str)
        elif name == "mixing":
            want = brute_copies([(r[0], r[1], r[3]) for r in before], {}, 1.0, 1.0)
            assert Counter((r[0], r[1], r[3]) for r in rows_of(out)) == Counter(k[:3] for k in want.elements())
        else:
            from tokenizers import Tokenizer
            plain, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
            for d, t, *_ in sorted(before, key=lambda r: r[0]):
                ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
                want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(tuple(r) for r in out.collect()) == sorted(want)
        docs = out


def test_run_is_the_chain_of_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert got and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_one_query_per_operator():
    import __spark_entry__
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", ["op3_poisson_mix", "op4_url_rules", "op5_recompression", "op7_winnowing", "op10_maxscore"])
def test_queries_match_their_sql(spark, name):
    from tests.oracle_check import compare
    assert compare(spark, name, "/root/testdata/sf0.001")["status"] == "match"


def test_null_and_repeated_ids_are_told_apart_by_text(spark, sf_dir):
    """Texts of null ids, or of one id, are documents of their own in each stage."""
    steps = dict(corpus_pipeline.STAGES)
    clean = [(None, " ".join(words(60, 3000 + i, 5000)), "en", "a", 1) for i in range(30)]
    clean += [(7, " ".join(words(60, 3100 + i, 5000)), "en", "a", 1) for i in range(2)]
    dirty = [(d, " ".join(words(60, 3200 + i, 5000)) + " " + ITEMS[0][1], "en", "a", 1) for i, d in enumerate([None, 7])]
    docs = spark.createDataFrame(clean + dirty + clean[:3] + [(9, clean[4][1], "en", "a", 1)], SCHEMA).repartition(3)
    got = steps["near_dup"](spark, docs, sf_dir)
    lead = [r if r[1] != clean[4][1] else (9, *r[1:]) for r in clean]  # a class of a null id and 9 is led by 9
    assert sorted(rows_of(got), key=str) == sorted(lead + dirty, key=str)
    got = steps["decontamination"](spark, spark.createDataFrame(clean + dirty, SCHEMA), sf_dir)
    assert sorted(rows_of(got), key=str) == sorted(clean, key=str)
    copies = Counter(r[1] for r in rows_of(steps["mixing"](spark, spark.createDataFrame(clean, SCHEMA), sf_dir)))
    assert len({copies[t] for _, t, *_ in clean[:30]}) > 1


INTERNAL = ["score", "copy_no", "place", "_row", "_id", "_own_id", "_own_name", "_lead_id", "_hit_id", "_hit_k1", "_own_k1", "_score", "_parts", "_source", "_own", "_from", "key", "name"]


def test_stages_keep_extra_columns_of_any_name(spark, sf_dir):
    """Columns named like internal ones come through all stages that return documents, values and all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *[f"concat('{c} of ', doc_id) AS `{c}`" for c in INTERNAL])
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in INTERNAL), name


def test_empty_tables_and_a_very_long_text(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for empty in ("documents", "benchmark", "labels"):
        root = str(tmp_path / empty)
        long = spark.createDataFrame([(9000, " ".join(words(150_000, 8, 40_000)), "en", "s1", None)], SCHEMA)
        tables = {"documents": docs.unionByName(long), "labels": labels, "benchmark": spark.createDataFrame(ITEMS, "item_id long, text string")}
        tables[empty] = tables[empty].limit(0)
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        got = corpus_pipeline.run(spark, root).collect()
        assert (len(got) == 0) == (empty == "documents")
        if got and empty == "benchmark":
            assert all(r.n_tokens > 100_000 for r in got if r.doc_id == 9000)
