import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcrop.operators import postings, search, vectors
from outcrop.sources.stored import stamp, stored
from tests.test_functions import COUNTS
from tests.test_operators import units

ASKED = ["mercy", "Romans 12:1-2", "romans 13", "church life", "not love world", "5 July 2024", "faith", "life life lives", "loving the world", "the of", "", "nothing here", "a talk on Romans 12:1 and mercy"]
STRINGS = "query_id int, query string"


def rows(found):
    return {(r.unit_id, round(r.score, 9), tuple(r.reasons)) for r in found}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    int8 = spark.createDataFrame([("a", [127, 0]), ("b", [56, 114]), ("c", [0, 0]), ("d", [127, 1]), ("e", [1, 2, 3])], "unit_id string, vector array<tinyint>")
    postings.build(units(spark), path, COUNTS, buckets=4, rows=int8)
    return postings.Index(spark, path)


def test_many_queries_as_the_exhaustive_search(spark, index):
    found = postings.search_many(index, spark.createDataFrame(list(enumerate(ASKED)), STRINGS), COUNTS).collect()
    whole = search.prepare(units(spark), COUNTS).cache()
    for i, q in enumerate(ASKED):
        assert rows(r for r in found if r.query_id == str(i)) == rows(search.search(whole, q, COUNTS).collect()), q


def test_random_texts_as_the_exhaustive_search(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("grace mercy not only loved loving the of world ones one hope".split()) for _ in range(n))
    made = [(f"u{i}", f"r{i % 3}", None, float(i), say(rng.randint(0, 4)), say(rng.randint(0, 9)) or None, [say(2), None, say(1)]) for i in range(60)]
    df = spark.createDataFrame(made, "unit_id string, recording_id string, date date, start double, title string, summary string, topics array<string>")
    postings.build(df, f"file://{tmp_path}/i", buckets=3)
    asked = [say(rng.randint(1, 5)) for _ in range(20)]
    found = postings.search_many(postings.Index(spark, f"file://{tmp_path}/i"), spark.createDataFrame(list(enumerate(asked)), STRINGS)).collect()
    whole = search.prepare(df).cache()
    for i, q in enumerate(asked):
        assert rows(r for r in found if r.query_id == str(i)) == rows(search.search(whole, q).collect()), q


def test_vectors_and_terms_in_one_score(spark, index):
    v = spark.createDataFrame([("a", [127.0, 0.0]), ("b", [56.0, 114.0]), ("c", [0.0, 0.0]), ("d", [127.0, 1.0]), ("e", [1.0, 2.0, 3.0])], "unit_id string, vector array<double>")
    whole = search.prepare(units(spark)).join(v, "unit_id", "left")
    for q in ("mercy", "zzz"):
        found = postings.search_many(index, spark.createDataFrame([("x", q)], "query_id string, query string"), vectors_of=[("x", [1.0, 0.2])]).collect()
        assert rows(found) == rows(search.search(whole, q, query_vector=[1.0, 0.2]).collect())


def test_limit_keeps_the_order_of_each_query(spark, index):
    q = spark.createDataFrame([("m", "mercy"), ("f", "faith life")], "query_id string, query string")
    found = postings.search_many(index, q, COUNTS, limit=2).collect()
    whole = search.prepare(units(spark), COUNTS).cache()
    for i, text in (("m", "mercy"), ("f", "faith life")):
        assert {r.unit_id for r in found if r.query_id == i} == {r.unit_id for r in search.search(whole, text, COUNTS, limit=2).collect()}
    assert postings.search_many(index, q, COUNTS, limit=0).collect() == []


def test_only_buckets_of_the_terms_are_read(spark, index, capsys):
    postings.search_many(index, spark.createDataFrame([("q", "mercy")], "query_id string, query string")).explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[.*(In|EqualTo)\(term", plan)
    assert "CartesianProduct" not in plan


def test_nearest_rows_by_blocks(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-127, 128, (300, 8)).astype(np.int8)
    m[7] = 0
    df = spark.createDataFrame([(f"{i:03}", "r", None, 0.0, [int(x) for x in v]) for i, v in enumerate(m)], "unit_id string, recording_id string, date date, start double, vector array<tinyint>").repartition(5)
    q = rng.normal(size=(4, 8))
    found = postings.similar(postings.vector_blocks(df, block=32), [(str(i), list(v)) for i, v in enumerate(q)] + [("zero", [0.0] * 8), ("other", [1.0])], least=0.0, k=5).collect()
    f = m.astype(float)
    size = np.linalg.norm(f, axis=1)
    for i, v in enumerate(q):
        c = f @ v / np.where(size > 0, size, 1) / np.linalg.norm(v)
        assert [r.unit.unit_id for r in sorted((r for r in found if r.query_id == str(i)), key=lambda r: r.place)] == [f"{k:03}" for k in np.argsort(-c, kind="stable")[:5]]
    assert {r.query_id for r in found} == set("0123")


def test_ordinals(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert sorted((r.x, r.row_ord) for r in vectors.ordinals(df, F.desc("x")).collect()) == [(x, 999 - x) for x in range(1000)]
    assert vectors.ordinals(df.where("x < 0"), F.desc("x")).collect() == []


def test_a_stored_table_follows_its_sources(spark, tmp_path):
    at = f"{tmp_path}/source"
    spark.range(3).write.parquet(at)
    built = []

    def build(path):
        built.append(path)
        spark.range(1).write.parquet(f"{path}/t")

    first = stored(spark, "kept", [spark.read.parquet(at)], build)
    assert stored(spark, "kept", [spark.read.parquet(at)], build) == first and len(built) == 1 and spark.read.parquet(f"{first}/t").count() == 1
    spark.range(5).write.mode("append").parquet(at)
    assert stored(spark, "kept", [spark.read.parquet(at)], build) != first and len(built) == 2

    def broken(path):
        spark.range(1).write.parquet(f"{path}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stored(spark, "lost", [spark.read.parquet(at)], broken)
    assert not [x for x in os.listdir(os.path.dirname(first.removeprefix("file:"))) if x == f"lost-{stamp(spark.read.parquet(at))}"]
