import os
import random

import pytest
from pyspark.sql import functions as F

from outcrop.functions import text as T
from outcrop.operators import blocks, postings, search
from outcrop.plans import catalog
from outcrop.sources.scratch import shared_dir
from tests.test_operators import units
from tests.test_postings import STRINGS, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("grace mercy not only loved loving the of world ones one hope".split()) for _ in range(n))
    made = [(f"u{i}", f"r{i % 3}" if i % 7 else None, None, float(i % 2), say(rng.randint(0, 4)), say(rng.randint(0, 9)) or None, [say(2), None, say(1)]) for i in range(60)]
    df = spark.createDataFrame(made, "unit_id string, recording_id string, date date, start double, title string, summary string, topics array<string>").repartition(3).cache()
    return df, [say(rng.randint(1, 5)) for _ in range(12)] + ["one", "the of", "", "nothing here"]


def shown(spark, queries):
    return spark.createDataFrame(list(enumerate(queries)), STRINGS)


def indexes(spark):
    at = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(at) if x.startswith("search-index")} if os.path.isdir(at) else set()


def test_blocks_as_the_stored_index(spark, texts, tmp_path):
    df, asked = texts
    postings.build(df, f"file://{tmp_path}/i", buckets=2)
    want = postings.search_many(postings.Index(spark, f"file://{tmp_path}/i"), shown(spark, asked)).collect()
    found = blocks.ranked(df, shown(spark, asked)).collect()
    for i, q in enumerate(asked):
        assert rows(r for r in found if r.query_id == str(i)) == rows(r for r in want if r.query_id == str(i)), q


def test_dates_and_phrases_in_blocks(spark):
    whole = search.prepare(units(spark)).cache()
    asked = ["5 July 2024", "not love world", "life life lives", "mercy"]
    found = blocks.ranked(units(spark), shown(spark, asked)).collect()
    for i, q in enumerate(asked):
        assert rows(r for r in found if r.query_id == str(i)) == rows(search.search(whole, q).collect()), q


def test_no_index_for_queries_known_at_once(spark):
    before = indexes(spark)
    plan = catalog.search_batch(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert indexes(spark) == before and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_every_word_of_a_term():
    rng = random.Random(7)
    ends = ["", "s", "e", "es", "ies", "ing", "ed", "eds", "ings", "eing", "ying", "yed", "y", "ss", "us"]
    for _ in range(20000):
        w = "".join(rng.choice("abdegimnrsty") for _ in range(rng.randint(1, 5)))
        w = w + w[-1] * rng.randint(0, 1) + rng.choice(ends)
        assert w in T.words_of(T.stem_word(w)), w
    assert set(T.words_of("hop")) >= {"hop", "hops", "hoping", "hopping", "hopped", "hoped"} and T.words_of("5é") == ["5é"]


def test_the_best_of_each_query_in_order(spark, texts):
    df, asked = texts
    asked = [q for q in asked if q]
    whole = blocks.ranked(df, shown(spark, asked)).collect()
    for limit, kept in ((3, blocks.KEPT), (1, 8)):  # the second compacts after every block
        with pytest.MonkeyPatch.context() as m:
            m.setattr(blocks, "KEPT", kept)
            found = blocks.ranked(df, shown(spark, asked), limit=limit, digits=2).collect()
        for i, q in enumerate(asked):
            own = sorted((r for r in whole if r.query_id == str(i)), key=lambda r: (-round(r.score, 2), r.recording_id or "", r.start, r.unit_id))
            assert {r.unit_id for r in found if r.query_id == str(i)} == {r.unit_id for r in own[:limit]}, q
    assert blocks.ranked(df, shown(spark, asked), limit=0).collect() == []


@pytest.mark.parametrize("name", ["search_batch_top", "search_date", "similar_batch", "search_sparse", "search_rank", "best_unit_per_recording", "posting_counts", "search_hybrid"])
def test_a_query_over_tables_builds_no_index(spark, name):
    before = indexes(spark)
    assert catalog.QUERIES[name](spark, SMALL).schema and indexes(spark) == before


def test_nearest_rows_among_equal_ones(spark):
    """Ties go by unit_id in whatever block they are, though a product's last bits differ from block to block."""
    made = [(f"{i:03}", "r", None, 0.0, [100 + i % 2, 50, 7]) for i in range(300)]
    df = spark.createDataFrame(made, "unit_id string, recording_id string, date date, start double, vector array<tinyint>").repartition(3)
    found = postings.similar(postings.vector_blocks(df, block=16), [("a", [100.0, 50.0, 7.0]), ("b", [-1.0, 0.0, 0.0])], least=0.0, k=10, digits=6).collect()
    assert [(r.query_id, r.unit.unit_id, r.cosine) for r in sorted(found, key=lambda r: r.place)] == [("a", f"{i:03}", 1.0) for i in range(0, 20, 2)]


def test_counts_of_terms(spark, texts):
    df, _ = texts
    want = {}
    for r in df.collect():
        own = {c: {T.stem_word(w) for v in vs if v for w in v.split()} for c, vs in (("title", [r.title]), ("summary", [r.summary]), ("topic", r.topics))}
        for t in set().union(*own.values()):
            a, b = want.get(t, (0, 0))
            want[t] = (a + 1, b + (t in own["title"] | own["summary"]))
    within = {"df": postings.RAW & ~postings.BIT["date"], "chapter_df": postings.CHAPTER}
    assert {r.term: (r.df, r.chapter_df) for r in blocks.counts(df, within).collect()} == want
    assert {r.term: (r.df, r.chapter_df) for r in blocks.counts(df, within, ["lov", "zzz"]).collect()} == {"lov": want["lov"]}


def test_terms_and_vectors_in_blocks(spark):
    int8 = spark.createDataFrame([("a", [127, 0]), ("b", [56, 114]), ("c", [0, 0]), ("d", [127, 1])], "unit_id string, vector array<tinyint>")
    whole = search.prepare(units(spark)).join(int8.withColumn("vector", F.col("vector").cast("array<double>")), "unit_id", "left")
    near = postings.similar(postings.blocks_of(units(spark), int8), [("x", [1.0, 0.2])])
    for q in ("mercy", "zzz"):
        found = blocks.ranked(units(spark), spark.createDataFrame([("x", q)], "query_id string, query string"), near=near).collect()
        assert rows(found) == rows(search.search(whole, q, query_vector=[1.0, 0.2]).collect())
