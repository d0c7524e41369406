import random

import pytest
from pyspark.sql import functions as F

from outcrop.functions import captions
from outcrop.functions import scripture as S
from outcrop.functions import text as T
from outcrop.operators import archive, artifacts, display, evaluate, search, timeline

COUNTS = {"Romans": [32, 29], "Mark": [45, 28], "Ruth": [22, 23, 18, 22], "Song of Solomon": [17, 17]}


def test_index_and_query_are_normalised(spark):
    rows = [("a", "Ｍercy ﬁrst"), ("b", "mercy first"), ("c", "Génie"), ("d", None)]
    units = spark.createDataFrame(rows, "unit_id string, title string").withColumns({"recording_id": F.col("unit_id"), "date": F.lit("2024-07-05"), "start": F.lit(0.0)})
    index = search.prepare(units)
    assert {r.unit_id for r in search.search(index, "mercy first").collect()} == {"a", "b"}
    assert {r.unit_id for r in search.search(index, "génie").collect()} == {"c"}
    assert [r.t for r in spark.createDataFrame([(["x²", None],), (None,), (["plain"],)], "v array<string>").select(T.normalised(F.col("v")).alias("t")).collect()] == [["x2", None], None, ["plain"]]


def test_lower_case_names_and_fields_apart(spark):
    found = lambda t: [r.canonical for r in S.mentions(t, COUNTS)]
    assert found("as romans 2:1 says, ruth 2") == ["Romans 2:1", "Ruth 2"]
    assert found("mark 2 boxes and Mark 2") == ["Mark 2"]
    units = spark.createDataFrame([("a", "Romans", "2 things"), ("b", "On Ruth 2", None)], "unit_id string, title string, summary string").withColumns({"recording_id": F.col("unit_id"), "date": F.lit("2024-07-05"), "start": F.lit(0.0)})
    got = {r.unit_id: [m.canonical for m in r.mentioned] for r in search.prepare(units, COUNTS).collect()}
    assert got == {"a": [], "b": ["Ruth 2"]}


def test_recording_rules(spark):
    schema = "id string, service_date date, status string, description string, scripture array<string>, topics array<string>, uploads array<struct<youtube_id:string,duration:double,skip:double>>, chapters array<struct<id:string,title:string,kind:string,start:double,end:double,scripture:array<string>,points:array<struct<time:double,text:string>>,subchapters:array<struct<id:string,title:string,kind:string,start:double,end:double,scripture:array<string>,points:array<struct<time:double,text:string>>>>>>, markers array<struct<time:double,end:double,note:string>>"
    import datetime

    day = datetime.date(2024, 7, 5)

    def recording(n, kind="song", points=(), subs=(), markers=()):
        sub = [(f"s{i}", "t", "part", a, b, None, None) for i, (a, b) in enumerate(subs)]
        return (f"2024-07-05-{n}", day, "published", None, None, None, [("v", 100.0, None)], [("c", "t", kind, 0.0, 90.0, None, [(x, "p") for x in points], sub)], [(a, b, "m") for a, b in markers])

    rows = [recording(1), recording(2, "sermon"), recording(3, points=(5.0, 4.0)), recording(4, subs=((0.0, 50.0), (40.0, 60.0))), recording(5, markers=((50.0, 120.0),)), recording(6, points=(1.0, 1.0), subs=((0.0, 5.0), (5.0, 9.0)), markers=((99.0, None),))]
    got = {}
    for r in archive.recording_violations(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.subject[-1], []).append(r.problem)
    assert got == {"2": ["a published recording of a sermon has description, scripture and topics"], "3": ["points are in time order"], "4": ["subchapters are in order and don't overlap"], "5": ["markers are within the recording"]}


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_line_diff_against_a_table(spark):
    rng = random.Random(4)
    for _ in range(60):
        a, b = (["".join(rng.choice("xyz")) for _ in range(rng.randint(1, 14))] for _ in range(2))
        rows = artifacts._diff("\n".join(a), "\n".join(b), 100)
        if a == b:
            assert rows == []
            continue
        assert [x for _, kind, x in rows if kind != "added"] == a and [x for _, kind, x in rows if kind != "removed"] == b
        assert sum(kind == "same" for _, kind, _ in rows) == lcs(a, b)
    pairs = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng\nh", "a\nX\nc\nd\ne\nf\ng\nh"), (2, "same", "same"), (3, None, "new")], "k int, old string, new string")
    got = artifacts.line_diffs(pairs, "k", "old", "new", context=1).collect()
    assert [(r.hunk, r.kind, r.line) for r in got if r.k == 1] == [(1, "same", "a"), (1, "removed", "b"), (1, "added", "X"), (1, "same", "c")]
    assert {r.k for r in got} == {1, 3}


def test_caption_words_and_titles(spark):
    one = lambda f, *values: [r.x for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t")).alias("x")).collect()]
    assert one(captions.tokens, "[Applause] Joy, peace’s 平和! don't", None) == [["joy", "peace's", "平", "和", "don't"], []]
    assert one(captions.dictionary_forms, "can't", "isn't", "we've", "word") == [["can't", "can"], ["isn't", "is"], ["we've", "we"], ["word"]]
    assert one(captions.in_title_case, "The Road to Joy", "the Road", "Road To joy", "", "3 Ways of Joy") == [True, False, False, False, True]
    assert one(captions.to_title_case, "the road To joy — of it") == ["The Road to Joy — of It"]
    assert one(captions.unescaped, r"A\x42 &#67;&#x44;<b>e</b>&amp;f", "plain", "ﬁ &#1114112;", None) == ["AB CD e  f", "plain", "fi  ", None]
    assert one(captions.issue_title, "a<b & *c*\t[d]") == [r"a&lt;b &amp; \*c\* \[d\]"]
    assert one(captions.book, "1 John 3:16", "Ruth") == ["1 John", "Ruth"]


def test_cards(spark):
    refs = spark.createDataFrame([(1, 0, "Romans 1", False, "Romans 1:3", 2.0), (1, 1, "Ruth 2", False, None, None), (1, 2, "Romans 1:3", False, "Romans 1:3", 1.0), (2, 0, "Mark 1", False, None, None), (2, 1, "Mark 2", True, None, None)], "unit_id int, ord int, reference string, overlaps boolean, best_key string, best_score double")
    got = [(r.unit_id, r.place, r.reference) for r in display.shown_references(refs).orderBy("unit_id", "place").collect()]
    assert got == [(1, 1, "Romans 1:3"), (1, 2, "Ruth 2"), (2, 1, "Mark 2"), (2, 2, "Mark 1")]
    assert display.page(spark.range(50), 3, F.desc("id")).count() == 10


@pytest.mark.parametrize(("at", "want"), [(-1.0, None), (0.0, "a"), (15.0, "a1"), (25.0, "a"), (30.0, "b"), (60.0, None)])
def test_sections(spark, at, want):
    sections = spark.createDataFrame([("r", "a", 0, 0.0, 30.0), ("r", "a1", 1, 10.0, 20.0), ("r", "b", 0, 30.0, 60.0)], "key string, id string, depth int, start double, end double")
    assert timeline.containing(spark.createDataFrame([("r", at)], "key string, t double"), sections, "key", "t").first().section == want


def test_case_reports(spark):
    cases = spark.createDataFrame([("q1", "rank", 1, None, "Title"), ("q2", "empty", None, None, None), ("q3", "date", 5, "2024-01-01", None), ("q4", "rank", 1, None, None)], "case string, kind string, max_rank int, expected_date string, reason string")
    accepted = spark.createDataFrame([("q1", "a"), ("q3", "b"), ("q4", "nowhere")], "case string, recording string")
    results = spark.createDataFrame([("q1", "a", 3.0, "x", ["Topic match"]), ("q1", "a", 1.0, "x", ["Title match"]), ("q1", "c", 2.0, "x", ["Title match"]), ("q3", "b", 1.0, "2024-01-01", []), ("q3", "c", 0.5, "2024-01-02", [])], "case string, recording string, score double, date string, reasons array<string>")
    got = {r.case: (r["rank"], r.passed) for r in evaluate.case_reports(cases, accepted, results).collect()}
    assert got == {"q1": (1, True), "q2": (None, True), "q3": (1, False), "q4": (None, False)}
