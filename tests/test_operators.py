import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcrop.operators import archive, search, timeline, vectors
from outcrop.sources import archive as sources
from tests.test_functions import COUNTS


def units(spark):
    d = datetime.date(2024, 7, 5)
    rows = [
        ("a", "r1", d, 0.0, "Living sacrifice", "A talk on Romans 12:1 and mercy", ["Faith", "Church life"], ["Romans 12:1-8"]),
        ("b", "r1", d, 9.0, "Not love of the world", "loving the world", ["Faith life"], None),
        ("c", "r2", datetime.date(2024, 7, 6), 0.0, "Mercy", None, None, ["Romans 13"]),
        ("d", "r3", datetime.date(2024, 7, 6), 0.0, "Mercy", None, None, ["Nothing 1"]),
        ("e", "r3", datetime.date(2024, 7, 5), 3.0, "Mercy", None, None, None),
    ]
    return spark.createDataFrame(rows, "unit_id string, recording_id string, date date, start double, title string, summary string, topics array<string>, scripture array<string>")


def test_search(spark):
    index = search.prepare(units(spark), COUNTS).cache()
    ids = lambda q, **o: [r.unit_id for r in search.search(index, q, COUNTS, **o).collect()]
    assert ids("mercy")[:3] == ["c", "d", "e"]  # newer first, then recording
    assert ids("mercy", limit=0) == [] and ids("") == [] and ids("the of") == []
    assert ids("5 July 2024") == ["a", "b", "e"]
    found = search.search(index, "Romans 12:1-2", COUNTS).collect()
    assert [r.unit_id for r in found] == ["a"] and found[0].reasons[0] == "Scripture: Romans 12:1-2"
    assert 60 < found[0].score < 64  # the reference, and words of the summary
    assert [r.unit_id for r in search.search(index, "church life", COUNTS).collect()][0] == "a"
    assert "Topic match (exact phrase)" in search.search(index, "church life", COUNTS).first().reasons
    assert ids("mercy", prune=True) == ids("mercy")


def test_semantic(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.44, 0.898]), ("c", [0.0, 0.0])], "unit_id string, vector array<double>")
    index = search.prepare(units(spark)).join(v, "unit_id", "left")
    found = search.search(index, "zzz", query_vector=[1.0, 0.0]).collect()
    assert [(r.unit_id, r.reasons) for r in found] == [("a", ["Similar in meaning"])] and found[0].score == pytest.approx(6)


def test_verses(spark):
    rows = [("1", "do not love the world"), ("2", "so loved the world"), ("3", "a world of peace")] + [(str(i), "filler words") for i in range(4, 60)]
    t = spark.createDataFrame(rows, "key string, text string")
    assert [r.key for r in search.verses(t, "do not love the world").collect()] == ["1"]
    assert search.verses(t, "the of").collect() == []


def test_by_recording(spark):
    found = search.by_recording(search.search(search.prepare(units(spark)), "mercy"))
    assert {r.recording_id: (r.unit_id, r.more) for r in found.collect()}["r3"] == ("d", 1)


def test_vectors(spark):
    m = np.array([[127, 1, -127], [0, 0, 0]], np.int8)
    assert (vectors.unpack(vectors.pack(m)) == m).all()
    with pytest.raises(ValueError):
        vectors.unpack(vectors.pack(m)[:-1])
    df = spark.createDataFrame([([127.0, 0.5, -0.5],), ([0.0, 0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.quantise(F.col("v"))).collect()] == [[127, 1, -1], [0, 0, 0]]
    for n, count in ((0, 1), (1, 1), (190, 1), (254, 1), (255, 2), (444, 2), (445, 3), (1000, 5)):
        w = vectors.token_windows(spark.createDataFrame([(list(range(n)),)], "tokens array<int>")).orderBy("start").collect()
        assert len(w) == count and sorted({x for r in w for x in r.window}) == list(range(n))
    pooled = vectors.pooled(spark.createDataFrame([("u", [3.0, 0.0]), ("u", [0.0, 2.0])], "id string, vector array<double>"), "id").first()
    assert pooled.vector == pytest.approx([0.5**0.5] * 2)


def test_timeline(spark):
    up = spark.createDataFrame([("r", 1, 100.0, None), ("r", 2, 50.0, 10.0)], "id string, ord int, duration double, skip double")
    spans = timeline.upload_spans(up, "id", "ord")
    assert [(r.span_start, r.span_end) for r in spans.orderBy("ord").collect()] == [(0.0, 100.0), (100.0, 140.0)]
    at = spark.createDataFrame([("r", 0.0), ("r", 100.0), ("r", 999.0)], "id string, t double")
    assert [(r.upload, r.local) for r in timeline.locate(at, spans, "id", "t", "ord").orderBy("t").collect()] == [(1, 0.0), (2, 0.0), (2, 899.0)]
    chunk = spark.range(1).select(timeline.chunks(F.lit(120), F.lit(1500)).alias("c")).first().c
    assert [tuple(x) for x in chunk] == [(120, 720), (675, 1275), (1230, 1500)]
    lines = spark.createDataFrame([("r", 0.0, 1.0, "a"), ("r", 1.0, 2.0, "a b"), ("r", 2.0, 3.0, "a b c"), ("r", 3.0, 9.0, "a b c")], "id string, start double, end double, text string")
    assert [(r.text, r.end) for r in timeline.rolled(lines, "id").collect()] == [("a", 1.0), ("b", 2.0), ("a b c", 9.0)]
    near = timeline.nearest(spark.createDataFrame([("k", 10.0), ("k", 90.0)], "k string, t double"), spark.createDataFrame([("k", 12.0, 1), ("k", 8.0, 2), ("k", 50.0, 3)], "k string, t double, ord int"), "k", "t", 7, "ord")
    assert {r.t: r.nearest for r in near.collect()} == {10.0: 1, 90.0: None}


def test_transcripts(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> &amp; bye\n\nno time\n\n2\n00:03.0 --> 00:04.0 align:start\nnext\n"
    got = [tuple(r)[1:] for r in sources.cues(spark.createDataFrame([("f", srt)], "key string, content string"), "key").orderBy("start").collect()]
    assert got == [(1.0, 2.5, "Hello & bye"), (3.0, 4.0, "next")]
    whisper = json.dumps({"transcription": [{"offsets": {"from": 1500, "to": 2000}, "text": " hi  there "}]})
    plain = json.dumps({"segments": [{"start": 1, "end": 2, "text": "x"}, {"start": 3, "end": 2, "text": "y"}, {"start": 1, "end": 2, "text": " "}]})
    got = sources.segments(spark.createDataFrame([("a", whisper), ("b", plain)], "key string, content string"), "key").orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", 1.5, 2.0, "hi there"), ("b", 1.0, 2.0, "x")]
    caption = json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 5000, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 0, "dDurationMs": 5000, "segs": [{"utf8": "a b"}]}, {"tStartMs": 9000, "dDurationMs": 2500, "segs": [{"utf8": "c"}]}, {"tStartMs": 1}]})
    got = sources.captions(spark.createDataFrame([("a", caption, 10.0)], "key string, content string, d double"), "key", "d").orderBy("start").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, 5.0, "a b"), (9.0, 10.0, "c")]


GOOD = """recordingTitle: One
serviceDate: 2024-07-05
status: published
sermonDescription: What it says.
sermonScripture: [Romans 12:1]
sermonTopics: [faith]
uploads:
  - youtubeId: abcdefghijk
    uploadDuration: "10:00"
chapters:
  - chapterId: one-a
    chapterTitle: Sermon
    chapterKind: sermon
    chapterStart: "0:00"
    chapterEnd: "9:00"
    points: [{pointTime: "1:00", pointText: A note}]
"""


def test_archive(spark, tmp_path):
    (tmp_path / "2024-07-05.yaml").write_text(GOOD)
    (tmp_path / "2024-07-06.yaml").write_text(GOOD.replace('"9:00"', '"11:00"').replace("2024-07-05", "2024-07-06"))
    (tmp_path / "2024-07-07.yaml").write_text(GOOD + "status: draft\n")
    rows = sources.read_recordings(spark, f"file://{tmp_path}/*.yaml").cache()
    assert {r.file: bool(r.problem) for r in rows.collect()} == {"2024-07-05": False, "2024-07-06": False, "2024-07-07": True}
    good = rows.where("problem is null")
    bad = archive.recording_violations(good).collect()
    assert [(r.subject, r.problem) for r in bad] == [("2024-07-06", "every section is within the recording")]
    topics = spark.createDataFrame([("faith", "Faith")], "id string, name string")
    series = spark.createDataFrame([("s", "Series", 1, "2024-07-05")], "series_id string, series_title string, ord int, recording_id string")
    made = archive.units(good.where("id = '2024-07-05'"), topics, series)
    assert sorted(r.unit_id for r in made.collect()) == ["2024-07-05", "2024-07-05/one-a", "2024-07-05/one-a/point-1"]
    assert made.where("kind = 'recording'").first().topics == ["Faith"]


def test_feed_and_plan(spark, tmp_path):
    entry = "<entry><videoId>{0}</videoId><title>t</title><published>{1}</published></entry>"
    (tmp_path / "f.xml").write_text("<feed>" + entry.format("v1", "2024-01-01T00:00:00Z") * 2 + entry.format("v2", "2024-01-01T00:00:00") + "</feed>")
    assert [r.video_id for r in sources.read_feed(spark, f"file://{tmp_path}/f.xml").collect()] == ["v1"]
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("k", "x"), ("m", "x")], "v string, body string")
    known = spark.createDataFrame([("k",)], "v string")
    issues = spark.createDataFrame([("b", 1, "open", "x"), ("c", 2, "open", "x"), ("d", 3, "closed", "q"), ("m", 4, "open", "x"), ("m", 5, "open", "x")], "v string, number int, state string, body string")
    assert {r.v: r.action for r in archive.upsert_plan(e, known, issues, "v").collect()} == {"a": "create", "c": "update", "m": "fail"}


def test_discovery_stream_is_idempotent(spark, tmp_path):
    from outcrop.streaming import jobs

    inbox, known = tmp_path / "in", tmp_path / "known"
    spark.createDataFrame([("a", "x"), ("k", "x")], "v string, body string").write.parquet(str(inbox))
    spark.createDataFrame([("k", -1)], "v string, batch bigint").write.parquet(f"{known}/part=-1")
    issues = spark.createDataFrame([], "v string, number int, state string, body string")
    for _ in range(2):
        stream = spark.readStream.schema("v string, body string").parquet(str(inbox))
        jobs.discover(stream, str(known), issues, "v", str(tmp_path / "cp")).awaitTermination()
    plans = spark.read.parquet(str(tmp_path / "cp/plans"))
    assert [(r.v, r.action) for r in plans.collect()] == [("a", "create")]
