import datetime
import gzip
import hashlib
import json

from pyspark.sql import functions as F

from outcrop.functions import addresses, timecode
from outcrop.operators import archive, display, evaluate, timeline, vectors, verify
from outcrop.sources import archive as sources
from outcrop.sources import known
from tests.test_functions import COUNTS
from tests.test_operators import GOOD


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- builds


def test_tables_as_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "w")], "k int, v string")
    assert rows(verify.table_differences(a, b)) == [(1, "x", 1), (2, None, -1), (3, "z", 1), (4, "w", -1)]
    assert rows(verify.table_differences(a, a.repartition(3))) == [] and rows(verify.table_differences(a.where("false"), a.where("false"))) == []


def test_files_and_companions(spark):
    files = [("a.json", b"one"), ("a.json.gz", gzip.compress(b"one")), ("b.json", b"two"), ("b.json.gz", gzip.compress(b"other")), ("c.json", b"three"), ("c.json.gz", b"\x1f\x8bbroken"), ("d.json", b"four"), ("e.json.gz", b"plain"), ("f.json.gz", gzip.compress(b"six"))]
    df = spark.createDataFrame(files, "path string, content binary")
    assert rows(verify.loaded(df).select("name", F.col("content").cast("string"), "source")) == [("a.json", "one", "gzip"), ("b.json", "other", "gzip"), ("c.json", "three", "raw"), ("d.json", "four", "raw"), ("e.json", "plain", "unpacked by host"), ("f.json", "six", "gzip")]
    assert rows(verify.companion_problems(df)) == [("b.json", "gzip companion differs"), ("c.json", "gzip companion differs"), ("d.json", "no gzip companion"), ("e.json", "no raw file"), ("f.json", "no raw file")]
    expected = spark.createDataFrame([("a.json", b"one"), ("b.json", b"2"), ("z", b"")], "path string, content binary")
    assert rows(verify.file_differences(df.where("path in ('a.json', 'b.json', 'd.json')"), expected)) == [("b.json", "stale"), ("d.json", "unexpected"), ("z", "missing")]
    assert df.where("path = 'a.json.gz'").select(verify.gzip_size(F.lit(b"one"))).first()[0] == len(gzip.compress(b"one", mtime=0))


def test_what_must_not_be_in_a_build(spark):
    said = "these are fourteen words that somebody said in private and nobody else should ever read again here"
    files = [
        ("index.html", f"<a href='/watch/?x=1&amp;id=3'>x</a> {said.replace(' ', '&#32;')}"), ("ok.html", "<a href='/watch/?r=3'>idle transcript: words</a>"), ("x.json", '{"note": "{\\"confidence\\": 1}"}'),
        ("_astro/semantic.worker-a1.js", "{confidence:a/(b-c),x:1}"), ("_astro/other.js", "{confidence:a/(b-c),x:1}"), ("a/transcripts/y.txt", "x"), ("services/2024/x", ""), ("img.bin", '"transcript":'),
    ]
    got = rows(verify.output_problems(spark.createDataFrame(files, "path string, content string"), spark.createDataFrame([(said,)], "text string"), timeline.shingle_leaks))
    assert got == [("_astro/other.js", "private field confidence"), ("a/transcripts/y.txt", "private or media file"), ("index.html", "link to a retired address"), ("index.html", "run of a private text"), ("services/2024/x", "private or media file"), ("x.json", "private field confidence")]


def test_metadata_and_units(spark):
    sha = "a" * 64
    good = {"schemaVersion": 6, "model": {"dim": 2, "id": "m"}, "vectors": {"file": f"vectors.{sha}.bin", "sha256": sha}, "units": [{"id": "a"}, {"id": "b"}]}
    bad = good | {"schemaVersion": 5, "more": 1, "model": {"id": "m"}, "vectors": {"file": "v.bin", "sha256": sha}, "units": [{"id": "a"}, {"id": "a"}]}
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "{}"), ("broken", "x")], "name string, content string")
    got = rows(verify.metadata_problems(df, {"id": "m", "dim": 2}))
    assert sorted(p for n, p in got if n == "bad") == ["another model", "duplicate unit a", "schema version", "unknown or missing keys", "vector file isn't named by its digest"] and {n for n, _ in got} == {"bad", "none", "broken"}
    unit = dict(unit_id="r/a", recording_id="r", recording_title="T", date="2024-07-05", kind="chapter", title="t", text=None, entry_id=None, start=1.0, end=2.0, scripture=["Romans 12:1"], scripture_display=["Rom 12:1"], topics=["x"], series=None, preview=False)
    kind = "unit_id string, recording_id string, recording_title string, date string, kind string, title string, text string, entry_id string, start double, end double, scripture array<string>, scripture_display array<string>, topics array<string>, series struct<id:string,title:string>, preview boolean"
    changes = {"point": {"kind": "point"}, "order": {"end": 1.0}, "nan": {"start": float("nan")}, "blank": {"title": " "}, "shown": {"scripture_display": ["Romans 12:2"]}, "plain": {"scripture": ["Rom 12:1"], "scripture_display": None}, "count": {"scripture_display": []}, "day": {"date": "5 July"}}
    made = [unit, *(unit | {"unit_id": n} | c for n, c in changes.items())]
    got = rows(verify.unit_problems(spark.createDataFrame([tuple(m[k.split()[0]] for k in kind.split(", ")) for m in made], kind), COUNTS))
    assert sorted(got) == [("blank", "title"), ("count", "references shown"), ("day", "date"), ("nan", "end"), ("nan", "start"), ("order", "end"), ("plain", "reference isn't canonical"), ("point", "end"), ("shown", "what is shown is another reference")]


def test_verse_index(spark):
    refs = spark.createDataFrame([("Romans 12:1-2", "Romans 12:1"), ("Romans 12:1-2", "Romans 12:2"), ("Romans 12:1-2", "Romans 12:2"), ("Rom 12", "Romans 12:3"), ("Romans 13", "Romans 13")], "canonical string, key string")
    verses = spark.createDataFrame([("Romans 12:1", "a"), ("Romans 12:2", "b"), ("Romans 13", "c"), ("John 3:16", "d")], "key string, text string")
    assert rows(verify.verse_index_problems(refs, verses, COUNTS)) == [("John 3:16", "unreferenced verse"), ("Rom 12", "reference isn't canonical"), ("Romans 12:1-2", "a verse twice"), ("Romans 12:3", "missing verse"), ("Romans 13", "no single verse")]


def test_issue_places(spark):
    issues = spark.createDataFrame([("chapters.0.points.1.text",), ("chapters.0.title",), ("chapters.01",), ("x",), (None,)], "path string")
    places = spark.createDataFrame([("chapters.0", "c"), ("chapters.0.points.1", "p"), ("chapters", "all")], "path string, item string")
    assert rows(verify.placed(issues, places)) == [("chapters.0.points.1.text", "p"), ("chapters.0.title", "c"), ("chapters.01", "all"), ("x", None), (None, None)]


# --- scans


def test_verse_scan(spark, tmp_path):
    head = ["a title", "", "Verse\tText"]
    lines = ["Genesis 1:1\ta", "Genesis 1:2\tb", "Gen 1:4\tc", "Genesis 1:4\tc", "Genesis 3:1\td", "nonsense", "Exodus 1:2\te", "Nobook 1:1\tf", "Exodus 0:1\tg", "Genesis 3:2\th", "Deuteronomy 1:1\ti", "Deuteronomy 1:1\tj\tk"]
    (tmp_path / "v.txt").write_text("﻿" + "\n".join(head + lines) + "\n\n")
    read = known.read_verse_lines(spark, f"file://{tmp_path}/v.txt", "Verse\tText")
    assert read.count() == len(lines)
    got = rows(known.verse_problems(read, books=66).orderBy("line"))
    assert sorted(got, key=lambda r: (r[0] is None, r[0], r[1])) == [
        (5, "missing verses 3 of Gen 1"), (6, "repeated verse Genesis 1:4"), (7, "missing chapters 2 of Genesis"), (8, "malformed row: nonsense"), (9, "missing verses 1 of Exodus 1"), (10, "unknown book Nobook"),
        (11, "malformed row: Exodus 0:1\tg"), (12, "book out of order: Genesis 3:2"), (13, "missing books before Deuteronomy"), (14, "malformed row: Deuteronomy 1:1\tj\tk"), (None, "3 books instead of 66"),
    ]
    whole = [f"{b} {c}:{v}\tx" for b in ("Genesis", "Exodus") for c in (1, 2) for v in range(1, 150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    good = known.verse_lines(spark.createDataFrame(list(enumerate(whole)), "line int, value string"))
    assert rows(known.verse_problems(good)) == [] and rows(known.verse_problems(good.where("line <> 77"))) == [(78, "missing verses 78 of Genesis 1")]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_in_any_nesting(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yaml").write_text("videos:\n- youtube_id: abcdefghijk\n  more: {youtube_id: [zzzzzzzzzzz]}\n- youtube_id: 12345\n")
    (tmp_path / "deep" / "b.yml").write_text("youtube_id: AAAAAAAAAAA\nx: [[[{y: {youtube_id: abcdefghijk}}]]]\n")
    (tmp_path / "c.yaml").write_text("a: [\n")
    (tmp_path / "d.txt").write_text("youtube_id: ignored0000\n")
    docs = known.read_documents(spark, f"file://{tmp_path}")
    assert docs.count() == 3 and docs.where("json is null").count() == 1
    ids, problems = known.known_ids(docs, spark.createDataFrame([("abcdefghijk",), ("upload00000",), (None,)], "youtube_id string"), "file", "json")
    assert rows(ids) == [("AAAAAAAAAAA",), ("abcdefghijk",), ("upload00000",)]
    assert [r.problem for r in problems.orderBy("problem").collect()] == ["invalid id 12345", 'invalid id ["zzzzzzzzzzz"]']
    assert rows(known.values_of(docs.where("false"), "k", "file", "json")) == []


# --- browsing, addresses, times


def test_facets_as_rows(spark):
    items = spark.createDataFrame([("r1", "2024-01-01", ["b", "a"]), ("r2", "2024-03-01", ["a", "a"]), ("r3", "2024-02-01", None), ("r4", "2024-03-01", ["c"])], "id string, day string, t array<string>")
    flat = items.select("id", "day", F.explode("t").alias("t"))
    got = archive.facet_rows(flat, "topics", F.col("t"), F.upper("t"), [F.col("t")], "id", [-F.unix_date(F.col("day").cast("date")), F.col("id")])
    assert rows(got) == [("topics", "a", "A", 1, 2, "r1", 2), ("topics", "a", "A", 1, 2, "r2", 1), ("topics", "b", "B", 2, 1, "r1", 1), ("topics", "c", "C", 3, 1, "r4", 1)]
    assert rows(archive.facet_rows(flat.where("false"), "topics", F.col("t"), F.col("t"), [F.col("t")], "id", [F.col("id")])) == []


def test_cards_and_home(spark, tmp_path):
    for day, kind in (("2024-07-05", "sermon"), ("2024-07-12", "music"), ("2024-07-01", "sermon")):
        (tmp_path / f"{day}.yaml").write_text(GOOD.replace("2024-07-05", day).replace("chapterKind: sermon", f"chapterKind: {kind}").replace('chapterStart: "0:00"', 'chapterStart: "0:30"'))
    made = display.cards(sources.read_recordings(spark, f"file://{tmp_path}/*.yaml"), "/")
    assert [(r.recording_id, r.has_sermon, r.start, r.href) for r in made.orderBy("place").collect()] == [("2024-07-12", False, 0.0, "/watch/?r=2024-07-12"), ("2024-07-05", True, 30.0, "/watch/?r=2024-07-05&t=30"), ("2024-07-01", True, 30.0, "/watch/?r=2024-07-01&t=30")]
    saved = spark.createDataFrame([("u", "2024-07-01", 100.5), ("v", "2024-07-01", 599.0), ("w", "gone", 5.0)], "user string, recording_id string, time double")
    got = {u: [(r.recording_id, r.role, r.href) for r in display.home(made, saved).where(F.col("user") == u).orderBy("place").collect()] for u in "uvw"}
    assert got["u"] == [("2024-07-01", "resumed", "/watch/?r=2024-07-01&t=100"), ("2024-07-12", "card", "/watch/?r=2024-07-12"), ("2024-07-05", "card", "/watch/?r=2024-07-05&t=30")]
    assert got["v"] == got["w"] == [("2024-07-05", "featured", "/watch/?r=2024-07-05&t=30"), ("2024-07-12", "card", "/watch/?r=2024-07-12"), ("2024-07-01", "card", "/watch/?r=2024-07-01&t=30")]
    series = spark.createDataFrame([("s", "2024-07-12", 9), ("s", "2024-07-01", 2), ("s", "unknown", 1)], "series_id string, recording_id string, ord int")
    assert [(r.recording_id, r.context) for r in display.in_series(made, series).orderBy("position").collect()] == [("2024-07-01", "Part 1 of 2"), ("2024-07-12", "Part 2 of 2")]


def column(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_addresses(spark):
    assert column(spark, addresses.base_path, ["", "/", "a/b/", "a b", "/x-1_Y"]) == ["/", "/", "/a/b/", None, "/x-1_Y/"]
    assert column(spark, lambda c: addresses.search_url(F.lit("/"), c), [" grace & peace ", "", None]) == ["/search/?q=grace+%26+peace", "/search/", "/search/"]
    assert column(spark, lambda c: addresses.browse_url(F.lit(""), c), ["scripture/1 john", ""]) == ["/browse/scripture/1%20john/", "/browse/"]
    assert column(spark, lambda c: addresses.edit_url(F.lit(""), F.lit("2024-07-05"), c), [0.0, 61.9, None], "double") == ["/edit/2024-07-05/", "/edit/2024-07-05/?t=61", "/edit/2024-07-05/"]
    assert column(spark, lambda c: addresses.youtube_url(F.lit("abc"), c), [-3.0, 7.8], "double") == ["https://www.youtube.com/watch?v=abc&t=0", "https://www.youtube.com/watch?v=abc&t=7"]
    assert column(spark, addresses.scripture_url, ["Romans 12:1-2"]) == ["https://www.esv.org/Romans%2012%3A1-2/"]
    given = ["https://github.com/a/b.git", "https://github.com/a/b/", "https://github.com/a/..", "https://github.com/a/b?x", "http://github.com/a/b", "https://u@github.com/a/b"]
    assert column(spark, addresses.repository_url, given) == ["https://github.com/a/b", "https://github.com/a/b", None, None, None, None]
    given = ["mailto:a@b.org", "https://x.org/f?q=1", "https://u:p@x.org/", "ftp://x.org", "https://x.org/%0A", "mailto:a b@c.org"]
    assert column(spark, addresses.correction_url, given) == [given[0], given[1], None, None, None, None]
    given = ["main", "feature/x-1", "HEAD", "@", "a..b", "a b", "-x", "a/.b", "a.lock", "a//b", "x@{1}", "end.", "tab\t"]
    assert column(spark, addresses.source_ref, given) == given[:2] + [None] * 11


def test_times_and_names(spark):
    assert column(spark, timecode.duration, [6600.0, 3600.0, 725.0, 76.0, 45.4, -1.0, 59.5], "double") == ["1 h 50 min", "1 h", "12 min", "1 min 16 s", "45 s", "0 s", "1 min"]
    assert column(spark, timecode.type_name, ["sermon_part", "music", "a--b"]) == ["Sermon part", "Music", "A b"] and column(spark, timecode.long_date, [datetime.date(2024, 7, 5)], "date") == ["5 July 2024"]
    assert column(spark, timecode.timestamp, [0.0, 3725.0416, 59.9996], "double") == ["00:00:00.000", "01:02:05.042", "00:01:00.000"]
    at = spark.createDataFrame([(0.0, 100.0, 200.0), (0.0, 20.0, 200.0), (5.0, 5.0, 9.0), (0.0, 300.0, 200.0)], "a double, b double, n double")
    assert [r[0] for r in at.select(evaluate.candidate_times(F.col("a"), F.col("b"), F.col("n"))).collect()] == [[32.0, 47.0, 62.0], [0.0], None, None]
    assert column(spark, vectors.blob_sha1, ["hello\n", "é"]) == ["ce013625030ba8dba906f756967f9e9ca394464a", hashlib.sha1(b"blob 2\0" + "é".encode()).hexdigest()]
    assert column(spark, vectors.quantise, [[1.0, float("inf")], [float("nan")], [None, 1.0], [0.0], []], "array<double>") == [None, None, None, [0], []]


# --- streams


def put(spark, at, n, rows_, kind):
    spark.createDataFrame(rows_, kind).coalesce(1).write.parquet(f"{at}/part{n}")


def day(s):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)


def ran(spark, made, out, checkpoint):
    made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out))


def test_queries_settle_over_a_restart_and_late_rows(spark, tmp_path):
    from outcrop.streaming import jobs

    kind = "session string, ts timestamp, query string"
    at = tmp_path / "in"
    at.mkdir()
    made = lambda: jobs.settling(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(at)), "session", late="10 seconds")
    first = [("a", day(0.0), "g"), ("a", day(0.1), "gr"), ("a", day(0.2), "grace"), ("b", day(1.0), "x")]
    put(spark, at, 1, first, kind)
    ran(spark, made(), tmp_path / "out", tmp_path / "cp")
    second = [("a", day(5.0), "mercy"), ("a", day(4.9), "merc"), ("z", day(100.0), "z")]
    put(spark, at, 2, second, kind)
    ran(spark, made(), tmp_path / "out", tmp_path / "cp")  # a new run from the same checkpoint
    put(spark, at, 3, [("a", day(2.0), "too late"), ("b", day(101.0), "y"), ("z", day(300.0), "end")], kind)
    got = ran(spark, made(), tmp_path / "out", tmp_path / "cp")
    assert rows(got.select("session", F.unix_millis("ts") % 1000000, "query")) == rows(spark.createDataFrame([(s, int(t * 1000) + 704067200000 % 1000000, q) for s, t, q in (("a", 0.2, "grace"), ("a", 5.0, "mercy"), ("b", 1.0, "x"), ("b", 101.0, "y"), ("z", 100.0, "z"))], "s string, t bigint, q string"))
    table = jobs.settled(spark.createDataFrame([*first, *second, ("b", day(101.0), "y"), ("z", day(300.0), "end")], kind), "session")
    assert rows(table.select("session", "query")) == [("a", "grace"), ("a", "mercy"), ("b", "x"), ("b", "y"), ("z", "end"), ("z", "z")]


def test_downloads_stall_finish_and_stay_closed(spark, tmp_path):
    from outcrop.streaming import jobs

    kind = "file string, ts timestamp, bytes bigint"
    at = tmp_path / "in"
    at.mkdir()
    made = lambda: jobs.meter(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(at)), "file", total=1000, warm_bytes=100, late="1 second")
    put(spark, at, 1, [("fast", day(0), 400), ("fast", day(1), 700), ("stall", day(0), 50), ("slow", day(0), 60), ("slow", day(1.5), 60), ("gone", day(0), 10)], kind)
    ran(spark, made(), tmp_path / "out", tmp_path / "cp")
    put(spark, at, 2, [("slow", day(5), 1), ("stall", day(5), 1), ("fast", day(5.5), 500), ("tick", day(6), 999)], kind)
    ran(spark, made(), tmp_path / "out", tmp_path / "cp")
    put(spark, at, 3, [("stall", day(30), 900), ("tick", day(9), 1), ("other", day(200), 1)], kind)
    put(spark, at, 4, [("other", day(205), 1)], kind)
    got = {(r.file, r.verdict, r.received) for r in ran(spark, made(), tmp_path / "out", tmp_path / "cp").collect()}
    assert got == {("fast", "done", 1100), ("slow", "slow", 121), ("stall", "slow", 51), ("tick", "done", 1000), ("gone", "slow", 10)}
    table = spark.createDataFrame([("s", day(0), 5), ("s", day(3), 6), ("s", day(20), 7), ("t", day(0), 1), ("t", day(9), 1)], kind)
    assert rows(jobs.stalled(table, "file").select("file", "received")) == [("s", 11)]


# --- transcripts and captions


def test_transcripts_of_either_kind(spark):
    json_ = lambda **x: json.dumps(x)
    files = [
        ("srt", "﻿1\n00:00:05,000 --> 00:00:06,000\nlater words\n\n2\n00:01 --> 00:02\nrolling\n\n3\n00:02 --> 00:03\nrolling <b>on</b>\n\n4\n00:03 --> 00:04\non"),
        ("clock", json_(transcription=[{"timestamps": {"from": "00:00:01,500", "to": "00:00:02,000"}, "text": " a &amp; b "}, {"offsets": {"from": 1000}, "timestamps": {"to": "0:03"}, "text": "c"}, {"text": "no time"}])),
        ("json", json_(segments=[{"start": 2, "end": 1, "text": "x"}, {"start": 1, "end": 2, "text": "<i>y</i>"}])), ("bad", "{oops"), ("none", "words"), ("empty", json_(segments=[])), ("other", json_(words=[1])), ("null", None),
    ]
    found, problems = sources.transcripts(spark.createDataFrame(files, "key string, content string"), "key")
    assert rows(found) == [("clock", 1.0, 3.0, "c"), ("clock", 1.5, 2.0, "a & b"), ("json", 1.0, 2.0, "y"), ("srt", 1.0, 2.0, "rolling"), ("srt", 2.0, 4.0, "on"), ("srt", 5.0, 6.0, "later words")]
    assert rows(problems) == [("bad", "not JSON"), ("empty", "no timed lines"), ("none", "neither JSON nor cues"), ("null", "neither JSON nor cues"), ("other", "no transcript segments")]


def test_captions_are_refused_as_a_whole(spark):
    event = lambda start, long, text="w": {"tStartMs": start, "dDurationMs": long, "segs": [{"utf8": text}]}
    files = {
        "good": [event(0, 1000, "a"), event(9000, 3000, "b"), {"tStartMs": 99999, "dDurationMs": 9, "segs": [{"utf8": " "}]}, {"wWinId": 1}], "late": [event(0, 1000), event(10001, 1)],
        "long": [event(9000, 3001)], "below": [event(-1, 5)], "untimed": [{"segs": [{"utf8": "x"}]}], "odd": [{"tStartMs": 1, "dDurationMs": 1, "segs": [{"text": "x"}]}],
    }
    df = spark.createDataFrame([(k, json.dumps({"events": v}), 10.0) for k, v in files.items()] + [("shape", "{}", 10.0), ("text", "x", 10.0)], "key string, content string, d double")
    assert rows(sources.caption_problems(df, "key", "d")) == [("below", "invalid timestamp"), ("late", "beyond the duration"), ("long", "beyond the duration"), ("odd", "invalid text segments"), ("shape", "no caption events"), ("text", "no caption events"), ("untimed", "invalid timestamp")]
    assert rows(sources.captions(df, "key", "d")) == [("good", 0.0, 1.0, "a"), ("good", 9.0, 10.0, "b")]


def test_gate_knows_words_without_their_endings(spark):
    words = spark.createDataFrame([("r", ["can't", "god's", "straße", "xyz"], 0.0, 60.0)], "k string, w array<string>, s double, e double")
    known_ = spark.createDataFrame([("can",), ("god",), ("straße",)], "word string")
    assert archive.quality_gate(words, "k", "w", known_, "s", "e").first().n_known == 3


def test_recordings_in_natural_order(spark):
    ids = ["2024-07-05-10", "2024-07-05", "2024-07-05-2", "2024-06-30", "2023-12-31-3"]
    got = sources.in_order(spark.createDataFrame([(i,) for i in ids], "id string")).orderBy("place").collect()
    assert [r.id for r in got] == ["2023-12-31-3", "2024-06-30", "2024-07-05", "2024-07-05-2", "2024-07-05-10"]


# --- links and merges


def test_links_of_pages(spark):
    files = [
        ("index.html", '<a href="a/">a</a><a href="a">a</a><a href="#x">x</a><img src="img/p%20q.png"><a href="../up">up</a><a href="//other.org/x">o</a><a href="/elsewhere">e</a><a href="mailto:x@y.z">m</a><link href=\'none.css\'>'),
        ("a/index.html", '<a href="../">home</a><a href="../a/index.html?x=1&amp;y=2#z">self</a><a href="b">b</a><a href="/s/a/../img/p q.png">p</a>'), ("img/p q.png", ""), ("note.txt", '<a href="gone">'),
    ]
    got = rows(verify.page_problems(spark.createDataFrame(files, "path string, content string"), "/s/", ("index.html", "404.html")))
    assert sorted(got, key=str) == sorted([("404.html", None, "missing route"), ("a/index.html", "b", "no such file"), ("index.html", "../up", "leaves the base"), ("index.html", "/elsewhere", "leaves the base"), ("index.html", "//other.org/x", "leaves the base"), ("index.html", "none.css", "no such file")], key=str)


def test_merging_edits_of_recordings(spark, tmp_path):
    def read(name, **changes):
        at = tmp_path / name
        at.mkdir()
        for i in range(5):
            text = GOOD + '  - chapterId: two-b\n    chapterTitle: Song\n    chapterKind: music\n    chapterStart: "9:00"\n    chapterEnd: "10:00"\n'
            for old, new in changes.get(f"r{i}", ()):
                text = text.replace(old, new)
            (at / f"2024-07-0{i}.yaml").write_text(text)
        return sources.read_recordings(spark, f"file://{at}/*.yaml")

    base = read("base")
    current = read("current", r0=[("recordingTitle: One", "recordingTitle: Now")], r1=[("chapterTitle: Song", "chapterTitle: Hymn")], r2=[('uploadDuration: "10:00"', 'uploadDuration: "11:00"')], r3=[("chapterId: two-b", "chapterId: three-c")])
    edited = read("edited", r0=[("recordingTitle: One", "recordingTitle: Mine"), ("What it says.", "More.")], r1=[("chapterTitle: Song", "chapterTitle: Psalm"), ("chapterTitle: Sermon", "chapterTitle: Talk")], r2=[("What it says.", "More.")], r3=[("chapterTitle: Song", "chapterTitle: Psalm")], r4=[("chapterId: two-b", "chapterId: four-d")])
    got = rows(archive.merge_recordings(base, current, edited, ["title", "description", "topics"], ["title", "start", "end", "points"]))
    assert got == sorted([("2024-07-00", None, "description", "apply"), ("2024-07-00", None, "title", "conflict"), ("2024-07-01", "one-a", "title", "apply"), ("2024-07-01", "two-b", "title", "conflict"), ("2024-07-02", None, "description", "apply"), ("2024-07-02", None, "uploads", "conflict"), ("2024-07-03", None, "chapters", "conflict"), ("2024-07-04", None, "chapters", "apply")], key=str)


def test_versions_are_named_by_content(spark, tmp_path):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x"))
    same = sources.content_digest(df)
    assert sources.content_digest(df.repartition(7, "x").orderBy(F.desc("id")), ) == same
    others = [df.where("id <> 17"), df.unionByName(df.where("id = 3")), df.withColumn("x", F.coalesce("x", F.lit(0))), df.withColumnRenamed("x", "y")]
    assert len({sources.content_digest(o) for o in others} | {same}) == 5
    assert sources.content_digest(df.where("false")) == sources.content_digest(df.where("id < 0"))
    at = sources.write_versioned(df, f"file://{tmp_path}/v")
    assert spark.read.parquet(at).count() == 5000 and at.endswith(same[:16])
