import random

import pytest
from pyspark.sql import functions as F

from outcrop.functions import scripture as S
from outcrop.functions import text as T
from outcrop.functions import timecode
from outcrop.operators import search

COUNTS = {"Genesis": [31, 25], "Romans": [32, 29, 31, 25, 21, 23, 25, 39, 33, 21, 36, 21, 14, 23, 33, 27], "John": [51, 25, 36, 54], "1 John": [10, 29, 24], "Jude": [25]}


@pytest.mark.parametrize(("given", "canonical"), [
    ("Rom 12:1", "Romans 12:1"), ("rom. 12:1–2", "Romans 12:1-2"), ("Romans 12:1-12:2", "Romans 12:1-2"), ("John 3:16-16", "John 3:16"), ("I John 2", "1 John 2"), ("1jn 2:1", "1 John 2:1"),
    ("Romans 12-13", "Romans 12-13"), ("Romans 12:20-13:2", "Romans 12:20-13:2"), ("Ｒomans 12", "Romans 12"),
])
def test_references(given, canonical):
    assert S.parse(given, COUNTS).canonical == canonical


@pytest.mark.parametrize("given", ["", "Romans", "Romans 17", "Romans 12:22", "Romans 3-4:2", "Romans 12:5-2", "Nowhere 1:1", "Romans 0:1", "Romans 13-12", None])
def test_not_references(given):
    assert S.parse(given, COUNTS) is None


def test_mentions():
    found = lambda t: [r.canonical for r in S.mentions(t, COUNTS)]
    assert found("see Romans 12:1; John 3:16 and more") == ["Romans 12:1", "John 3:16"]
    assert found("he read 1 John 2:1, then Jude 3.") == ["1 John 2:1"]
    assert found("the john 3 of it, genesis 1 unread, mark 2 things") == ["John 3", "Genesis 1"]
    assert found(None) == []


def test_overlap_and_coverage_against_sets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        lo = rng.randint(1, 30)
        hi = rng.randint(lo, 36)
        spans = [(a, rng.randint(a, 36)) for a in (rng.randint(1, 36) for _ in range(rng.randint(0, 4)))]
        rows.append((i, lo, hi, spans))
    df = spark.createDataFrame(rows, "i int, lo int, hi int, spans array<struct<lo:int,hi:int>>")
    for r in df.select("lo", "hi", "spans", S.coverage(F.col("spans"), F.col("lo"), F.col("hi")).alias("c")).collect():
        wanted = set(range(r.lo, r.hi + 1))
        covered = {x for s in r.spans for x in range(s.lo, s.hi + 1)} & wanted
        assert r.c == pytest.approx(len(covered) / len(wanted))


def test_stems_alike_in_both_forms(spark):
    given = "cities buses class focus basis famous walking sing stopped running hoped the loves love agreed planned passes been a über made".split()
    df = spark.createDataFrame([(w,) for w in given], "w string").select("w", T.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == {w: T.stem_word(w) for w in given}
    assert T.stem_word("cities") == "city" and T.stem_word("stopped") == "stop" and T.stem_word("sing") == "sing"


def test_clock(spark):
    df = spark.createDataFrame([("75:30",), ("1:02:03.5",), ("1:75",), ("x",), (None,)], "c string").select(timecode.seconds(F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == [4530.0, 3723.5, None, None, None]


@pytest.mark.parametrize(("q", "iso"), [("5 July 2024", "2024-07-05"), ("July 5, 2024", "2024-07-05"), ("2024-02-29", "2024-02-29"), ("29 Feb. 2024", "2024-02-29"), ("1 sept 2023", "2023-09-01"), ("30 Feb 2024", None), ("2024-7-5", None), ("July", None)])
def test_full_date(q, iso):
    assert (search.full_date(q) and search.full_date(q).isoformat()) == iso


def test_fnv(spark):
    def plain(t):
        h = 0x811C9DC5
        for c in t:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    given = ["", "a", "2026-08-16", "hello world"]
    df = spark.createDataFrame([(x,) for x in given], "t string").select("t", T.fnv1a(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: plain(t) for t in given}
