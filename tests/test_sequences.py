import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcrop.operators import artifacts, evaluate, sequences, timeline
from tests.test_display import lcs


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables would be one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "a", "a"]), i, rng.randint(0, 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i int, x int").repartition(6)


def test_previous_rows_and_numbers_over_range_borders(spark):
    rows, df = rows_of(spark, 500, 1)
    got = {(r.i): r.previous_x for r in sequences.with_previous(df, ["k"], ["i"], ["x"]).collect()}
    numbers = {r.i: (r.n, r.m) for r in sequences.numbered(sequences.numbered(df, ["k"], ["i"]).drop("_range"), ["k"], ["i"], "m", F.col("x") == 0).collect()}
    assert sequences.ranged(df, ["k"], ["i"]).select("_range").distinct().count() > 1
    last, n, zeros = {}, {}, {}
    for k, i, x in rows:
        n[k] = n.get(k, 0) + 1
        zeros[k] = zeros.get(k, 0) + (x == 0)
        assert got[i] == last.get(k) and numbers[i] == (n[k], zeros[k])
        last[k] = x
    assert sequences.runs(df.where("false"), ["k"], ["i"], ["x"], F.col("x") == 0).collect() == []


def test_runs_restart(spark):
    rows, df = rows_of(spark, 300, 2)
    got = {r.i: r.run for r in sequences.runs(df, ["k"], ["i"], ["x"], F.col("x") < F.col("previous_x")).collect()}
    state = {}
    for k, i, x in rows:
        last, run = state.get(k, (None, 0))
        state[k] = (x, run + (last is None or x < last))
        assert got[i] == state[k][1]


def plain_rolled(lines):
    out = []
    for start, end, text in lines:
        if out and text == out[-1][2]:
            out[-1][1] = max(out[-1][1], end)
        elif out and text.startswith(out[-1][2] + " "):
            out.append([start, end, text[len(out[-1][2]) + 1 :]])
        else:
            out.append([start, end, text])
    return [tuple(x) for x in out]


def test_rolling_captions_in_cue_order(spark):
    rng = random.Random(5)
    lines, said = {k: [] for k in "pqr"}, []
    for k in lines:
        said = []
        for i in range(400):
            kind = rng.random()
            if kind < 0.4 and said:
                said = said[-rng.randint(1, 4) :] + [rng.choice("xyz") for _ in range(rng.randint(0, 2))]
            elif kind < 0.8 or not said:
                said = [*said, rng.choice("xyz")][-6:]
            else:
                said = [rng.choice("uvw") for _ in range(rng.randint(1, 3))]
            lines[k].append((float(1000 - i if k == "q" else i), float(i % 50 + i), " ".join(said)))
    rows = [(k, i, *x) for k, xs in lines.items() for i, x in enumerate(xs)] + [("p", 9000, 0.0, 1.0, " "), ("p", 9001, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, o int, start double, end double, text string").repartition(5)
    got = timeline.rolled(df, "k", order="o").collect()
    for k, xs in lines.items():
        assert sorted((r.start, r.end, r.text) for r in got if r.k == k) == sorted(plain_rolled(xs))


def test_rows_of_points(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 400), 1000 + rng.randint(0, 50)])), i) for i in range(300)]
    got = {r.i: r.row for r in evaluate.stacked(spark.createDataFrame(points, "k string, t double, i int").repartition(4), "k", "t", 7.0, ["i"]).collect()}
    for k in "ab":
        free = []
        for t, i in sorted((t, i) for c, t, i in points if c == k):
            place = next((n for n, x in enumerate(free) if t >= x), len(free))
            free[place : place + 1] = [t + 7.0]
            assert got[i] == place
    seen = evaluate.in_view(spark.createDataFrame([(-20.0,), (0.0,), (50.0,), (111.9,), (113.0,)], "t double"), "t", 0.0, 100.0, 100.0)
    assert sorted(r.left for r in seen.collect()) == [0.0, 50.0, 111.9]


def test_linear_space_difference():
    rng = random.Random(8)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 25))], np.int64) for _ in range(2))
        pairs = artifacts._common(a, b)
        assert len(pairs) == lcs(a.tolist(), b.tolist()) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    n = 6000
    a = [str(i % 977) for i in range(n)]
    rows = artifacts._diff("\n".join(a), "\n".join(a[:3000] + ["new"] + a[3005:]), 2)
    assert [k for _, k, _ in rows] == ["same"] * 2 + ["removed"] * 5 + ["added"] + ["same"] * 2


def test_hunks_are_apart_by_more_than_their_context():
    a = [str(i) for i in range(30)]
    at = lambda *changed: [h for h, k, _ in artifacts._diff("\n".join(a), "\n".join("x" if i in changed else x for i, x in enumerate(a)), 3) if k == "added"]
    assert at(5, 12) == [1, 1] and at(5, 13) == [1, 2]


def test_leaks_behind_escapes(spark):
    said = "one two three four five sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty"
    hidden = said.replace(" ", "&#32;", 3).replace("five", "<b>five</b>").replace("sixteen", "\\u0073ixteen").replace("twenty", "&amp;twenty").replace("fifty", "ﬁfty").replace("forty", "\\u0026#102;orty")
    public = spark.createDataFrame([(1, said), (2, hidden), (3, "nothing"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.n_shared for r in timeline.shingle_leaks(public, spark.createDataFrame([(said,)], "text string")).collect()}
    assert got == {1: 3, 2: 3}


def test_private_folders_and_recording_files(spark):
    files = spark.createDataFrame([("services/2024-07-05-2.yaml", ""), ("services/notes.md", ""), ("site/public/models/x.json", ""), ("docs/node.md", "")], "path string, content string")
    assert {r.path: r.problem for r in artifacts.forbidden(files, "path", "content").collect()} == {"services/notes.md": "no recording file", "site/public/models/x.json": "private, media or cache file"}
