import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcrop.llm import conversation_trie, language_id, vector_codes
from outcrop.llm.quality_classifier import held_out

# --- 11

SAID = {
    "en": "the of and to in is that it was for on are with as his they at be this have from or one had by word but not what all were we when your can said there".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie".split(),
    "el": "και το να του η της με που την από για είναι στο ο οι τα θα δεν τον σε μια στην αλλά αυτό όπως έχει τους κατά μετά πολύ ένα".split(),
}
TEXTS = "doc_id bigint, text string, lang string"


def said(rng, lang, n):
    return " ".join(rng.choice(SAID[lang]) for _ in range(n))


def test_languages_held_out(spark):
    rng = random.Random(2)
    rows = [(i, said(rng, lang, rng.randint(3, 80)), lang) for i in range(900) for lang in [rng.choice(list(SAID))]]
    docs = spark.createDataFrame(rows, TEXTS)
    model = language_id.fit(docs.where(~held_out()))
    assert [m[0] for m in model] == sorted(SAID) and all(len(a) <= language_id.DICTIONARY and len(b) <= language_id.CONTEXT for _, a, b in model)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    asked = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(found) == 900 and sum(found[i].lang_pred == lang for i, _, lang in asked) >= 0.98 * len(asked)
    assert all(0 <= r.score <= 1 and r.rejected == (r.score < language_id.LEAST) for r in found.values())


def test_sizes_are_those_of_the_encoder(spark):
    rng = random.Random(4)
    model = [(lang, said(rng, lang, 3000).encode(), said(rng, lang, 300).encode()) for lang in SAID]
    e = language_id.Encoders(model)
    text = said(rng, "de", 5000).encode()
    whole = [sum(len(encode(context + text[i : i + language_id.PIECE])) - len(encode(context)) for i in range(0, len(text), language_id.PIECE)) for encode, context, _ in e.by]
    assert e.sizes(text) == whole and e.best(text)[0] == "de"  # the whole text counts, piece by piece
    end = text + said(rng, "el", 50_000).encode()
    assert e.best(end)[0] == "el"


def test_languages_of_odd_rows(spark):
    odd = [(1, None, "en"), (2, "", "en"), (3, " 12 #\n", "de"), (4, "the of and", None), (None, "the of and", "en"), (5, "the of and", "en"), (5, "the of and", "en"), (6, "́̂", "en"), (7, "x" * 300_000, "de")]
    docs = spark.createDataFrame(odd, TEXTS).withColumns({c: F.lit(1) for c in ("score", "rejected", "lang_pred", "held_out", "share", "chunk", "place", "count")})
    found = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(found) == len(odd)
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.lang_pred, r.score, r.rejected))
    assert all(by[i] == [("und", 0.0, True)] for i in (1, 2, 3, 6)) and len(by[5]) == 2 and by[5][0] == by[5][1]
    assert {x[0] for i in (4, 5, 7) for x in by[i]} <= {"en", "de"}
    empty = docs.where("false")
    assert language_id.fit(empty) == [] and language_id.identify(empty, []).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs.where("doc_id = 5"), [("en", b"", b"")]).collect()} == {("en", 1.0)}


# --- 12

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(a, b) for _, _, a, b in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: h[c]] + t[h[c] :]) for c, t in own.items()}


def plain_nodes(sequences):
    """(min member, depth, parent's, members, children, leaves, saved, digest) of every prefix, from sets."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def nodes_of(df):
    return sorted(((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit,fan", [(200_000, 256), (40, 256), (25, 2), (1, 2)])
def test_trie_against_sets(spark, limit, fan):
    rng = random.Random(limit)
    rows = []
    for c in rng.sample(range(700), 250):
        for t in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None]), rng.choice(["a", "bb", "", None, "a longer turn ü"])))
    rows += [(900 + c, t, "user", "always the same") for c in range(150) for t in range(3)]  # one conversation that many share
    rows += [(None, 1, "user", "nobody's"), rows[0], rows[0]]
    got = conversation_trie.nodes(conversation_trie.rebuilt(spark.createDataFrame(rows, TURNS).repartition(6)), limit, fan)
    assert nodes_of(got) == plain_nodes(plain_rebuilt(rows))


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.nodes(conversation_trie.rebuilt(empty)).collect() == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(turnless, 0, "user", "gone"), (turnless, 1, "user", "gone too")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("path", "key", "kind", "base", "h", "head", "turns", "sizes", "label", "size")})
    assert nodes_of(conversation_trie.nodes(conversation_trie.rebuilt(df))) == [(turnless, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    long = [(0, t, "user", f"turn {t}") for t in range(3000)]
    got = nodes_of(conversation_trie.nodes(conversation_trie.rebuilt(spark.createDataFrame(long, TURNS)), limit=500))
    assert len(got) == 3001 and {r[5] for r in got} == {1}


def test_louds_round_trip(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(200) for t in range(rng.randint(0, 5))]
    conversations = conversation_trie.labelled(spark.createDataFrame(rows, TURNS))
    want = {p for r in conversations.collect() for p in [tuple(t.label for t in r.turns)] for p in [p[:d] for d in range(len(p) + 1)]}
    got = set()
    for shard in conversation_trie.tries(conversations, limit=60).collect():
        louds = conversation_trie.Louds.of(bytes(shard.bits))
        labels = [bytes(shard.labels[i : i + 16]).hex() for i in range(0, len(shard.labels), 16)]
        parents, paths = louds.parents(), [()]
        assert len(parents) == len(labels) + 1 and len(louds.bits) == 2 * len(parents) + 1 and louds.degrees().sum() == len(labels)
        for i, label in enumerate(labels, 1):
            assert parents[i] < i
            paths.append((*paths[parents[i]], label))
        got |= set(paths)
    assert got == want


# --- 13

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds):
    """Lloyd by whole comparison."""
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([r[1] for r in kept], np.int64)
    cut = vector_codes.cuts(x.shape[1], parts)
    pieces = [x[:, a:b] for a, b in zip(cut, cut[1:])]
    books = [p[:entries].copy() for p in pieces]
    nearest = lambda: [((p[:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in zip(pieces, books)]
    for _ in range(rounds):
        for p, b, a in zip(pieces, books, nearest()):
            for e in range(len(b)):
                if (a == e).any():
                    b[e] = p[a == e].sum(0) // (a == e).sum()
    codes = np.stack(nearest(), 1)
    error = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(pieces, books, codes.T))
    return sorted((str(r[0]), bytes(c.astype(np.uint8)).hex(), int(e)) for r, c, e in zip(kept, codes, error)), hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


@pytest.mark.parametrize("parts,entries,rounds,block,scale", [(4, 8, 2, 64, 1.0), (3, 5, 6, 16, 0.01), (16, 64, 2, 4096, 1.0), (4, 8, 3, 7, 1e5)])
def test_codes_against_whole_comparison(spark, parts, entries, rounds, block, scale):
    rng = np.random.default_rng(parts)
    centres = rng.normal(size=(6, 20))
    rows = [(int(i), [float(x) for x in np.round(centres[i % 6] + rng.normal(0, 0.3, 20), 1) * scale], int(i % 4) if i % 5 else None) for i in rng.permutation(400)]
    rows += [rows[0]] * 40 + [(None, rows[1][1], 1)]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, VECTORS).repartition(5), parts, entries, rounds, block)
    want, digest = plain_codes(rows, parts, entries, rounds)
    assert sorted((str(r.vec_id), r.code, r.error) for r in coded.collect()) == want and books.sha256 == digest


def test_heaps_spare_comparisons():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(-20, 20, (500, 4)) + c for c in ([0] * 4, [900] * 4, [-900] * 4)]).astype(np.int64)
    books = vector_codes.Codebooks([data[[0, 500, 1000]]], np.zeros((1, 3), np.int64))
    b = vector_codes.Block(data, np.zeros((1500, 1), np.uint8), [[[], [], []]])
    b.assign(books, first=True)
    assert b.rescanned == 1500
    moved = vector_codes.Codebooks([books.entries[0] + 3], books.drift + 6 * vector_codes.UNIT + 1)
    assert b.assign(moved) == [] and b.rescanned == 1500  # far apart: no bound is violated
    far = vector_codes.Codebooks([books.entries[0][[1, 0, 2]]], books.drift + (1 << 40))
    (_, rows, before, after), = b.assign(far)
    assert b.rescanned == 3000 and len(rows) == 1000 and set(zip(before.tolist(), after.tolist())) == {(0, 1), (1, 0)}
    again = vector_codes.Block.unpacked(1500, *b.packed(), 1, 3)
    assert again.heaps == b.heaps and (again.data == data).all() and (again.codes == b.codes).all()


def test_codes_of_odd_vectors(spark):
    rows = [(3, [1.0, 2.0, 3.0], 1), (1, None, 1), (2, [], 1), (4, [1.0, None, 3.0], 2), (5, [float("nan"), 1.0, 1.0], 2), (6, [float("inf"), 1.0, 1.0], 2), (7, [1.0, 2.0], 2), (8, [-0.001, 0.0, 1e30], None), (9, [-0.001, 0.0, 1e30], None), (3, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("v", "code", "error", "ids", "data", "label_error", "l")})
    coded, books = vector_codes.encode(df, parts=16, entries=64)
    got = vector_codes.with_label_errors(coded).collect()
    assert sorted(r.vec_id for r in got) == [3, 3, 8, 9] and len(books.entries[0]) == 4 and {len(r.code) for r in got} == {32}
    assert {r.error for r in got} == {0}
    none, books = vector_codes.encode(df.where("false"))
    assert none.collect() == [] and books is None and vector_codes.with_label_errors(none).collect() == []
    by = vector_codes.with_label_errors(spark.createDataFrame([(1, "a", "00", 5), (2, None, "00", 7), (3, None, "00", 8), (4, "a", "00", 1)], "vec_id bigint, label string, code string, error bigint"))
    assert {r.vec_id: r.label_error for r in by.collect()} == {1: 6, 4: 6, 2: 15, 3: 15}
