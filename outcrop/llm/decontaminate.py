"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are normalised (lower case, every white-space run one space). An item of m characters may occur in
a text with up to k = m * errors // 100 edits. Cut into k + 1 pieces, at least one piece then occurs unchanged, so exact piece hits
(one Aho-Corasick pass over each text) are a complete candidate search; around each hit the item is verified with Myers'
bit-parallel edit distance, both ends free. An end of the occurrence in the middle of a word, where the item's own end is a letter or digit, is an edit too: so
an item too short for any edits stands between word borders, and a long one may touch a word within its budget.

The benchmark is the stated query set: it is sent to the executors in blocks of at most `block_chars` characters, however
large it is, and every text meets every block. Texts are neither shuffled nor collected; a hit's windows are merged, so
a text that repeats a piece thousands of times is still verified once for each stretch.

Defined results: a null, empty or blank text or item matches nothing; items without an id have no row in find(), which names items by
id, but count in clean(); equal items are searched once and each reported; repeated
texts are each reported; empty tables give an empty result; columns other than the id and the text are not read by find().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ERRORS = 5  #: percent of an item's characters
BLOCK_CHARS = 8_000_000
_SPACE = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip().lower()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in k + 1 parts of nearly equal length."""
    parts = len(item) * errors // 100 + 1
    cuts = [i * len(item) // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(item: str, text: str, anchored: bool = False) -> Iterator[tuple[int, int]]:
    """(end, edits) for every end in text: the fewest edits that make the item of a stretch that ends there, and begins anywhere or, if anchored, at 0."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        hp, hn = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1 | anchored) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(x | hp)), hp & x
        yield j + 1, score


def best_match(item: str, text: str, most: int, begin: int = 0, stop: int | None = None) -> tuple[int, int] | None:
    """(edits, end) of the item's best occurrence in text[begin:stop], the first of equals, broken words at its ends included; None if it takes more than `most` edits."""
    stop = len(text) if stop is None else min(stop, len(text))
    ends = [(edits, begin + j) for j, edits in distances(item, text[begin:stop]) if edits <= most]
    broken = lambda at, own: 0 < at < len(text) and own.isalnum() and text[at - 1].isalnum() and text[at].isalnum()
    best = (most + 1, -1)
    back = item[::-1]
    for edits, end in sorted(ends):
        if edits >= best[0]:
            break
        after = broken(end, item[-1])
        low = max(0, end - len(item) - most)
        # Every beginning that this end may have, from the end backwards.
        total = min((d + after + broken(end - n, item[0]) for n, d in distances(back, text[low:end][::-1], anchored=True) if d <= most), default=most + 1)
        best = min(best, (total, end))
    return best if best[0] <= most else None


class Matcher:
    """A block of (id, item), with an automaton that leads from each piece to the items and offsets it stands for. Made once in a task."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], errors: int):
        self.items, self.errors = items, errors
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item, errors):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item's place, edits, end in the normalised text) for every item that occurs in text."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                item = self.items[n][1]
                k = len(item) * self.errors // 100
                start = end + 1 - length - offset
                a, b = max(0, start - k), start + len(item) + k
                own = windows.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(b, own[-1][1])
                    own[-1][0] = min(a, own[-1][0])
                else:
                    own.append([a, b])
        for n, own in sorted(windows.items()):
            item = self.items[n][1]
            found = [m for a, b in own if (m := best_match(item, text, len(item) * self.errors // 100, a, b))]
            if found:
                yield (n, *min(found))


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items in blocks of at most block_chars characters (one longer item alone), in order of id; those without an id if `unnamed`. One block is on the driver at a time."""
    rows = benchmark.where("text is not null" if unnamed else "item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    block: list[tuple[int | None, str]] = []
    held = 0
    for row in rows.toLocalIterator():
        item = normalised(row.text)
        if not item:
            continue
        if block and held + len(item) > block_chars:
            yield tuple(block)
            block, held = [], 0
        block.append((row.item_id, item))
        held += len(item)
    if block:
        yield tuple(block)


def find(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, match_end) of every item that occurs in a text within its error budget."""
    schema = "doc_id bigint, item_id bigint, edits int, match_end bigint"
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).where("text is not null")
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)  # at most block_chars characters

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, errors)
            for frame in frames:
                rows = [(d, matcher.items[n][0], e, end) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for n, e, end in matcher.matches(normalised(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "match_end"])

        out = out.unionByName(source.mapInPandas(scan, schema))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def _free(sent, errors: int):
    """A function of texts: whether none of the items in the broadcast block occurs."""

    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, errors)
        for texts in batches:
            yield pd.Series([t is None or next(matcher.matches(normalised(t)), None) is None for t in texts], dtype=bool)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, errors: int = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text has no benchmark item in it, with their own columns; each row by its own text, whatever its doc_id."""
    for block in blocks(benchmark, block_chars, unnamed=True):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most block_chars characters
        docs = docs.where(_free(sent, errors)(docs["text"]))
    return docs
