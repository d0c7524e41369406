"""Exact set-similarity self-join on word shingles by universe partition and pigeonhole.

A set's tokens are 64-bit hashes of its distinct word n-grams; exact means exact on these. The token universe is cut into segments by
hash. Sets are banded by size: with the threshold p/q a set's partners of equal or larger size lie in its own band or the next one, and H,
the most tokens in which two linked sets can differ, follows from the band; a set is indexed under its own band's segments and under
those of the band below. Each segment has a budget t of -1 (not looked at), 0 (equal) or 1 (equal but for one token). Budgets t + 1
add up to the number of segments m, so two linked sets agree within budget in segments whose t + 1 add up to m - H or more.

Empty segments agree without saying anything. So m is H + 1 and some more, the slack; a set whose empty segments (and, where the
budget is 1, those of one token) weigh no more than the slack agrees with every partner in a segment that has tokens in both, and
isn't indexed under its empty ones. The few other sets are. What slack is left over is spare: a set leaves out so many of its most
frequent values, frequency being counted over all sets. Two linked sets agree in more segments than either leaves out; the least
frequent value of these is left out by neither, since for that all the others would have to go before it.

Allocation by cost: every segment starts with budget 0. One pass over the texts counts, in each task, which segment values many sets
have. Where the costliest segment of a band makes more candidate pairs than the rows and pairs that one-deletion neighbourhoods
of its cheapest one would add, the former is dropped (-1) and the latter raised (1), so that the sum stays the same. The same counts
name the hot values: their sets are dealt over SALTS tasks.

Equal sets are one class from the start, so copies cost nothing. Values that several classes have are buckets, found in one shuffle of
(value, class) rows. Buckets are resolved in two steps. Every member is compared with the bucket's star, and components are taken.
In buckets of three and more whose members still lie in several components, the pairs across components are cut down by their
differences from that star, again by pigeonhole (see _near_one_centre). Before whole token sets are fetched and compared,
outlines (the number of tokens and one byte of the value of each segment) bound from below how many tokens two sets differ in, and
pairs over H are dropped. What is left is verified exactly. No link between components is lost: any two linked sets share a bucket, and
what the second step leaves out differs by too much or lies in one component.

Defined results: null, empty and blank texts have the empty set (n_tokens 0), are linked with nothing and are their own
component; a text of fewer words than n is one token of all its words; repeated rows of one id and set count once, an id with several sets
has a row for each; rows without an id have no part in naming components; an empty table gives an empty result. Other columns are not
read. keep_one() tells rows apart by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .common import Scratch
from .components import components

LONGEST = 1 << 40  # tokens of a set that bands are made for
SALTS = 256  # a value that more than 1/SALTS of the classes have is dealt over so many tasks
SKETCH = 8  # 64-bit numbers of a parity sketch
COUNTED = 1 << 20  # segment values that a task counts at a time


class Scheme(NamedTuple):
    """Of each band: its smallest size, H and the number of segments. The slack is what the segments are more than H + 1."""

    low: np.ndarray
    most: np.ndarray
    segments: np.ndarray


class Budgets(NamedTuple):
    """Slots whose budget isn't 0, and hot keys, each rising."""

    raised: np.ndarray
    dropped: np.ndarray
    hot: np.ndarray


NO_BUDGETS = Budgets(*[np.zeros(0, np.int64)] * 3)


def scheme(p: int, q: int, longest: int = LONGEST) -> Scheme:
    low = bands(longest, p, q)
    most = budget(low, p, q)
    empty = (most + 1) * np.exp(-low[:-1] / (most + 1.0))  # segments that a band's smallest sets leave empty
    return Scheme(low, most, most + 1 + np.round(empty + 2 * np.sqrt(empty)).astype(np.int64))


class Cut(NamedTuple):
    """Sets cut into segments: cells first[i] to first[i + 1] are set i's. Of each cell its slot, set, tokens and the sum of their parts; of each token its cell and part."""

    first: np.ndarray
    slot: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    total: np.ndarray
    cell: np.ndarray
    part: np.ndarray


def own_band(sizes: np.ndarray, s: Scheme) -> np.ndarray:
    return np.searchsorted(s.low, sizes, side="right") - 1


def cut(held: np.ndarray, sizes: np.ndarray, s: Scheme, band: np.ndarray) -> Cut:
    """Sets under the segments of these bands, their own or the one below. Bands that allow no difference have none: there only equal sets match."""
    at = np.maximum(band, 0)
    segments = np.where((band >= 0) & (s.most[at] > 0), s.segments[at], 0)
    first = np.concatenate([[0], np.cumsum(segments)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    on = segments[row] > 0
    t, r = tokens.mix(held[on]), row[on]
    cell = first[r] + (t % np.maximum(segments[r], 1).astype(np.uint64)).astype(np.int64)
    part = tokens.mix(t + np.uint64(1))
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, cell, part)
    owner = np.repeat(np.arange(len(sizes)), segments)
    slot = (band[owner] << 32) + (np.arange(first[-1]) - first[owner])
    return Cut(first, slot, owner, np.bincount(cell, minlength=first[-1]), total, cell, part)


def _key(slot: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The lowest bit tells a set's own band from the one below."""
    with np.errstate(over="ignore"):
        key = tokens.mix(total + tokens.mix(slot.astype(np.uint64) + np.uint64(1)))
    return key >> np.uint64(1) << np.uint64(1) | (slot >> 32 & 1).astype(np.uint64)


def _once(ids: np.ndarray, sizes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets aren't empty and come for the first time in this task."""
    return np.array([size > 0 and x not in seen and not seen.add(x) for x, size in zip(ids.tolist(), sizes.tolist(), strict=True)], bool)


def segment_keys(held: np.ndarray, sizes: np.ndarray, s: Scheme, budgets: Budgets = NO_BUDGETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, set, slot, spare) of what sets are indexed under, a key being a slot with a value; spare is how many keys of the band a set may leave out."""
    for below in (0, 1):
        c = cut(held, sizes, s, own_band(sizes, s) - below)
        if not len(c.slot):
            continue
        band = (c.slot >> 32)[c.first[:-1].clip(max=len(c.slot) - 1)]
        slack = s.segments[band] - s.most[band] - 1
        raised = np.isin(c.slot, budgets.raised)
        used = ~np.isin(c.slot, budgets.dropped)
        idle = np.where(raised, 2 * (c.count < 2), c.count == 0) * used
        idle = np.bincount(c.owner, weights=idle, minlength=len(sizes)).astype(np.int64)
        # Keys of a raised slot weigh two and are several: with such slots nothing is left out.
        spare = np.where(np.bincount(c.owner[raised], minlength=len(sizes)) > 0, 0, np.where(idle > slack, slack, slack - idle))[c.owner]
        empties = (idle > slack)[c.owner]
        key = _key(c.slot, c.total)
        take = used & ((c.count > 0) | empties)
        yield key[take], c.owner[take], c.slot[take], spare[take]
        if len(budgets.raised):
            there = raised[c.cell] & ((c.count > 1) | empties)[c.cell]
            cell = c.cell[there]
            yield _key(c.slot[cell], c.total[cell] - c.part[there]), c.owner[cell], c.slot[cell], spare[cell]


def _names(batches, n, s: Scheme):
    """Rows (doc_id, text_hash, n_tokens, k, k2), and after them what the task counted: (slot, key, n) of values that many of its
    sets have, and for each band the tokens in one of its segments, without a key."""
    seen: set[int] = set()
    held_keys: list[np.ndarray] = []
    slots: list[np.ndarray] = []
    waiting = 0
    counts: dict[tuple[int, int], int] = {}
    tokens_in = np.zeros(len(s.most))
    names = ["doc_id", "text_hash", "n_tokens", "k", "k2", "slot", "key", "n"]

    def count() -> None:
        nonlocal waiting
        if waiting:
            keys, at, many = np.unique(np.concatenate(held_keys), return_index=True, return_counts=True)
            slot = np.concatenate(slots)[at]
            for i in np.flatnonzero(many > 2).tolist():
                x = (int(slot[i]), int(keys[i].view(np.int64)))
                counts[x] = counts.get(x, 0) + int(many[i])
        held_keys.clear()
        slots.clear()
        waiting = 0

    for batch in batches:
        for at, texts in tokens.chunks(batch, 2):
            held, sizes = tokens.shingles(texts, n)
            k, k2 = tokens.set_names(held, sizes)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(sizes), pa.array(k), pa.array(k2), none, none, none], names)
            new = _once(k, sizes, seen)
            held, sizes = held[np.repeat(new, sizes)], sizes[new]
            for key, _, slot, _ in segment_keys(held, sizes, s):
                held_keys.append(key)
                slots.append(slot)
                waiting += len(key)
            band = own_band(sizes, s)
            for b in (band, band - 1):
                np.add.at(tokens_in, b[b >= 0], (sizes / s.segments[np.maximum(b, 0)])[b >= 0])
            if waiting >= COUNTED:
                count()
    count()
    own = [(slot, key, n_) for (slot, key), n_ in counts.items()] + [(b << 32, None, round(x)) for b, x in enumerate(tokens_in.tolist()) if x > 0]
    if own:
        slot, key, n_ = zip(*own, strict=True)
        yield pa.record_batch([pa.nulls(len(own), pa.int64())] * 5 + [pa.array(x, pa.int64()) for x in (slot, key, n_)], names)


def _lists(batches, n, s: Scheme):
    """(id, tokens, outline, sketch), each id once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for at, texts in tokens.chunks(batch, 1):
            ids = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
            held, sizes = tokens.shingles(texts, n)
            new = _once(ids, sizes, seen)
            held, sizes, ids = held[np.repeat(new, sizes)], sizes[new], ids[new]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(held.view(np.int64))), pa.array(outlines(held, sizes, s), pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * SKETCH), pa.array(sketches(held, sizes)))], ["id", "tokens", "outline", "sketch"])


def sketches(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each set 64 * SKETCH parities: in how many tokens of each hash cell it has, even or odd. Where two sets' parities differ, so do the sets: the
    number of such cells bounds from below how many tokens they differ in."""
    bits = 64 * SKETCH
    cell = (tokens.mix(held + np.uint64(3)) % np.uint64(bits)).astype(np.int64)
    place = np.repeat(np.arange(len(sizes)), sizes) * bits + cell
    odd = (np.bincount(place, minlength=len(sizes) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def outlines(held: np.ndarray, sizes: np.ndarray, s: Scheme) -> list[bytes]:
    """Of each set, for its own band and then the one below: the tokens in each segment (255 for more), then a byte of the value of each."""
    own, lower = (cut(held, sizes, s, own_band(sizes, s) - below) for below in (0, 1))
    shown = [(c.first, np.minimum(c.count, 255).astype(np.uint8), (tokens.mix(c.total) & np.uint64(255)).astype(np.uint8)) for c in (own, lower)]
    return [b"".join(x[first[i] : first[i + 1]].tobytes() for first, counts, bytes_ in shown for x in (counts, bytes_)) for i in range(len(sizes))]


def _plausible(batches, s: Scheme, p: int, q: int):
    """Of rows (a, size_a, outline_a, b, size_b, outline_b) the (a, b) whose outlines allow a link. In a segment two sets differ in at least
    the difference of their numbers of tokens, or in two tokens where these are equal and the values aren't."""
    for batch in batches:
        a, sa, oa, b, sb, ob = (batch.column(i) for i in range(6))
        size = [x.to_numpy(zero_copy_only=False) for x in (sa, sb)]
        band = [own_band(x, s) for x in size]
        at = np.minimum(*band)
        m = np.where(s.most[at] > 0, s.segments[at], 0)
        parts = []
        for column, own in zip((oa, ob), band, strict=True):
            data, offsets = tokens.text_bytes(column)
            start = offsets[:-1] + np.where(own > at, 2 * np.where(s.most[own] > 0, s.segments[own], 0), 0)
            cell = np.repeat(start - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            parts.append((data[cell].astype(np.int64), data[cell + np.repeat(m, m)]))
        (ca, va), (cb, vb) = parts
        apart = np.where(ca != cb, np.abs(ca - cb), np.where(va != vb, 2 * (ca < 255), 0))
        differ = np.bincount(np.repeat(np.arange(len(m)), m), weights=apart, minlength=len(m))
        keep = (m > 0) & (np.abs(band[0] - band[1]) < 2) & ((q + p) * differ <= (q - p) * (size[0] + size[1]))
        yield pa.record_batch([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])


def _rows(batches, n, odd, s: Scheme, budgets: Budgets):
    """Texts to (key, salt, id, spare), each set once in a task; the salt is 0 unless the key is hot."""
    seen: set[int] = set()
    for batch in batches:
        for _, texts in tokens.chunks(batch, 0):
            held, sizes = tokens.shingles(texts, n)
            ids = class_names(*tokens.set_names(held, sizes), odd)
            new = _once(ids, sizes, seen)
            held, ids, sizes = held[np.repeat(new, sizes)], ids[new], sizes[new]
            for key, owner, _, spare in segment_keys(held, sizes, s, budgets):
                key, own = key.view(np.int64), ids[owner]
                salt = np.where(np.isin(key, budgets.hot), 1 + own % SALTS, 0)
                yield pa.record_batch([pa.array(key), pa.array(salt.astype(np.int16)), pa.array(own), pa.array(spare.astype(np.int32))], ["key", "salt", "id", "spare"])


def token_sets(docs: DataFrame, n: int, s: Scheme, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_tokens, k, k2) of every row, the size of its set and two names of it; and rows with slot, key and n alone (see _names)."""
    schema = "doc_id bigint, text_hash bigint, n_tokens bigint, k bigint, k2 bigint, slot bigint, key bigint, n bigint"
    body = F.col(f"`{text}`")
    return docs.select(F.col("doc_id").cast("bigint"), _hashed(body), body).mapInArrow(lambda batches: _names(batches, n, s), schema)


def _hashed(text):
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")


def bands(longest: int, p: int, q: int) -> np.ndarray:
    """Smallest sizes of the bands, the last one beyond longest."""
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * q // p + 1)
    return np.array([*out, out[-1] * q // p + 1])


def budget(low: np.ndarray, p: int, q: int) -> np.ndarray:
    """Most tokens in which a set of each band and a partner of that or a larger size can differ."""
    r = low[1:] - 1
    return (q - p) * (r + r * q // p) // (q + p)


def class_names(k: np.ndarray, k2: np.ndarray, odd: list[int]) -> np.ndarray:
    """A class is named k; where two classes have one k (odd), by a mix of both names."""
    return np.where(np.isin(k, odd), tokens.mix(k.view(np.uint64) + tokens.mix(k2.view(np.uint64))).view(np.int64), k) if odd else k


def allocate(shared: DataFrame, sizes: DataFrame, deletion_weight: float = 4.0) -> DataFrame:
    """(slot, t) for slots whose budget isn't 0. shared: (slot, value, n) of values that several sets have; sizes: (slot, tokens, n).

    In each band the k-th costliest segment gives its budget to the k-th cheapest while its pairs are more than what the
    latter's deletions cost: a row for each token and, as they are less selective, deletion_weight times its pairs.
    """
    cost = sizes.join(shared.groupBy("slot").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")), "slot", "left").na.fill(0.0, ["pairs"])
    cost = cost.withColumn("band", F.shiftright("slot", 32))
    ranked = cost.selectExpr("*", "row_number() over (partition by band order by pairs desc, slot) as top", "row_number() over (partition by band order by pairs, slot desc) as low", "count(1) over (partition by band) as segments")
    hot = ranked.where("2 * top <= segments").select("band", F.col("top").alias("k"), F.col("slot").alias("from"), F.col("pairs").alias("saved"))
    cool = ranked.where("2 * low <= segments").select("band", F.col("low").alias("k"), F.col("slot").alias("to"), (F.col("pairs") * deletion_weight + F.col("tokens")).alias("added"))
    swaps = hot.join(cool, ["band", "k"]).where("saved > added")
    return swaps.select(F.explode(F.array(F.struct(F.col("from").alias("slot"), F.lit(-1).alias("t")), F.struct(F.col("to").alias("slot"), F.lit(1).alias("t")))).alias("x")).select("x.*")


def _verified(pairs: DataFrame, sets: DataFrame, s: Scheme, p: int, q: int, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose sets reach p/q; sets: (id, size, tokens, outline). Outlines first, whole sets for what they leave."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("outline").alias(f"outline_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{q} * least(size_a, size_b) >= {p} * greatest(size_a, size_b)")
    near = both.select("a", "size_a", "outline_a", "b", "size_b", "outline_b").mapInArrow(lambda batches: _plausible(batches, s, p, q), "a bigint, b bigint")
    near = scratch.save(near.distinct())
    a = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    common_ = F.size(F.array_intersect("ta", "tb"))
    out = scratch.save(near.join(a, "a").join(b, "b").where(q * common_ >= p * (F.size("ta") + F.size("tb") - common_)).select("a", "b"))
    scratch.drop(near)
    return out


def join(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, text: str = "text", deletion_weight: float = 4.0) -> DataFrame:
    """(doc_id, n_tokens, class_id, component_id) for every doc_id and set: class_id is the smallest id with the same set, component_id
    the smallest reachable by links of Jaccard similarity p/q or more."""
    found = linked(docs, n, p, q, text, deletion_weight)
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id")).where("component is not null")
    named = found.join(smallest, "component", "left")
    out = named.select("doc_id", "n_tokens", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.distinct()


def linked(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, text: str = "text", deletion_weight: float = 4.0) -> DataFrame:
    """(doc_id, text_hash, n_rows, n_tokens, class_id, component) for every doc_id and text: component names those that links connect, null for the empty set."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    s = scheme(p, q)
    every = scratch.save(token_sets(docs, n, s, text))
    keyed = every.where("slot is null").groupBy("doc_id", "text_hash", "n_tokens", "k", "k2").agg(F.count(F.lit(1)).alias("n_rows"))
    named = keyed.where("n_tokens > 0").groupBy("k", "k2").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("head"), F.max("n_tokens").alias("size"))
    # 64 bits name a class. Where 128 bits tell two classes apart that got one name, both get another; below 10 ** 9 classes none is expected.
    odd = [r.k for r in named.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k").toLocalIterator()]
    rename = F.pandas_udf(lambda k, k2: pd.Series(class_names(k.to_numpy(), k2.to_numpy(), odd)), "bigint") if odd else lambda k, k2: F.col(k)
    classes = scratch.save(named.select(rename("k", "k2").alias("id"), "class_id", "size", F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash")))
    budgets = _budgets(every.where("slot is not null").select("slot", "key", "n"), classes.count(), s, deletion_weight)

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(lambda batches: _rows(batches, n, odd, s, budgets), "key bigint, salt smallint, id bigint, spare int")
    # Rows of a value that one class alone has go; hot values are known to be shared. One sort finds both that and repeats from other tasks.
    seen = rows.selectExpr("key", "salt", "id", "spare", "lag(id) over (partition by key, salt order by id) as before", "max(id) over (partition by key, salt order by id rows between unbounded preceding and unbounded following) as top")
    shared = scratch.save(seen.where("(before is null or before <> id) and (salt > 0 or before is not null or top <> id)").select("key", "id", "spare"))
    members = scratch.save(_rare(shared))
    scratch.drop(shared)

    def fetch(ids: DataFrame) -> DataFrame:
        """The sets of some classes, made from the texts of their first documents."""
        heads = classes.join(ids, "id").select("id", "head_id", "head_hash")
        texts = docs.select(F.col("doc_id").cast("bigint").alias("of"), _hashed(F.col(f"`{text}`")), F.col(f"`{text}`").alias("body"))
        texts = texts.join(heads, texts["of"].eqNullSafe(heads["head_id"]) & (texts["text_hash"] == heads["head_hash"])).select("id", "body")
        return texts.mapInArrow(lambda batches: _lists(batches, n, s), "id bigint, tokens array<bigint>, outline binary, sketch array<bigint>")

    resolved = _resolve(members, fetch, s, p, q, scratch)
    joined = classes.join(resolved, classes["id"] == resolved["node"], "left").select("id", "class_id", F.coalesce("component", "id").alias("component"))
    member = keyed.select("doc_id", "text_hash", "n_rows", "n_tokens", F.when(F.col("n_tokens") > 0, rename("k", "k2")).alias("id"))
    out = scratch.save(member.join(joined, "id", "left").select("doc_id", "text_hash", "n_rows", "n_tokens", "class_id", "component"))
    scratch.drop_all_but(out)
    return out


def _budgets(counted: DataFrame, n_classes: int, s: Scheme, deletion_weight: float) -> Budgets:
    """From what tasks counted. On the driver there are at most two slots of each pair that is swapped, so no more than the longest text has
    tokens, and keys that 1/SALTS of all sets have, so no more than SALTS times the segments of an average set."""
    spark = counted.sparkSession
    shared = counted.where("key is not null").groupBy("slot", "key").agg(F.sum("n").alias("n"))
    segments = spark.createDataFrame([(b << 32, int(m)) for b, m in enumerate(s.segments.tolist()) if m < 1 << 31], "of bigint, segments int")
    sizes = counted.where("key is null").groupBy(F.col("slot").alias("of")).agg(F.sum("n").alias("tokens")).join(F.broadcast(segments), "of")
    sizes = sizes.selectExpr("explode(sequence(of, of + segments - 1)) as slot", "tokens")
    plan = allocate(shared.select("slot", F.col("key").alias("value"), "n"), sizes, deletion_weight).collect()
    hot = [r.key for r in shared.where(F.col("n") * SALTS > F.lit(n_classes)).where("n > 1000").select("key").toLocalIterator()]
    of = lambda t: np.array(sorted(r.slot for r in plan if r.t == t), np.int64)
    return Budgets(of(1), of(-1), np.array(sorted(hot), np.int64))


def _rare(members: DataFrame) -> DataFrame:
    """(key, id) without the most frequent keys that a set may leave out, and without keys that one set alone is left with."""
    counted = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    ranked = counted.selectExpr("key", "id", "spare", "row_number() over (partition by id, key & 1 order by n desc, key) as place").where("place > spare").select("key", "id")
    return ranked.join(ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")


def _resolve(members: DataFrame, fetch, s: Scheme, p: int, q: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all classes that have a link. members: distinct (key, id) of keys that several ids have; it is dropped, like every table here, once used."""
    # A bucket's star is its member with the most company over all its buckets, which in a group of edited copies is the original.
    bucket = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    company = scratch.save(members.join(bucket, "key").groupBy("id").agg(F.sum("n").alias("company")))
    candidates = scratch.save(fetch(company.select("id")).select("id", F.size("tokens").cast("bigint").alias("size"), "tokens", "outline", "sketch"))
    stars = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", "id"))["id"].alias("star"), F.count(F.lit(1)).alias("n"))
    buckets = scratch.save(members.join(stars, "key").select("key", "id", "star", "n"))
    scratch.drop(members, company)
    pairs = scratch.save(buckets.where("id <> star").select(F.least("id", "star").alias("a"), F.greatest("id", "star").alias("b")).distinct())
    links = _verified(pairs, candidates, s, p, q, scratch)
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    # Buckets that still have members of several components, and their members with the star. A bucket of two has no other pair.
    named = buckets.where("n > 2").join(label, F.col("id") == F.col("node"), "left").select("key", "id", "star", F.coalesce("component", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least < greatest").select("key")
    held = label.select(F.col("node").alias("centre"), F.col("component").alias("centre_label"))
    centred = named.join(mixed, "key").where("id <> star").select("id", "label", F.col("star").alias("centre"), F.expr("key & 1").alias("band_bit")).distinct().join(held, "centre", "left")
    centred = scratch.save(centred.select("id", "label", "centre", "band_bit", (F.col("label") != F.coalesce("centre_label", "centre")).alias("outside")))
    scratch.drop(buckets)
    met = _near_one_centre(centred, candidates, s, p, q, scratch)
    more = _verified(met.join(pairs, ["a", "b"], "left_anti"), candidates, s, p, q, scratch)
    scratch.drop(centred, met, pairs, candidates)
    return components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)


def _differences(batches, s: Scheme):
    """Of rows (id, label, centre, band_bit, outside, tokens, middle) how a set differs from its centre: a row for each segment with another value
    (whole), the item being that value's key; and, where these are H or fewer, one for each token that only one of both has. What is the same for all rows of a kind
    is in one row of it without an item: `of` counts its rows with one; from `least` to `upper` tokens lie between set and centre."""
    names = ["centre", "band_bit", "whole", "id", "outside", "item", "label", "size", "most", "of", "least", "upper"]
    for batch in batches:
        ids, label, centre, bit, outside = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        sides = []
        for i in (5, 6):
            column = batch.column(i)
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64) if len(column) else np.zeros(0, np.int64)
            sides.append((column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes))
        band = own_band(sides[0][1], s)
        band = np.where(band & 1 == bit, band, band - 1)
        own, middle = (cut(held, sizes, s, band) for held, sizes in sides)
        there = (own.total != middle.total) | (own.count != middle.count)
        cells = np.bincount(own.owner[there], minlength=len(ids))
        most = s.most[band]
        near = cells <= most
        # Tokens of either side alone, of sets near their centre.
        rows = [np.repeat(np.arange(len(ids)), sizes) for _, sizes in sides]
        both = [(row[near[row]], held[near[row]]) for row, (held, _) in zip(rows, sides, strict=True)]
        row, token = (np.concatenate(x) for x in zip(*both, strict=True))
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        same = np.zeros(len(row) + 1, bool)
        same[1:-1] = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
        alone = ~(same[:-1] | same[1:])
        row, token = row[alone], token[alone]
        at = np.concatenate([own.owner[there], row])
        item = np.concatenate([_key(own.slot[there], own.total[there]), token]).view(np.int64)
        whole = np.arange(len(at)) < there.sum()
        alone = np.bincount(row, minlength=len(ids))
        across = np.abs(own.count - middle.count)
        least = np.where(near, alone, np.bincount(own.owner[there], weights=np.where(across > 0, across, 2)[there], minlength=len(ids)).astype(np.int64))
        upper = np.where(near, alone, sides[0][1] + sides[1][1])
        yield pa.record_batch([*[pa.array(x) for x in (centre[at], bit[at], whole, ids[at], outside[at], item)], *[pa.nulls(len(at), pa.int64())] * 6], names)
        for kind, of, there in ((True, cells, cells > 0), (False, alone, near)):
            common_ = [pa.array(x[there]) for x in (centre, bit, np.full(len(ids), kind), ids, outside)]
            yield pa.record_batch([*common_, pa.nulls(int(there.sum()), pa.int64()), *[pa.array(x[there]) for x in (label, sides[0][1], most, of, least, upper)]], names)


def _near_one_centre(centred: DataFrame, candidates: DataFrame, s: Scheme, p: int, q: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b) in different components with one centre that may be linked, by how they differ from it.

    Take two linked sets, which differ in at most H tokens, so in at most H segments. Of any H + 1 segments in which one of them differs from the centre,
    at least one has the same value in the other. So pairs whose H + 1 rarest such values have none in common are out, but for pairs of
    two sets near the centre, which differ from it in H segments or fewer. For these, which needn't meet by values, the same holds of tokens: of any H + 1 tokens of a
    difference at least one is in the other's, but for two differences of at most H tokens. Differences with nothing in common add up.
    Whether two sets are linked by that is whether their rooms, (q - p) * size - (q + p) * difference, add up to 0 or more; so each needs
    to be paired with the two of the most room only. Sketches of the whole sets bound from below how far apart two sets are. Only sets outside the centre's component are on the left side.
    """
    sizes = candidates.select("id", "tokens").dropDuplicates(["id"])
    own = centred.join(sizes, "id").join(sizes.select(F.col("id").alias("centre"), F.col("tokens").alias("middle")), "centre")
    schema = "centre bigint, band_bit bigint, whole boolean, id bigint, outside boolean, item bigint, label bigint, size bigint, most bigint, of bigint, least bigint, upper bigint"
    items = scratch.save(own.select("id", "label", "centre", "band_bit", "outside", "tokens", "middle").mapInArrow(lambda batches: _differences(batches, s), schema))
    group, kind = ["centre", "band_bit"], ["centre", "band_bit", "whole"]
    traits = scratch.save(items.where("item is null").drop("item").join(candidates.select("id", "sketch").dropDuplicates(["id"]), "id"))
    # An item of one set alone comes before all others and links nothing; of those that several have, each set has so many places less.
    # Items are many, so what is dealt out by them is no more than they and whose they are.
    known = items.where("item is not null").selectExpr(*kind, "id", "item", "count(1) over (partition by centre, band_bit, whole, item) as n", "count_if(outside) over (partition by centre, band_bit, whole, item) as n_outside").where("n > 1 and n_outside > 0")
    own_items = "over (partition by id, centre, band_bit, whole order by n, item"
    known = known.selectExpr(*kind, "id", "item", f"row_number() {own_items}) as place", f"count(1) {own_items} rows between unbounded preceding and unbounded following) as shared")
    rarest = known.join(traits, ["id", *kind]).withColumn("place", F.expr("of - shared + place")).where("place <= most + 1").drop("shared")
    rarest = scratch.save(rarest)
    scratch.drop(items)
    left = rarest.where("outside").select(*kind, "item", "id", "label", "size", "most", "of", "place", "least", "upper", "sketch")
    right = rarest.select(*kind, "item", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "size", "of", "place", "least", "upper", "sketch")])
    # From the first item in common on, what follows in either difference bounds what they share, which decides how far apart the sets are.
    common_ = "1 + least(of - place, of2 - place2)"
    parities = " + ".join(f"bit_count(get(sketch, {i}) ^ get(sketch2, {i}))" for i in range(SKETCH))
    apart = f"{q + p} * greatest(least - upper2, least2 - upper, {parities}) <= {q - p} * (size + size2)"
    near = f"if(whole, greatest(of, of2) > most and {common_} >= greatest(of, of2) - most, 2 * ({common_}) >= of + of2 - floor({q - p} * (size + size2) / {q + p}))"
    met = left.join(right, [*kind, "item"]).where(f"label <> label2 and {q} * least(size, size2) >= {p} * greatest(size, size2) and {apart} and {near}").select("id", "id2")
    room = traits.where("not whole and of <= most").selectExpr(*group, "id", "label", f"{q - p} * size - {q + p} * of as room")
    best = lambda df: df.groupBy(*group).agg(F.max(F.struct("room", "id", "label")).alias("x")).selectExpr(*group, "x.id as id2", "x.label as label2", "x.room as room2")
    first = best(room)
    second = best(room.join(first, group).where("id <> id2").select(*group, "id", "label", "room"))
    sure = room.join(first.unionByName(second), group).where("label <> label2 and room + room2 >= 0").select("id", "id2")
    out = scratch.save(met.unionByName(sure).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    scratch.drop(rarest, traits)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    found = join(common.read(spark, sf_dir, "documents"), n=3, p=9, q=10)
    return found.select("doc_id", F.col("n_tokens").alias("n_shingles"), "component_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of five-word shingles at 0.8: the one with the smallest doc_id (null last), and of several texts or rows with
    that id one of them. Rows without words are linked with nothing and stay."""
    found = linked(docs)
    named = found.where("component is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    heads = named.groupBy("component").agg(F.min(order).alias("head"))
    gone = named.join(heads, "component").where(order != F.col("head")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    # Rows of one id and text: which of them stays can't matter, but it has to be one.
    often = named.where("n_rows > 1").select(F.col("doc_id").alias("often_id"), F.col("text_hash").alias("often_hash"))
    own = common.nested(docs, own_id=F.col("doc_id").cast("bigint"), own_hash=_hashed(F.col("text")))
    own = own.join(gone, own["own_id"].eqNullSafe(gone["gone_id"]) & (own["own_hash"] == gone["gone_hash"]), "left_anti")
    own = own.join(often, own["own_id"].eqNullSafe(often["often_id"]) & (own["own_hash"] == often["often_hash"]), "left")
    repeated = own.where("often_hash is not null").groupBy("own_id", "own_hash").agg(F.first("row").alias("row")).select("row")
    return common.unnested(own.where("often_hash is null").select("row").unionByName(repeated))
