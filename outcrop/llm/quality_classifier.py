"""Quality classifier on supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a text (within words, their borders included; characters are code points) is hashed to one of `BUCKETS`
learned vectors. A text is the average of its vectors; a softmax over two outputs follows. Vectors and outputs are trained
together by stochastic gradient descent in numpy, on the driver, from a sample of at most `SAMPLE` labelled texts (those of smallest hash
of doc_id), of which only bucket counts are collected, as packed numbers of eight bytes a bucket: at most SAMPLE * BUCKETS of them. Since the average is linear, a trained
model is one number for each bucket, which is what the executors get; scoring is one pass over each whole text, in numpy.

Repeated words share one pair bucket whatever the word, as a repeat says more than the word. Scores read the text alone.

Defined results: null, empty and blank texts have no vectors and get the score of the bias; without labels, or with labels of one
kind, the score is the smoothed share of label 1; labels that are null or of unknown texts are left out; repeated rows each get
their (equal) score; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BUCKETS = 1 << 15
DIMENSIONS = 8
NGRAMS = (3, 4)
SAMPLE = 3000
STEPS, RATE, BATCH = 600, 4.0, 32
THRESHOLD = 0.3

_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, (len(NGRAMS), max(NGRAMS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SAME = 12345


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of the texts, in no order."""
    words, counts = tokens.word_hashes(texts, lower=False)
    of = np.repeat(np.arange(len(counts)), counts)
    buckets, owners = [(words % BUCKETS).astype(np.int64)], [of]
    if len(words) > 1:
        pair = of[1:] == of[:-1]
        a, b = words[:-1][pair], words[1:][pair]
        with np.errstate(over="ignore"):
            buckets.append(np.where(a == b, np.uint64(_SAME), tokens.mix(a * np.uint64(3) + b) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(of[1:][pair])
    data, offsets = tokens.text_bytes(texts)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begun[offsets]))
    blank = tokens._SPACE[np.minimum(chars, 255)]
    chars = np.where(blank, np.uint32(32), chars)
    for n, factors in zip(NGRAMS, _FACTORS, strict=True):
        m = len(chars) - n + 1
        if m <= 0:
            continue
        ok = text[:m] == text[n - 1 :]
        for k in range(1, n - 1):
            ok &= ~blank[k : m + k]
        hashed = np.zeros(m, np.uint32)
        for k in range(n):
            hashed += chars[k : m + k] * factors[k]
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        buckets.append((hashed[ok] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
        owners.append(text[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def counted(texts: DataFrame) -> DataFrame:
    """(y, buckets, counts) from (y, text); both are int32 numbers, packed."""

    def count(batches):
        for batch in batches:
            for at, part in tokens.chunks(batch, 1):
                bucket, text = features(part)
                cell, n = np.unique(text * BUCKETS + bucket, return_counts=True)
                ends = np.searchsorted(cell // BUCKETS, np.arange(len(part) + 1))
                packed = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (cell % BUCKETS, n)]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), *packed], ["y", "buckets", "counts"])

    return texts.select("y", "text").mapInArrow(count, "y int, buckets binary, counts binary")


def train(sample: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias) from (label, buckets, counts)."""
    ones = sum(y for y, _, _ in sample)
    prior = math.log((ones + 1) / (len(sample) - ones + 1))
    if not 0 < ones < len(sample):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    outputs = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.array([0.0, prior])
    epochs = -(-STEPS * BATCH // len(sample))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(sample))
        for at in range(0, len(order), BATCH):
            part = [sample[i] for i in order[at : at + BATCH] if len(sample[i][1])]
            if not part:
                continue
            index = np.concatenate([b for _, b, _ in part])
            share = np.concatenate([c / c.sum() for _, _, c in part])
            first = np.cumsum([0, *(len(b) for _, b, _ in part[:-1])])
            x = np.add.reduceat(vectors[index] * share[:, None], first)
            logits = x @ outputs + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [y for y, _, _ in part]] -= 1
            back = p @ outputs.T
            outputs -= rate * 0.1 * x.T @ p / len(part)
            bias -= rate * 0.1 * p.mean(0)
            steps = np.repeat(back, np.diff(np.append(first, len(index))), axis=0) * share[:, None] * rate
            np.subtract.at(vectors, index, steps)
    return (vectors @ (outputs[:, 1] - outputs[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from (doc_id, text) and (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # a top-k, merged from each task's
    rows = counted(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).collect()
    rows.sort(key=lambda r: (r.y, bytes(r.buckets), bytes(r.counts)))  # the same order on every run
    return train([(r.y, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def scored(batches):
        weights, bias = sent.value
        for batch in batches:
            for at, part in tokens.chunks(batch, 1):
                bucket, text = features(part)
                n = np.bincount(text, minlength=len(part))
                total = np.bincount(text, weights=weights[bucket], minlength=len(part))
                out = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -60, 60)))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").where(~held_out())
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
