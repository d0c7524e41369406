"""Vector code compression: product codes with integer codebooks, refined by Lloyd rounds on heaps.

Components become integers floor(SCALE * x), vectors are cut into `PARTS` consecutive parts, and each part position has a codebook of
`ENTRIES` entries, at first those of the smallest vec_ids. A round assigns every part to its nearest entry (squared distance, the lower index among
equals) and moves each entry to the floored mean of its parts.

Heap Lloyd. A part knows an upper bound of the distance to its entry and a lower bound of that to any other. Entries move, and the slack, lower minus
upper, shrinks at most by what its own entry and the farthest-moving other entry moved. So each block of vectors keeps, for each part position and
entry, a binary heap of (slack when it was put in + what the entry had drifted by then, row). A round pops while the top is not above the
entry's drift so far; the popped parts alone are compared with all entries, exactly, and pushed again. Slacks are rounded down and drifts
up, in whole units of 1 / UNIT, so no part is left whose nearest entry could have changed.

One table row holds a block of at most `BLOCK` vectors with its codes and heaps; each round reads it and writes its successor, and the table before is
dropped. What a round moves is given as changes of sums and counts by codebook cell, added up by Spark; the driver holds codebooks alone, PARTS *
ENTRIES entries. Sums are integers: the partitioning changes nothing.

Defined results: rows whose vector is null or has a null, NaN or infinite component are left out, as are rows whose length isn't that of the first kept
vector (smallest vec_id, null last, then by components); parts of a length that PARTS doesn't divide differ by one; integers stop at +-LARGEST, so that sums of
squares fit; repeated ids are rows of their own; with fewer rows than ENTRIES there are as many entries as rows; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK = 4096
LARGEST = 1 << 28
UNIT, ROW_BITS = 1 << 10, 13  # a heap item is slack << ROW_BITS | row
FAR = 1 << 48
BROADCAST_LABELS = 100_000
BLOCK_TYPE = "ids array<bigint>, labels array<string>, data binary, codes binary, heaps binary, bounds binary, changes binary"


@dataclass
class Codebooks:
    """One integer array (entries, width) for each part, and how far each entry may have come nearer to a part than its slack says."""

    entries: list[np.ndarray]
    drift: np.ndarray  # (parts, entries), in units

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel()).encode()).hexdigest()

    def moved(self, sums: list[np.ndarray], counts: np.ndarray) -> Codebooks:
        """Entries at the floored means of their parts; unused ones stay."""
        out, drift = [], self.drift.copy()
        for p, (old, s) in enumerate(zip(self.entries, sums, strict=True)):
            n = counts[p][:, None]
            new = np.where(n > 0, s // np.maximum(n, 1), old)
            far = np.sqrt(((new - old).astype(float) ** 2).sum(1))
            most = np.array([max((far[k] for k in range(len(far)) if k != j), default=0.0) for j in range(len(far))])
            drift[p, : len(far)] += np.ceil((far + most) * UNIT).astype(np.int64) + (far + most > 0)
            out.append(new)
        return Codebooks(out, drift)


def cuts(length: int, parts: int = PARTS) -> list[int]:
    return [length * p // parts for p in range(parts + 1)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries): by a matrix product where doubles are exact, by integers beyond."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if largest * largest * max(1, x.shape[1]) < 1 << 50:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k : k + 1].astype(np.int64) - entries[:, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack in units, rounded down) of each row."""
    d = distances(x, entries)
    code = d.argmin(1)  # the first among equals
    at = np.arange(len(x))
    upper = np.sqrt(d[at, code])
    d[at, code] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float)) if d.shape[1] > 1 else np.full(len(x), FAR / UNIT)
    return code, np.minimum(np.floor((lower - upper) * UNIT * (1 - 1e-9)) - 1, FAR).astype(np.int64)


class Block:
    """Vectors with their codes and, for each part and entry, a heap."""

    def __init__(self, data: np.ndarray, codes: np.ndarray, heaps: list[list[list[int]]]):
        self.data, self.codes, self.heaps = data, codes, heaps
        self.rescanned = 0

    @classmethod
    def unpacked(cls, n: int, data: bytes, codes: bytes, heaps: bytes, bounds: bytes, parts: int, entries: int) -> Block:
        sizes = np.frombuffer(bounds, np.int32).reshape(parts, entries)
        items, at, out = np.frombuffer(heaps, np.int64).tolist(), 0, []
        for p in range(parts):
            out.append([])
            for size in sizes[p].tolist():
                out[p].append(items[at : at + size])
                at += size
        return cls(np.frombuffer(data[1:], f"<i{data[0]}").reshape(n, -1), np.frombuffer(codes, np.uint8).reshape(n, parts).copy(), out)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        sizes = np.array([[len(h) for h in part] for part in self.heaps], np.int32)
        items = np.array([x for part in self.heaps for h in part for x in h], np.int64)
        return pack(self.data), self.codes.tobytes(), items.tobytes(), sizes.tobytes()

    def assign(self, books: Codebooks, first: bool = False) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Reassigns what may have a nearer entry. Gives (part, rows, entries before, entries after) of the changes; at first all rows, without before."""
        changes, edges = [], cuts(self.data.shape[1], len(books.entries))
        for p, entries in enumerate(books.entries):
            drift, heaps = books.drift[p].tolist(), self.heaps[p]
            if first:
                rows = np.arange(len(self.data))
            else:
                popped = []
                for heap, d in zip(heaps, drift, strict=True):
                    while heap and heap[0] >> ROW_BITS <= d:
                        popped.append(heapq.heappop(heap) & (1 << ROW_BITS) - 1)
                rows = np.array(sorted(popped), np.int64)
            if not len(rows):
                continue
            self.rescanned += len(rows)
            code, slack = nearest(self.data[rows, edges[p] : edges[p + 1]], entries)
            for row, c, s in zip(rows.tolist(), code.tolist(), slack.tolist(), strict=True):
                heapq.heappush(heaps[c], (s + drift[c]) << ROW_BITS | row)
            before = self.codes[rows, p].astype(np.int64)
            self.codes[rows, p] = code
            new = np.ones(len(rows), bool) if first else before != code
            changes.append((p, rows[new], np.full(new.sum(), -1) if first else before[new], code[new]))
        return changes

    def sums(self, changes, books: Codebooks) -> np.ndarray:
        """Changes of (sums..., count) by codebook cell, as one flat integer array."""
        edges, out = cuts(self.data.shape[1], len(books.entries)), []
        found = {p: c for p, *c in changes}
        for p, entries in enumerate(books.entries):
            cell = np.zeros((len(entries), edges[p + 1] - edges[p] + 1), np.int64)
            if p in found:
                rows, before, after = found[p]
                x = np.column_stack([self.data[rows, edges[p] : edges[p + 1]].astype(np.int64), np.ones(len(rows), np.int64)])
                np.add.at(cell, after, x)
                old = before >= 0
                np.subtract.at(cell, before[old], x[old])
            out.append(cell.ravel())
        return np.concatenate(out)

    def errors(self, books: Codebooks) -> np.ndarray:
        edges, out = cuts(self.data.shape[1], len(books.entries)), np.zeros(len(self.data), np.int64)
        for p, entries in enumerate(books.entries):
            out += ((self.data[:, edges[p] : edges[p + 1]].astype(np.int64) - entries[self.codes[:, p]]) ** 2).sum(1)
        return out


def pack(data: np.ndarray) -> bytes:
    """The integers in as few bytes as hold them, after that number."""
    largest = int(np.abs(data).max(initial=0))
    width = 2 if largest < 1 << 15 else 4
    return bytes([width]) + data.astype(f"<i{width}").tobytes()


def integers(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, label, v): kept rows with integer components."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where(good if length is None else good & (F.size("embedding") == length))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e * SCALE))).cast("int"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))


def _start(rows: DataFrame, parts: int, entries: int) -> tuple[int, Codebooks] | None:
    """(length, first codebooks) from the smallest ids."""
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0].v)
    top = np.array([r.v for r in rows.where(F.size("v") == length).orderBy(*order).limit(entries).collect()], np.int64)
    edges = cuts(length, parts)
    return length, Codebooks([top[:, a:b] for a, b in zip(edges, edges[1:], strict=False)], np.zeros((parts, len(top)), np.int64))


def _blocks(rows: DataFrame, books: Codebooks, block: int) -> DataFrame:
    """The first assignment: every part is compared with every entry."""

    def made(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                data = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
                b = Block(data, np.zeros((len(data), len(books.entries)), np.uint8), [[[] for _ in e] for e in books.entries])
                yield _row(part.column(0), part.column(1), b, b.assign(books, first=True), books)

    return rows.select("vec_id", "label", "v").mapInArrow(made, BLOCK_TYPE)


def _row(ids: pa.Array, labels: pa.Array, b: Block, changes, books: Codebooks) -> pa.RecordBatch:
    whole = pa.array([0, len(ids)], pa.int32())
    columns = [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels)]
    columns += [pa.array([x], pa.binary()) for x in (*b.packed(), b.sums(changes, books).tobytes())]
    return pa.record_batch(columns, [c.split()[0] for c in BLOCK_TYPE.split(", ")])


def _read(batch: pa.RecordBatch, i: int, books: Codebooks) -> tuple[pa.Array, pa.Array, Block]:
    ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
    held = [batch.column(k)[i].as_py() for k in (2, 3, 4, 5)]
    return ids, labels, Block.unpacked(len(ids), *held, len(books.entries), len(books.entries[0]))


def _again(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """Further assignments: only what the heaps give is compared."""

    def made(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, b = _read(batch, i, books)
                yield _row(ids, labels, b, b.assign(books), books)

    return blocks.mapInArrow(made, BLOCK_TYPE)


def _totals(blocks: DataFrame, n: int) -> np.ndarray:
    """The sum of all changes: one row a cell and task, added up by Spark."""

    def added(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "value"])

    out = np.zeros(n, np.int64)
    for r in blocks.select("changes").mapInArrow(added, "cell int, value bigint").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


def _scored(blocks: DataFrame, books: Codebooks) -> DataFrame:
    def made(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, b = _read(batch, i, books)
                codes = pa.array([row.tobytes().hex() for row in b.codes], pa.string())
                yield pa.record_batch([ids, labels, codes, pa.array(b.errors(books))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(made, "vec_id bigint, label string, code string, error bigint")


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every kept row of vectors (vec_id, embedding, label), and the final codebooks."""
    if not 0 < entries <= 256 or not 0 < block <= 1 << ROW_BITS:
        raise ValueError("a code is one byte a part, and a block at most 8,192 rows")
    spark = vectors.sparkSession
    start = _start(integers(vectors), parts, entries)
    if start is None:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), None
    length, books = start
    scratch = common.Scratch(spark, "vector-codes")
    edges = cuts(length, parts)
    widths = [b - a + 1 for a, b in zip(edges, edges[1:], strict=False)]
    cells = [0, *np.cumsum([w * len(e) for w, e in zip(widths, books.entries, strict=True)])]
    held = np.zeros(cells[-1], np.int64)
    blocks = scratch.save(_blocks(integers(vectors, length), books, block))
    for _ in range(rounds):
        held += _totals(blocks, cells[-1])
        tables = [held[a:b].reshape(len(e), w) for a, b, e, w in zip(cells, cells[1:], books.entries, widths, strict=False)]
        books = books.moved([t[:, :-1] for t in tables], np.array([t[:, -1] for t in tables]))
        after = scratch.save(_again(blocks, books))
        scratch.drop(blocks)
        blocks = after
    out = scratch.save(_scored(blocks, books))
    scratch.drop(blocks)
    return out, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of all rows of its label together; null is a label. One row a label, broadcast while these are few."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("l"), "label_error")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"))
