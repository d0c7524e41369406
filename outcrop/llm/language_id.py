"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary and a short context, both cut from its own training text. A text is put
into lower-case letters and single spaces, cut into pieces of `PIECE` bytes, and every piece is encoded after the context with the
dictionary of each language; what the pieces add to the encoded contexts is the size of the text in that language. The smallest size
wins, by language code among equals. The context lets short texts share its entropy tables; without it they would all be stored as they are.

The score is the margin, (second smallest - smallest size) / (second smallest + SLACK): a byte says little in a text of few. A text whose margin is below `least` is rejected: it still has its likeliest
language, with `rejected` true.

Training text is a bounded sample: of each language about `SAMPLE` texts by hash of doc_id, all of them where there are fewer; of these
the distinct pieces of `CHUNK` characters with the smallest hashes, `CHUNKS` at most, cut off at DICTIONARY + CONTEXT bytes. So a
model has at most 68 KB a language, and at most `LANGUAGES` of them, beyond which fit() refuses. Scoring reads every text whole, and its work is
in proportion to text bytes times languages; memory follows the longest text.

Defined results: null texts and texts without a letter get `und`, score 0, rejected; so does every text where nothing was learned; with one
learned language the score is 1; repeated rows each get their (equal) result; a null doc_id counts as empty text for the fold; an empty table
gives an empty result; columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_classifier import held_out

DICTIONARY, CONTEXT, LEVEL = 1 << 16, 1 << 12, 3
PIECE = 4000
SAMPLE, CHUNK, CHUNKS = 500, 200, 1000
LANGUAGES = 1000
LEAST, SLACK = 0.01, 16
UNKNOWN = "und"

Model = list[tuple[str, bytes, bytes]]


def letters(text: Column) -> Column:
    """Lower-case letters and marks, with one space for each run of anything else."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """(language, dictionary, context) of every non-null lang of docs (doc_id, text, lang) that has letters."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not counts:
        return []
    share = docs.sparkSession.createDataFrame([(r["lang"], sample / r["count"]) for r in counts], "lang string, share double")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.join(F.broadcast(share), "lang").where(part < F.col("share")).select("lang", letters(F.col("text")).alias("text")).where("text != ''")
    starts = F.sequence(F.lit(0), (F.length("text") - 1).cast("int"), F.lit(CHUNK))
    chunks = chosen.select("lang", F.explode(F.transform(starts, lambda i: F.substring("text", i + 1, F.lit(CHUNK)))).alias("chunk")).distinct()
    first = chunks.selectExpr("*", "row_number() over (partition by lang order by xxhash64(chunk), chunk) as place").where(f"place <= {CHUNKS}")
    texts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "place").collect():
        texts.setdefault(r["lang"], []).append(r["chunk"])
    whole = {lang: " ".join(c).encode()[: DICTIONARY + CONTEXT] for lang, c in texts.items()}
    return [(lang, b[CONTEXT:], b[:CONTEXT]) for lang, b in sorted(whole.items())]


class Encoders:
    """The sizes of texts in each language of a model."""

    def __init__(self, model: Model):
        self.languages, self.by = [m[0] for m in model], []
        for _, dictionary, context in model:
            held = None
            if len(dictionary) >= 8:  # shorter content is none to zstandard
                held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
            encode = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            self.by.append((encode, context, len(encode(context))))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(max(0, len(encode(context + p)) - alone) for p in pieces) for encode, context, alone in self.by]

    def best(self, text: bytes) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        order = sorted(zip(self.sizes(text), self.languages, strict=True))
        return order[0][1], (order[1][0] - order[0][0]) / (order[1][0] + SLACK) if len(order) > 1 else 1.0


def identify(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 68 KB a language

    def found(batches):
        encoders = Encoders(sent.value)
        for batch in batches:
            got = [encoders.best(x.as_py().encode()) for x in batch.column(1)]
            langs, scores = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())
            rejected = pa.array([g[0] == UNKNOWN or g[1] < least for g in got], pa.bool_())
            yield pa.record_batch([batch.column(0), langs, scores, rejected], ["doc_id", "lang_pred", "score", "rejected"])

    plain = docs.select(F.col("doc_id").cast("bigint"), letters(F.col("text")).alias("text"))
    # Marks alone are no letters.
    plain = plain.withColumn("text", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).otherwise(""))
    return plain.mapInArrow(found, "doc_id bigint, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
