"""Search through stored postings: one query or a table of them, in one plan.

build() writes an index once: postings (bucket, term, unit, mask, places), sorted by term in folders of term buckets; the lexicon (bucket, term, df, chapter_df) beside
them; passages (book, unit, cited, mentioned); vectors as blocks of int8 rows; the number of units. A posting has one bit for each field
that holds the term, and every place of it as field, value and position in one number.

search_many() gives each query's terms their document frequencies, reads the postings of these terms alone (folders by bucket, row groups by term), adds the
query's passage and vector hits, and scores each (query, unit) that is met. Masks are all that scoring needs but for whole phrases: places are read
only for units in which one field has every word of a phrase that matters. Scores are the same as those of the exhaustive search.scored(), since every unit that
can score has a posting, a passage or a vector hit.

A hot term is split over tasks and files by unit. Queries are the caller's set: their
terms go to the driver only to choose files, at most LITERAL_TERMS; query vectors in blocks of QUERY_BLOCK.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcrop.functions import scripture as S
from outcrop.functions import text as T

from . import search
from .search import LABELS, LEAST_COVERAGE, PHRASE_BONUS, RARE, REFERENCE_BONUS, SEMANTIC_LEAST, SEMANTIC_WEIGHT, UNIT, WEIGHTS

FIELDS = list(WEIGHTS)
BIT = {c: 1 << i for i, c in enumerate(FIELDS)}
RAW = sum(b for c, b in BIT.items() if c != "verse_text")
CHAPTER = BIT["title"] | BIT["summary"]
FIELD_AT, VALUE_AT = 52, 32  # a place is field << 52 | value << 32 | position
BUCKETS = 64
LITERAL_TERMS = 2000
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
SENT = 1 << 23  # numbers of query vectors that are sent at once
NO_PLACES = "cast(array() as array<bigint>)"


def fields_of(places: str) -> str:
    """The bits of the fields that an array of places lies in."""
    return f"aggregate({places}, 0L, (m, p) -> m | shiftleft(1L, cast(shiftright(p, {FIELD_AT}) as int)))"


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def tokens(values: DataFrame) -> DataFrame:
    """(UNIT columns, term, places) from with_values(): one row for each term of a unit. A unit's text is dealt out once, as it is, and its words meet in the task that
    has it; they are stemmed as rows, each distinct word of a unit once."""
    at = lambda i: lambda v, k: F.struct((F.lit(i << FIELD_AT) + k * (1 << VALUE_AT)).cast("bigint").alias("at"), v.alias("text"))
    texts = values.repartition("unit_id").select(*UNIT, F.explode(F.concat(*[F.transform(f"v_{c}", at(i)) for i, c in enumerate(FIELDS)])).alias("value"))
    # An inner explode would make a filter that splits every text a second time.
    words = texts.select(*UNIT, "value.at", F.posexplode_outer(T.words(F.col("value.text"))).alias("pos", "word")).where("word is not null")
    places = words.groupBy(*UNIT, "word").agg(F.collect_list(F.col("at") + F.col("pos")).alias("places"))
    terms = places.groupBy(*UNIT, T.stem(F.col("word")).alias("term")).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return terms


def unit_columns() -> list[Column]:
    return [F.col(c).cast(t).alias(c) for c, t in zip(UNIT, ("string", "string", "date", "double"), strict=True)]


def with_values(units: DataFrame) -> DataFrame:
    """(UNIT columns, v_<field>...): the texts of every field, NFKC."""
    texts = search.field_texts(units)
    own = units.select(*unit_columns(), *[v.alias(f"r_{c}") for c, v in texts.items()])
    return own.select(*UNIT, *[T.normalised(F.col(f"r_{c}")).alias(f"v_{c}") for c in texts])


def build(units: DataFrame, path: str, counts: dict[str, list[int]] | None = None, buckets: int = BUCKETS, rows: DataFrame | None = None) -> None:
    """Writes the index of units (see search.prepare) to path. rows: (unit_id, vector array<tinyint>), for semantic search."""
    spark = units.sparkSession
    found = tokens(with_values(units)).select(bucket(F.col("term"), buckets).alias("bucket"), "term", F.struct(*UNIT).alias("unit"), F.expr(fields_of("places")).alias("mask"), "places")
    # A bucket is dealt to several tasks by unit where there are more tasks than buckets, so that a term of very many units is in none alone.
    split = -(-spark.sparkContext.defaultParallelism // buckets)
    dealt = found.repartition(buckets * split, "bucket", F.pmod(F.xxhash64("unit.unit_id"), F.lit(split)))
    dealt.sortWithinPartitions("bucket", "term", "unit.unit_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count_if(F.col("mask").bitwiseAND(F.lit(RAW)) != 0).alias("df"), F.count_if(F.col("mask").bitwiseAND(F.lit(CHAPTER)) != 0).alias("chapter_df"))
    counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/lexicon")
    units.agg(F.count(F.lit(1)).alias("n"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/about")
    if counts:
        passages(units, counts).write.parquet(f"{path}/passages")
    if rows is not None:
        blocks_of(units, rows).write.parquet(f"{path}/vectors")


def passages(units: DataFrame, counts: dict[str, list[int]]) -> DataFrame:
    """(book, unit, cited, mentioned): one row for each book that a unit cites or mentions, with the spans."""
    p = search.prepare(units, counts)
    both = p.select(F.struct(*unit_columns()).alias("unit"), F.explode(F.concat(*[F.transform(c, (lambda k: lambda r: F.struct(F.lit(k).alias("kind"), r["book"].alias("book"), r["lo"].cast("bigint").alias("lo"), r["hi"].cast("bigint").alias("hi")))(c)) for c in ("cited", "mentioned")])).alias("r"))
    spans = lambda kind: F.collect_set(F.when(F.col("r.kind") == kind, F.struct("r.lo", "r.hi"))).alias(kind)
    return both.groupBy(F.col("r.book").alias("book"), "unit").agg(spans("cited"), spans("mentioned"))


# --- vectors


def vector_blocks(rows: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """(units, dimension, matrix) from (UNIT columns, vector array<tinyint>): blocks of at most `block` rows of one dimension, as bytes."""
    kinds = {"unit_id": pa.string(), "recording_id": pa.string(), "date": pa.date32(), "start": pa.float64()}

    def made(batches):
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for part in (at[i : i + block] for i in range(0, len(at), block)):
                    some = batch.take(pa.array(part))
                    unit = pa.StructArray.from_arrays([some.column(c).cast(t) for c, t in kinds.items()], list(kinds))
                    listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), unit)
                    yield pa.record_batch([listed, pa.array([int(d)], pa.int32()), pa.array([some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int8).tobytes()])], ["units", "dimension", "matrix"])

    return rows.where("vector is not null").select(*UNIT, "vector").mapInArrow(made, "units array<struct<unit_id:string,recording_id:string,date:date,start:double>>, dimension int, matrix binary")


def blocks_of(units: DataFrame, rows: DataFrame) -> DataFrame:
    """The vector blocks of units that have a row (unit_id, vector array<tinyint>)."""
    keyed = units.select(*unit_columns())
    return vector_blocks(keyed.join(rows.select(F.col("unit_id").cast("string").alias("unit_id"), "vector"), "unit_id"))


def similar(blocks: DataFrame, queries: list[tuple[str, list[float]]], least: float = SEMANTIC_LEAST, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, unit, cosine) of every (query, row) with a positive cosine of at least `least`, each block of rows as one matrix product with a
    block of queries; with k the k best rows of each query alone, those of each task and then of all, by cosine and then unit_id. With digits cosines are rounded before they are
    ranked, so that equal ones are told apart by unit_id alone. Rows and queries that are zero or of another dimension meet nothing."""
    least = min(1.0, max(0.0, least))
    spark = blocks.sparkSession
    out = None
    at_once = max(QUERY_BLOCK, SENT // max([1, *(len(v) for _, v in queries)]))
    for at in range(0, len(queries), at_once):
        sent = spark.sparkContext.broadcast([(q, np.asarray(v, float)) for q, v in queries[at : at + at_once]])

        def met(batches, sent=sent):
            asked = {}
            for d in {len(v) for _, v in sent.value}:
                some = [(q, v / np.sqrt(v @ v)) for q, v in sent.value if len(v) == d and v.any()]
                asked[d] = [(pa.array([q for q, _ in part], pa.string()), np.stack([v for _, v in part]).T) for part in (some[i : i + QUERY_BLOCK] for i in range(0, len(some), QUERY_BLOCK))]
            best = {(d, i): np.full((v.shape[1], k), -np.inf) for d, parts in asked.items() for i, (_, v) in enumerate(parts)} if k else {}
            kept, size = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    units, d = batch.column(0)[i].values, batch.column(1)[i].as_py()
                    m = np.frombuffer(batch.column(2)[i].as_py(), np.int8).reshape(len(units), d).astype(float)
                    norms = np.sqrt((m * m).sum(1))
                    m /= np.where(norms > 0, norms, 1)[:, None]
                    place = np.argsort(pc.sort_indices(units.field("unit_id")).to_numpy()) if k else None
                    for part, (names, v) in enumerate(asked.get(d, [])):
                        c = v.T @ m.T
                        # What is below the k-th best so far by more than a rounding is out.
                        floor = best[d, part].min(1, keepdims=True) - (10.0**-digits if digits is not None else 0) if k else 0
                        query, row = np.nonzero((c > 0) & (c >= np.maximum(floor, least - 1e-9)))
                        cosine = np.minimum(c[query, row], 1)
                        if digits is not None:
                            cosine = np.floor(cosine * 10**digits + 0.5) / 10**digits
                        ok = (cosine >= least) | (c[query, row] >= least)
                        query, row, cosine = query[ok], row[ok], cosine[ok]
                        if k:
                            by = np.lexsort((place[row], -cosine, query))
                            query, row, cosine = query[by], row[by], cosine[by]
                            rank = np.arange(len(query)) - np.searchsorted(query, query)
                            query, row, cosine, rank = (x[rank < k] for x in (query, row, cosine, rank))
                            new = np.full(best[d, part].shape, -np.inf)
                            new[query, rank] = cosine
                            best[d, part] = -np.partition(-np.concatenate([best[d, part], new], axis=1), k - 1, axis=1)[:, :k]
                        found = pa.record_batch([names.take(pa.array(query)), units.take(pa.array(row)), pa.array(cosine)], ["query_id", "unit", "cosine"])
                        if not k:
                            yield found
                        elif found.num_rows:
                            kept.append(found)
                            size += found.num_rows
                    if size > max(SENT // 8, 2 * (k or 0) * len(sent.value)):
                        kept = _best(kept, k)
                        size = sum(x.num_rows for x in kept)
            yield from _best(kept, k) if kept else []

        part = blocks.select("units", "dimension", "matrix").mapInArrow(met, "query_id string, unit struct<unit_id:string,recording_id:string,date:date,start:double>, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None or k is None:
        return out
    return out.selectExpr("*", "row_number() over (partition by query_id order by cosine desc, unit.unit_id) as place").where(F.col("place") <= k)


def _best(kept: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k first rows of each query, by cosine and unit_id."""
    rows = pa.Table.from_batches(kept).combine_chunks()
    coded = rows["query_id"].combine_chunks().dictionary_encode().indices
    keys = pa.table({"at": coded, "cosine": rows["cosine"], "id": pc.struct_field(rows["unit"], "unit_id")})
    by = pc.sort_indices(keys, sort_keys=[("at", "ascending"), ("cosine", "descending"), ("id", "ascending")]).to_numpy()
    at = coded.to_numpy()[by]
    return rows.take(pa.array(by[np.arange(len(at)) - np.searchsorted(at, at) < k])).to_batches()


# --- queries


def parsed(queries: DataFrame, counts: dict[str, list[int]] | None = None) -> DataFrame:
    """(query_id, q): the query strings of (query_id, query), parsed."""
    kind = "struct<n_words:int,terms:array<string>,phrase:array<string>,strict:array<boolean>,date:date,book:string,lo:bigint,hi:bigint,canonical:string>"

    @F.pandas_udf(kind)
    def parse(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            p = search.parse(x or "", counts)
            r, strict = p.reference, {T.stem_word(w) for w in p.qualifiers}
            rows.append((len(p.words), p.terms, [T.stem_word(w) for w in p.words], [t in strict for t in p.terms], p.date, None if r is None else str(r.book), *((None,) * 3 if r is None else (r.lo, r.hi, r.canonical))))
        return pd.DataFrame(rows, columns=[c.split(":")[0] for c in kind[7:-1].split(",")])

    return queries.select(F.col("query_id").cast("string").alias("query_id"), parse("query").alias("q")).where("q.n_words > 0 and size(q.terms) > 0")


class Index:
    """A stored index; see build()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.n, self.buckets = about["n"], about["buckets"]

    def table(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def of_terms(self, name: str, terms: list[str] | None) -> DataFrame:
        """Rows of postings or lexicon for some terms: their folders, and in these the row groups that can have them."""
        rows = self.table(name)
        if terms is None:
            return rows
        at = self.spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(bucket(F.col("term"), self.buckets)).distinct().collect()
        return rows.where(F.col("bucket").isin([r[0] for r in at]) & F.col("term").isin(terms))


def _literal(asked: DataFrame) -> list[str] | None:
    """The distinct terms, if they are few enough to name."""
    found = asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()
    return sorted(r["term"] for r in found) if len(found) <= LITERAL_TERMS else None


def search_many(index: Index, queries: DataFrame, counts: dict[str, list[int]] | None = None, vectors_of: list[tuple[str, list[float]]] | None = None, limit: int | None = None, least: float = SEMANTIC_LEAST) -> DataFrame:
    """(query_id, unit_id, recording_id, date, start, score, reasons) of queries (query_id, query), all of them in one plan; vectors_of gives query vectors by id.
    With a limit each query keeps that many results, in search.ORDER."""
    q = parsed(queries, counts).persist()
    asked = q.select("query_id", F.posexplode("q.terms").alias("idx", "term"))
    terms, named = _literal(asked), _literal(q.select(F.explode(F.concat("q.terms", "q.phrase")).alias("term")))
    lexicon = index.of_terms("lexicon", terms).select("bucket", "term", "df", "chapter_df")
    keyed = asked.withColumn("bucket", bucket(F.col("term"), index.buckets))
    n = float(index.n)
    rare = (F.coalesce(F.col("chapter_df"), F.lit(0)) > 0) & (F.col("chapter_df") / n <= RARE)
    weight = 1 + F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1))
    known = keyed.join(lexicon, ["bucket", "term"], "left").select("query_id", F.struct("idx", weight.alias("w"), F.coalesce(rare, F.lit(False)).alias("rare")).alias("t"))
    known = known.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("known"))
    about = q.join(known, "query_id").select("query_id", "q", F.transform("known", lambda t: t["w"]).alias("w"), F.transform("known", lambda t: t["rare"]).alias("rare"))

    blank = {"hit": "cast(null as struct<idx:int,mask:bigint>)", "cited": "cast(null as array<struct<lo:bigint,hi:bigint>>)", "mentioned": "false", "cosine": "cast(null as double)"}
    as_hits = lambda df, **own: df.select("query_id", "unit", *[own[c].alias(c) if c in own else F.expr(e).alias(c) for c, e in blank.items()])
    posted = index.of_terms("postings", terms).select("bucket", "term", "unit", "mask")
    hits = as_hits(keyed.join(posted, ["bucket", "term"]), hit=F.struct("idx", "mask"))
    if counts and (p := index.table("passages")) is not None:
        lo, hi = F.col("q.lo"), F.col("q.hi")
        meets = lambda c: F.exists(c, lambda s: (s["lo"] <= hi) & (s["hi"] >= lo))
        met = q.where("q.book is not null").join(p.withColumn("book", F.col("book").cast("string")), F.col("q.book") == F.col("book")).where(meets("cited") | meets("mentioned"))
        hits = hits.unionByName(as_hits(met, cited=F.when(meets("cited"), F.col("cited")), mentioned=meets("mentioned")))
    if vectors_of and (b := index.table("vectors")) is not None:
        hits = hits.unionByName(as_hits(similar(b, vectors_of, least), cosine=F.col("cosine")))
    units = hits.groupBy("query_id", "unit").agg(F.sort_array(F.collect_list("hit")).alias("hits"), F.first("cited", ignorenulls=True).alias("cited"), F.max("mentioned").alias("mentioned"), F.max("cosine").alias("cosine"))
    rows = units.join(about, "query_id").where(F.col("q.date").isNull() | (F.col("unit.date") == F.col("q.date")))
    scored = _scored(index, rows, named)
    out = scored.select("query_id", *[F.col(f"unit.{c}").alias(c) for c in UNIT], "score", "reasons")
    if limit is None:
        return out
    order = ", ".join(f"{c} {'asc' if up else 'desc'}" for c, up in search.ORDER)
    return out.selectExpr("*", f"row_number() over (partition by query_id order by {order}) as place").where(F.col("place") <= max(0, int(limit))).drop("place")


def _scored(index: Index, rows: DataFrame, named: list[str] | None) -> DataFrame:
    """rows (query_id, unit, hits, cited, mentioned, cosine, q, w, rare) that score, with score and reasons."""
    by_reference = F.col("q.book").isNotNull()
    is_cited = F.col("cited").isNotNull()
    is_mentioned = ~is_cited & F.col("mentioned")
    # With a reference the scripture field counts by its passages, not by its words.
    seen = F.when(by_reference, F.lit(~BIT["scripture"])).otherwise(F.lit(-1))
    hits = F.filter(F.transform("hits", lambda h: F.struct(h["idx"].alias("idx"), h["mask"].bitwiseAND(seen).alias("mask"))), lambda h: h["mask"] != 0)
    rows = rows.withColumns({"hits": hits, "_cited": is_cited, "_mentioned": is_mentioned})
    n_terms = F.size("q.terms")
    covered = F.when(F.col("_cited") | F.col("_mentioned"), n_terms).otherwise(F.size("hits"))
    has = lambda i: F.exists("hits", lambda h: h["idx"] == i)
    rare = F.exists("hits", lambda h: F.get("rare", h["idx"]) & (h["mask"].bitwiseAND(F.lit(CHAPTER)) != 0))
    unmet = ~(F.col("_cited") | F.col("_mentioned")) & F.exists(F.transform("q.strict", lambda s, i: s & ~has(i)), lambda x: x)
    rows = rows.withColumn("_covered", covered)
    enough = (F.col("_covered") >= LEAST_COVERAGE * n_terms) | (rare & (F.col("_covered") >= 2) & (F.col("_covered") * 3 >= n_terms) & ~unmet)
    rows = rows.withColumn("_lexical", enough & (~by_reference | F.col("_cited") | F.col("_mentioned")))
    rows = rows.where("_lexical or cosine is not null")
    rows = with_phrases(index, rows, named)
    found = {c: F.aggregate(F.filter("hits", (lambda b: lambda h: h["mask"].bitwiseAND(F.lit(b)) != 0)(BIT[c])), F.lit(0.0), lambda acc, h: acc + F.get("w", h["idx"])) for c in FIELDS}
    rows = rows.withColumns({f"_f_{c}": e for c, e in found.items()} | {"_total": F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)})
    score, reasons = F.lit(0.0), []
    share = S.coverage(F.col("cited"), F.col("q.lo"), F.col("q.hi"))
    for c, weight in WEIGHTS.items():
        full = F.col("_phrase").bitwiseAND(F.lit(BIT[c])) != 0
        value = F.col(f"_f_{c}")
        plain = F.when(value > 0, weight * (value / F.col("_total") + F.when(full, PHRASE_BONUS).otherwise(0))).otherwise(0.0)
        exact = F.when(full & (F.col("q.n_words") > 1), " (exact phrase)").otherwise("") if c != "verse_text" else F.lit("")
        why = F.when(value > 0, F.concat(F.lit(LABELS[c]), exact))
        if c == "scripture":
            plain = F.when(by_reference, F.when(F.col("_cited"), REFERENCE_BONUS * share + 2 * weight).when(F.col("_mentioned"), F.lit(float(weight))).otherwise(0.0)).otherwise(plain)
            why = F.when(by_reference, F.when(F.col("_cited"), F.concat(F.lit("Scripture: "), "q.canonical")).when(F.col("_mentioned"), F.concat(F.lit("Mentions "), "q.canonical"))).otherwise(why)
        score = score + plain
        reasons.append(why)
    near = F.col("cosine").isNotNull()
    lexical = F.when(F.col("_lexical"), score).otherwise(0.0)
    why = F.when(F.col("_lexical"), F.array_compact(F.array(*reasons))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("query_id", "unit", "cosine", lexical.alias("score"), why.alias("reasons"))
    rows = rows.withColumns({"score": F.col("score") + F.when(near, SEMANTIC_WEIGHT * F.col("cosine")).otherwise(0.0), "reasons": F.when(near, F.array_append("reasons", F.lit("Similar in meaning"))).otherwise(F.col("reasons"))})
    return rows.where("score > 0").drop("cosine")


def with_phrases(index: Index, rows: DataFrame, named: list[str] | None) -> DataFrame:
    """rows with _phrase: a bit for each field of which one value holds the whole phrase. Fields without one of its terms are out by their masks; for what is left
    the places of the phrase's words are read, each word once however often the phrase has it."""
    every = F.aggregate("hits", F.lit(-1).cast("bigint"), lambda acc, h: acc.bitwiseAND(h["mask"]))
    rows = rows.withColumn("_possible", F.when((F.size("hits") == F.size("q.terms")) & F.col("_lexical"), every).otherwise(0))
    one = F.size("q.phrase") == 1
    some = rows.where((F.col("_possible") != 0) & ~one).select("query_id", "unit", F.explode(F.array_distinct("q.phrase")).alias("term"))
    some = some.withColumn("bucket", bucket(F.col("term"), index.buckets))
    placed = index.of_terms("postings", named).select("bucket", "term", "unit", "places")
    found = some.join(placed, ["bucket", "term", "unit"]).groupBy("query_id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_places"))
    both = rows.join(found, ["query_id", "unit"], "left")
    at = lambda word, i: F.transform(F.coalesce(F.try_element_at("_places", word), F.expr(NO_PLACES)), lambda p: p - i)
    starts = F.aggregate(F.transform("q.phrase", at), F.lit(None).cast("array<bigint>"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.array_intersect(acc, x)))
    both = both.withColumn("_starts", F.coalesce(starts, F.expr(NO_PLACES)))
    return both.withColumn("_phrase", F.when(one, F.col("_possible")).otherwise(F.expr(fields_of("_starts")))).drop("_places", "_possible", "_starts")
