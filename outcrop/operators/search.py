"""Ranked search over units: field-weighted terms, phrases, dates, passage references and vectors in one explained score.

This is the exhaustive form, without an index of terms: postings.search_many() gives the same scores from stored postings. `prepare` makes a table once (padded stems
of every field, cited and mentioned references). A query is parsed on the driver; scoring is one expression of each row, in a fixed order of fields, so a score is the same
double however the table is partitioned. The plan is one scan for document frequencies, one for scores, and a top-k; the date scope is a filter that reaches the scan.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcrop.functions import scripture as S
from outcrop.functions import text as T
from outcrop.functions import timecode

from . import vectors

# What a match in a field is worth, in the order in which fields are scored, and the other constants of the score.
WEIGHTS = {"date": 16, "scripture": 14, "verse_text": 2, "topic": 7, "title": 6, "service": 4, "series": 4, "summary": 4}
LABELS = {c: f"{c.capitalize()} match" for c in WEIGHTS} | {"verse_text": "Verse-text match (BSB)"}
REFERENCE_BONUS, PHRASE_BONUS, SEMANTIC_WEIGHT, SEMANTIC_LEAST, LEAST_COVERAGE, RARE = 32, 1, 6, 0.45, 0.6, 0.05

ORDER = (("score", False), ("date", False), ("recording_id", True), ("start", True), ("unit_id", True))
UNIT = ("unit_id", "recording_id", "date", "start")


def field_texts(units: DataFrame) -> dict[str, Column]:
    """An array of texts for each field, in the order of WEIGHTS."""
    has = set(units.columns)
    one = lambda c: F.filter(F.array(F.col(c).cast("string")), lambda x: x.isNotNull()) if c in has else F.array().cast("array<string>")
    many = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in has else F.array().cast("array<string>")
    day = F.col("date").cast("date")
    return {
        "date": F.when(day.isNotNull(), timecode.date_terms(day)).otherwise(F.array().cast("array<string>")), "scripture": many("scripture"), "verse_text": one("verse_text"),
        "topic": many("topics"), "title": one("title"), "service": one("service"), "series": one("series"), "summary": one("summary"),
    }


def prepare(units: DataFrame, counts: dict[str, list[int]] | None = None) -> DataFrame:
    """The index table. units: unit_id, recording_id, date, start and any of the fields service, title, summary, series, verse_text (strings), topics,
    scripture (arrays). Fields that are absent or null are empty."""
    values = field_texts(units)
    # Both sides of a search are normalised: a query when it is parsed, the index here.
    own = units.withColumns({f"f_{k}": T.normalised(v) for k, v in values.items()})
    out = own.withColumns({f"f_{k}": F.transform(f"f_{k}", T.padded) for k in values})
    none = F.array().cast(f"array<{S.TYPE}>")
    if counts:
        parsed, found = S.parse_udf(counts), S.mentions_udf(counts)
        prose = F.concat(*[values[c] for c in ("title", "summary", "service", "series", "topic")])  # each apart: a reference isn't made of two fields
        cited = units.select("unit_id", F.explode(values["scripture"]).alias("r")).select("unit_id", parsed("r").alias("r")).where("r is not null").groupBy("unit_id").agg(F.sort_array(F.collect_set("r")).alias("cited"))
        return out.withColumn("mentioned", found(prose)).join(cited, "unit_id", "left").withColumn("cited", F.coalesce("cited", none))
    return out.withColumn("cited", none).withColumn("mentioned", none)


@dataclass(frozen=True)
class Query:
    """A query string, parsed."""

    words: list[str]
    terms: list[str]
    date: datetime.date | None = None
    reference: S.Reference | None = None
    qualifiers: list[str] = field(default_factory=list)

    @property
    def phrase(self) -> str:
        return f" {' '.join(map(T.stem_word, self.words))} "


_MONTHS = "january february march april may june july august september october november december".split()


def full_date(query: str) -> datetime.date | None:
    """The date that a query is as a whole: ISO, `5 July 2026` or `July 5, 2026`; months in full, by three letters or sept."""
    value = " ".join(T.nfkc_text(query).lower().split())
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", value):
        y, mo, d = map(int, m.groups())
    else:
        m = re.fullmatch(r"(\d{1,2}) ([a-z]+)\.? (\d{4})", value)
        n = re.fullmatch(r"([a-z]+)\.? (\d{1,2}),? (\d{4})", value)
        if not (m or n):
            return None
        d, name, y = (m[1], m[2], m[3]) if m else (n[2], n[1], n[3])
        fits = [i + 1 for i, x in enumerate(_MONTHS) if name in (x, x[:3]) or (name == "sept" and i == 8)]
        if not fits:
            return None
        y, mo, d = int(y), fits[0], int(d)
    try:
        return datetime.date(y, mo, d)
    except ValueError:
        return None


def parse(query: str, counts: dict[str, list[int]] | None = None) -> Query:
    day = full_date(query)
    reference = None if day else S.parse(query, counts or {})
    asked = f"{day.day} {_MONTHS[day.month - 1]} {day.year}" if day else reference.canonical if reference else query
    w = T.query_words(day.isoformat() if day else asked)
    content = list(dict.fromkeys(x for x in w if x not in T.STOP_WORDS))
    return Query(w, [T.stem_word(x) for x in content], day, reference, [x for x in content if x in T.QUALIFIERS])


def _has(c: str, needle: str) -> Column:
    return F.exists(f"f_{c}", lambda v: v.contains(needle))


def frequencies(index: DataFrame, terms: list[str]) -> tuple[int, list[int], list[int]]:
    """(rows, rows with each term in any field but verse_text, rows with it in title or summary): one pass."""
    needle = [f" {t} " for t in terms]
    anywhere = [F.count_if(_any([_has(c, n) for c in WEIGHTS if c != "verse_text"])) for n in needle]
    chapter = [F.count_if(_has("title", n) | _has("summary", n)) for n in needle]
    row = index.agg(F.count(F.lit(1)), *[x.alias(f"a{i}") for i, x in enumerate(anywhere)], *[x.alias(f"c{i}") for i, x in enumerate(chapter)]).first()
    return row[0], list(row[1 : 1 + len(terms)]), list(row[1 + len(terms) :])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def cosine(column: Column, vector: list[float]) -> Column:
    """The cosine of an array with a vector; 0 for nulls, zero rows and rows of other length."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return F.when(F.size(column) == len(vector), vectors.cosine(column, q)).otherwise(0.0)


def scored(index: DataFrame, query: Query, query_vector: list[float] | None = None, vector: str = "vector", least: float = SEMANTIC_LEAST, prune: bool = False) -> DataFrame:
    """The rows of index that match, with score and reasons. prune drops rows early that can't match by terms (never with a date or vector)."""
    if not query.words or not query.terms:
        return index.withColumns({"score": F.lit(0.0), "reasons": F.array().cast("array<string>")}).where(F.lit(False))
    n, df, chapter = frequencies(index, query.terms)
    idf = [1 + float(np.log((n + 1) / (d + 1))) for d in df]
    total = sum(idf)
    rows = index.where(F.col("date").cast("date") == F.lit(query.date)) if query.date else index
    r = query.reference
    cited = S.overlaps(F.col("cited"), F.lit(r.book), F.lit(r.lo), F.lit(r.hi)) if r else F.lit(False)
    mentioned = ~cited & S.overlaps(F.col("mentioned"), F.lit(r.book), F.lit(r.lo), F.lit(r.hi)) if r else F.lit(False)
    # One flag for each field and term, as the row of a generator: filters that follow read flags and aren't pushed below the texts.
    hits = {c: F.array(*[_has(c, f" {t} ") for t in query.terms]) for c in WEIGHTS}
    full = {c: _has(c, query.phrase) for c in WEIGHTS}
    flags = F.struct(F.struct(*[h.alias(c) for c, h in hits.items()]).alias("_hit"), F.struct(*[h.alias(c) for c, h in full.items()]).alias("_full"), cited.alias("_cited"), mentioned.alias("_mentioned"))
    rows = rows.select(*UNIT, *([vector] if query_vector is not None else []), "cited", F.inline(F.array(flags)))
    hit = lambda c, i: F.get(F.col(f"_hit.{c}"), F.lit(i))
    fields = [c for c in WEIGHTS if not (c == "scripture" and r)]
    covered = [F.col("_cited") | F.col("_mentioned") | _any([hit(c, i) for c in fields]) for i in range(len(query.terms))]
    count = sum((x.cast("int") for x in covered), F.lit(0))
    if prune and not query.date and query_vector is None:
        rows = rows.where(F.col("_cited") | F.col("_mentioned") | (count >= 2) | (count >= LEAST_COVERAGE * len(query.terms)))
    score, reasons = F.lit(0.0), []
    for c, weight in WEIGHTS.items():
        if c == "scripture" and r:
            spans = F.transform(F.filter("cited", lambda x: x["book"] == r.book), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
            share = S.coverage(spans, F.lit(r.lo), F.lit(r.hi))
            score = score + F.when(F.col("_cited"), REFERENCE_BONUS * share + 2 * weight).when(F.col("_mentioned"), F.lit(float(weight))).otherwise(0.0)
            reasons.append(F.when(F.col("_cited"), f"Scripture: {r.canonical}").when(F.col("_mentioned"), f"Mentions {r.canonical}"))
            continue
        found = sum((F.when(hit(c, i), F.lit(w)).otherwise(0.0) for i, w in enumerate(idf)), F.lit(0.0))
        phrase = F.col(f"_full.{c}")
        score = score + F.when(found > 0, weight * (found / total + F.when(phrase, PHRASE_BONUS).otherwise(0))).otherwise(0.0)
        exact = F.when(phrase, " (exact phrase)").otherwise("") if len(query.words) > 1 and c != "verse_text" else F.lit("")
        reasons.append(F.when(found > 0, F.concat(F.lit(LABELS[c]), exact)))
    rare = _any([(hit("title", i) | hit("summary", i)) for i in range(len(query.terms)) if (chapter[i] / n if chapter[i] else 1) <= RARE])
    # A term that negates or restricts must be met for the sparse rule.
    content = [T.stem_word(q) for q in query.qualifiers]
    unmet = _any([~x for t, x in zip(query.terms, covered, strict=True) if t in content])
    sparse = rare & (count >= 2) & (count * 3 >= len(query.terms)) & ~unmet
    enough = (count >= LEAST_COVERAGE * len(query.terms)) | sparse
    lexical = enough & (F.col("_cited") | F.col("_mentioned")) if r else enough
    why = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    rows = rows.select("*", F.when(lexical, score).otherwise(0.0).alias("score"), F.when(lexical, why).otherwise(none).alias("reasons"))
    if query_vector is not None:
        c = F.col("_cosine")
        near = (c > 0) & (c >= min(1.0, max(0.0, least)))
        rows = rows.withColumn("_cosine", cosine(F.col(vector), query_vector))
        rows = rows.withColumns({"score": F.col("score") + F.when(near, SEMANTIC_WEIGHT * c).otherwise(0.0), "reasons": F.when(near, F.array_append("reasons", F.lit("Similar in meaning"))).otherwise(F.col("reasons"))}).drop("_cosine")
    return rows.where("score > 0").drop("_hit", "_full", "_cited", "_mentioned")


def search(index: DataFrame, query: str, counts: dict[str, list[int]] | None = None, query_vector: list[float] | None = None, limit: int | None = None, **options) -> DataFrame:
    """(unit_id, recording_id, date, start, score, reasons), best first; a limit applies after ranking."""
    out = scored(index, parse(query, counts), query_vector, **options).select(*UNIT, "score", "reasons").orderBy(*[F.asc(c) if up else F.desc(c) for c, up in ORDER])
    return out if limit is None else out.limit(max(0, int(limit)))


def by_recording(results: DataFrame) -> DataFrame:
    """The best unit of each recording, with `more`: how many further ones it stands for, which a whole-recording hit doesn't count."""
    place = "row_number() over (partition by recording_id order by score desc, date desc, start, unit_id)"
    return results.selectExpr("*", f"{place} as place", "count(1) over (partition by recording_id) as n").where("place = 1").selectExpr("unit_id", "recording_id", "score", "case when unit_id = recording_id then 0 else n - 1 end as more")


def verses(table: DataFrame, query: str) -> DataFrame:
    """(key, score) of verses (key, text) that a query is about."""
    w = T.query_words(query)
    terms = [T.stem_word(x) for x in dict.fromkeys(x for x in w if x not in T.STOP_WORDS)]
    stems = [T.stem_word(x) for x in w]
    if not terms:
        return table.select("key", F.lit(0.0).alias("score")).where(F.lit(False))
    rows = table.select("key", T.padded(F.col("text")).alias("t"))
    row = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col("t").contains(f" {t} ")).alias(f"n{i}") for i, t in enumerate(terms)]).first()
    total, df = row[0], row[1:]
    has = [F.col("t").contains(f" {t} ") for t in terms]
    pairs = [F.col("t").contains(f" {a} {b} ") for q, a, b in zip(w, stems, stems[1:], strict=False) if q in T.QUALIFIERS]
    need = 1 if len(terms) == 1 else max(2, -(-len(terms) * 6 // 10))
    ok = sum((h.cast("int") for h in has), F.lit(0)) >= need
    for p in pairs:
        ok = ok & p
    if len(terms) == 1:
        ok = ok & F.lit(bool(total) and df[0] / total <= 0.02)
    score = sum((F.when(h, F.lit(float(np.log((total + 1) / (d + 1))))).otherwise(0.0) for h, d in zip(has, df, strict=True)), F.lit(0.0))
    if len(w) > 1:
        score = score + F.when(F.col("t").contains(f" {' '.join(stems)} "), 32.0).otherwise(0.0)
    return rows.select("key", F.when(ok, score).otherwise(0.0).alias("score")).where("score > 0")
