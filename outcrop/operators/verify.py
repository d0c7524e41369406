"""A build held against what it is made of: tables, files, their companions and metadata, the verse index, places of issues. Each check returns rows, none where all is well."""

from __future__ import annotations

import gzip
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from outcrop.functions import scripture as S

from .archive import violations

# Fields of private records, names that no build has, and the largest file of a static host.
PRIVATE_FIELDS = "passages|transcript|transcript_file|transcript_engine|questions|confidence|review_notes|reviewNotes|source_chapters|rawBody|raw_body|raw_hash|rawHash|raw_sha256|audio_sha256|audioSha256|transcript_sha256|transcriptSha256|caption_provenance|caption_sha256|evidence_sha256|dictionary_sha256|input_sha256|source_kind|transcription_provenance|transcribed_span|sourceFileRef|source_path|sourcePath|transcriptPath"
PRIVATE_NAMES = r"(?i)(?:^|/)(?:\.env[^/]*|\.local|\.git|corpus|transcripts?|evidence|passages(?:\.[^/]*)?|vectors\.json(?:\.[^/]*)?|chapter-vectors\.(?:json|bin)|service\.ya?ml|media-authorization\.json|evidence\.(?:txt|json)|ggml-[^/]+|[^/]+\.internal\.[^/]+|[^/]+\.(?:ya?ml|mp4|mkv|wav|mp3|webm|part))(?=/|$)"
LARGEST = 100 * 1024 * 1024
TEXT_NAMES = r"(?i)\.(?:html?|json|js|mjs|cjs|css|txt|xml|svg|map|md)$"
UNIT_ID, UNIT_KINDS = r"^[A-Za-z0-9][A-Za-z0-9_/-]*$", ("recording", "chapter", "subchapter", "point")


# --- tables and files against a rebuild


def table_differences(built: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows that the two tables don't have equally often, with `difference`: how many more built has (less, if negative). One shuffle, in which equal rows are summed before they move."""
    columns = expected.columns
    both = built.select(*columns, F.lit(1).alias("difference")).unionByName(expected.select(*columns, F.lit(-1).alias("difference")))
    return both.groupBy(*columns).agg(F.sum("difference").alias("difference")).where("difference <> 0")


def file_differences(built: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem) of files (path, content) that are missing, unexpected, or stale: of another digest. Contents don't move, digests do."""
    digest = lambda df, name: df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))
    both = digest(built, "b").join(digest(expected, "e"), "path", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("b") != F.col("e"), "stale")
    return both.select("path", problem.alias("problem")).where("problem is not null")


@F.pandas_udf(BinaryType())
def _gunzip(column: pd.Series) -> pd.Series:
    def plain(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return None

    return column.map(plain, na_action="ignore")


@F.pandas_udf(LongType())
def gzip_size(column: pd.Series) -> pd.Series:
    """The bytes of a content when it is packed."""
    return column.map(lambda data: len(gzip.compress(bytes(data), mtime=0)), na_action="ignore").astype("Int64")


def is_gzip(content: Column) -> Column:
    return F.hex(F.substring(content.cast("binary"), 1, 2)) == "1F8B"


def _paired(files: DataFrame) -> DataFrame:
    """(name, raw, packed): each artifact's own file and its companion with the ending .gz."""
    named = files.select(F.regexp_replace("path", r"\.gz$", "").alias("name"), F.col("path").endswith(".gz").alias("gz"), F.col("content").cast("binary").alias("content"))
    side = lambda gz: named.where(F.col("gz") == gz).select("name", F.col("content").alias("packed" if gz else "raw"))
    return side(False).join(side(True), "name", "full")


def loaded(files: DataFrame) -> DataFrame:
    """(name, content, source): what a reader of an artifact gets of files (path, content). The companion is unpacked if its first bytes say that it is packed, and taken as it is if a host
    has unpacked it already; a missing or broken one leaves the raw file."""
    p = _paired(files).withColumn("plain", _gunzip(F.when(is_gzip(F.col("packed")), F.col("packed"))))
    packed = is_gzip(F.col("packed"))
    source = F.when(packed & F.col("plain").isNotNull(), "gzip").when(F.col("packed").isNotNull() & ~packed, "unpacked by host").when(F.col("raw").isNotNull(), "raw")
    content = F.when(F.col("source") == "gzip", F.col("plain")).when(F.col("source") == "raw", F.col("raw")).otherwise(F.col("packed"))
    return p.withColumn("source", source).select("name", content.alias("content"), "source")


def companion_problems(files: DataFrame, name: str = r"\.(?:json|bin)$") -> DataFrame:
    """(name, problem) of artifacts whose packed companion is missing or another content."""
    p = _paired(files).where(F.col("name").rlike(name)).withColumn("plain", _gunzip("packed"))
    problem = F.when(F.col("raw").isNull(), "no raw file").when(F.col("packed").isNull(), "no gzip companion").when(~F.col("raw").eqNullSafe(F.col("plain")), "gzip companion differs")
    return p.select("name", problem.alias("problem")).where("problem is not null")


def private_fields(files: DataFrame) -> DataFrame:
    """(path, field) of texts (path, content) that have a private field as a key, in quotes or bare after a comma or brace, or written inside a JSON string."""
    quote = "(?:[\"']|&quot;|&#34;)"
    key = rf"(?i)(?:{quote}({PRIVATE_FIELDS}){quote}|[,{{]\s*({PRIVATE_FIELDS}))\s*:"
    # A computed score of a library's worker is code, not a record.
    score = r"(?i)[,{]\s*confidence\s*:\s*[A-Za-z_$][\w$]*\s*/\s*\(\s*[A-Za-z_$][\w$]*\s*-\s*[A-Za-z_$][\w$]*\s*\)(?=\s*[,}])"
    worker = F.col("path").rlike(r"^_astro/semantic\.worker-[\w-]+\.js$")
    text = F.replace(F.col("content").cast("string"), F.lit('\\"'), F.lit('"'))
    text = F.when(worker, F.regexp_replace(text, score, " ")).otherwise(text)
    found = F.concat(*[F.regexp_extract_all(text, F.lit(key), F.lit(g)) for g in (1, 2)])
    return files.where(F.regexp_replace("path", r"\.gz$", "").rlike(TEXT_NAMES)).select("path", F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("field"))


def output_problems(files: DataFrame, private: DataFrame, shingle_leaks) -> DataFrame:
    """(path, problem) of everything that mustn't be in a build (path, content): names, sizes, private fields, links to retired addresses, runs of private texts. private: (text); shingle_leaks as in timeline."""
    named = files.where(F.col("path").rlike(PRIVATE_NAMES) | F.col("path").rlike(r"^services/\d{4}(?:/|$)")).select("path", F.lit("private or media file").alias("problem"))
    large = files.where(F.octet_length(F.col("content")) >= LARGEST).select("path", F.lit("too large for a static host").alias("problem"))
    fields = private_fields(files).select("path", F.concat(F.lit("private field "), "field").alias("problem"))
    hrefs = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1))
    retired = F.exists(hrefs, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")).rlike(r"/watch/?\?(?:[^#]*&)?id="))
    links = files.where(F.col("path").rlike(r"\.html?$") & retired).select("path", F.lit("link to a retired address").alias("problem"))
    texts = files.where(F.col("path").rlike(TEXT_NAMES)).select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))
    leaks = shingle_leaks(texts, private).select(F.col("doc_id").alias("path"), F.lit("run of a private text").alias("problem"))
    out = named
    for more in (large, fields, links, leaks):
        out = out.unionByName(more)
    return out


# --- what artifacts say of themselves


def metadata_problems(documents: DataFrame, model: dict, version: int = 6) -> DataFrame:
    """(name, problem) of search metadata (name, content): its version and keys, the vector file's name by its digest, the model's recipe whatever the order of its keys, ids once each."""
    kind = "struct<schemaVersion:int,model:string,vectors:struct<file:string,sha256:string>,units:array<struct<id:string>>>"
    m = documents.select("name", F.from_json("content", kind).alias("m"), F.json_object_keys("content").alias("keys"))
    flat = lambda text: F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    wanted = F.lit(json.dumps(model))
    rules = {
        "schema version": F.col("m.schemaVersion") == version,
        "unknown or missing keys": F.array_sort("keys") == F.array(*[F.lit(k) for k in sorted(("schemaVersion", "model", "vectors", "units"))]),
        "vector file isn't named by its digest": F.col("m.vectors.sha256").rlike("^[a-f0-9]{64}$") & (F.col("m.vectors.file") == F.concat(F.lit("vectors."), "m.vectors.sha256", F.lit(".bin"))),
        "another model": flat(F.col("m.model")) == flat(wanted),
    }
    own = violations(m, "name", rules).withColumnRenamed("subject", "name")
    twice = m.select("name", F.explode("m.units.id").alias("id")).groupBy("name", "id").count().where("count > 1").select("name", F.concat(F.lit("duplicate unit "), "id").alias("problem"))
    return own.unionByName(twice)


def unit_problems(units: DataFrame, counts: dict[str, list[int]]) -> DataFrame:
    """(subject, problem) of public search units: unit_id, recording_id, recording_title, date (text), kind, title, text, entry_id, start, end, scripture and scripture_display (arrays),
    topics, series (id, title), preview. Points have no end, others one after their start; references are canonical and what is shown for them stands for the same."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    end = F.when(F.col("kind") == "point", F.col("end").isNull()).otherwise(finite("end") & (F.col("end") > F.col("start")))
    shown = F.col("scripture_display").isNull() | (F.size("scripture_display") == F.size("scripture"))
    own = violations(units, "unit_id", {
        "id": F.col("unit_id").rlike(UNIT_ID), "recording id": F.col("recording_id").rlike(UNIT_ID), "recording title": filled("recording_title"), "title": filled("title"),
        "date": F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "kind": F.col("kind").isin(*UNIT_KINDS), "text": F.col("text").isNull() | filled("text"),
        "entry id": F.col("entry_id").isNull() | F.col("entry_id").rlike(UNIT_ID), "start": finite("start") & (F.col("start") >= 0), "end": end,
        "topics": F.col("topics").isNotNull() & F.forall("topics", lambda t: F.trim(t) != ""), "preview": F.col("preview").isNotNull(),
        "series": F.col("series").isNull() | (F.col("series.id").rlike(UNIT_ID) & (F.trim("series.title") != "")), "references shown": F.col("scripture").isNotNull() & shown,
    })
    each = units.select("unit_id", F.posexplode("scripture").alias("i", "reference"), F.col("scripture_display").alias("d")).select("unit_id", "reference", F.coalesce(F.get("d", F.col("i")), "reference").alias("shown"))
    read = each.select("unit_id", "reference", S.parse_udf(counts)("reference").alias("own"), S.parse_udf(counts)("shown").alias("other"))
    wrong = F.when(~F.col("own.canonical").eqNullSafe(F.col("reference")), "reference isn't canonical").when(~F.col("other.canonical").eqNullSafe(F.col("reference")), "what is shown is another reference")
    return own.unionByName(read.select(F.col("unit_id").alias("subject"), wrong.alias("problem")).where("problem is not null").distinct())


def verse_index_problems(references: DataFrame, verses: DataFrame, counts: dict[str, list[int]] | None = None) -> DataFrame:
    """(subject, problem) of a verse index: references (canonical, key) and verses (key, text). With counts, references must be canonical and keys single verses."""
    twice = references.groupBy("canonical", "key").count().where("count > 1").select(F.col("canonical").cast("string").alias("subject"), F.lit("a verse twice").alias("problem"))
    as_problem = lambda df, c, what: df.select(F.col(c).cast("string").alias("subject"), F.lit(what).alias("problem")).distinct()
    out = twice.distinct().unionByName(as_problem(references.where("key is not null").join(verses, "key", "left_anti"), "key", "missing verse")).unionByName(as_problem(verses.join(references, "key", "left_anti"), "key", "unreferenced verse"))
    if counts:
        parsed = S.parse_udf(counts)
        names = references.select("canonical").distinct().where(~F.coalesce(parsed("canonical")["canonical"].eqNullSafe(F.col("canonical")), F.lit(False)))
        keys = references.select("key").distinct().where(~F.coalesce(parsed("key")["canonical"].eqNullSafe(F.col("key")), F.lit(False)) | ~F.col("key").rlike(r"^.+ \d+:\d+$"))
        out = out.unionByName(as_problem(names, "canonical", "reference isn't canonical")).unionByName(as_problem(keys, "key", "no single verse"))
    return out


# --- places of issues


def placed(issues: DataFrame, places: DataFrame, path: str = "path", item: str = "item") -> DataFrame:
    """issues with `item`: that of the longest beginning of their path (parts between dots) that places (path, item) has, null if none. Each beginning is a row, so this is an
    equi-join, and the longest one is a maximum."""
    parts = F.split(path, r"\.")
    begun = issues.select(path).distinct().select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("begin")))).alias("b"))
    met = begun.join(places.select(F.col(path).alias("begin"), F.col(item).alias("_item")), begun["b.begin"] == F.col("begin"))
    best = met.groupBy(path).agg(F.max_by("_item", F.struct("b.n", "_item")).alias(item))
    return issues.join(best, path, "left")



# --- links of built pages


def _resolved(path: Column) -> Column:
    """An absolute path without . and .. parts; .. above the root stays there."""
    parts = F.split(path, "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).when((p == ".") | (p == ""), acc).otherwise(F.array_append(acc, p)))
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin("", ".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def page_problems(files: DataFrame, base: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, target, problem) of links and sources in the pages among files (path, content) of a site under base: those that leave the base, and those that no file answers, a folder by its
    index.html; and routes that must be there. Other hosts, mail addresses, data and places within a page aren't looked up. Each link is an equi-join with the files' paths."""
    found = F.regexp_extract_all("content", F.lit(r"\b(?:href|src)\s*=\s*(?:\"([^\"]+)\"|'([^']+)')"), F.lit(0))
    target = lambda m: F.replace(F.regexp_replace(m, r"(?s)^\w+\s*=\s*[\"'](.*)[\"']$", "$1"), F.lit("&amp;"), F.lit("&"))
    links = files.where(F.col("path").rlike(r"\.html?$")).select("path", F.explode(F.array_distinct(F.transform(found, target))).alias("target"))
    links = links.where(~F.col("target").rlike(r"(?i)^(?:#|https?:|mailto:|data:)") & (F.col("target") != ""))
    plain = F.regexp_replace("target", r"(?s)[?#].*$", "")
    here = F.concat(F.lit(base), F.col("path"))
    whole = F.when(plain == "", here).when(plain.startswith("/"), plain).otherwise(F.concat(F.regexp_replace(here, "[^/]*$", ""), plain))
    at = links.withColumn("whole", F.when(F.col("target").startswith("//"), None).otherwise(_resolved(whole)))
    inside = F.coalesce(F.concat("whole", F.lit("/")).startswith(base), F.lit(False))
    leaves = at.where(~inside).select("path", "target", F.lit("leaves the base").alias("problem"))
    name = F.regexp_replace(F.try_url_decode(F.replace(F.substring("whole", F.lit(len(base) + 1), F.length("whole")), F.lit("+"), F.lit("%2B"))), "/$", "")
    tried = at.where(inside).select("path", "target", F.explode(F.array(name, F.concat(F.when(name == "", "").otherwise(F.concat(name, F.lit("/"))), F.lit("index.html")))).alias("name"))
    there = files.select(F.col("path").alias("name"), F.lit(True).alias("found")).distinct()
    answered = tried.join(there, "name", "left").groupBy("path", "target").agg(F.max("found").alias("found"))
    dead = answered.where("found is null").select("path", "target", F.lit("no such file").alias("problem"))
    out = leaves.unionByName(dead)
    if required:
        routes = files.sparkSession.createDataFrame([(r,) for r in required], "name string")
        out = out.unionByName(routes.join(there, "name", "left_anti").select(F.col("name").alias("path"), F.lit(None).cast("string").alias("target"), F.lit("missing route").alias("problem")))
    return out
