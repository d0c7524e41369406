"""Queries of the checks on builds, sequences, nested documents, browse pages, addresses and streams, with their SQL. What a check looks for is planted by rule into copies of whole tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from outcrop.functions import addresses, timecode
from outcrop.functions.scripture import BOOKS
from outcrop.operators import archive, display, evaluate, verify
from outcrop.sources import known
from outcrop.streaming import jobs

from .catalog import query, read

# --- a build against a rebuild


@query("""with e as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate::date::varchar as day from orders), b as (select * from e where o_orderkey % 777 <> 5 union all select * from e where o_orderkey % 1000 = 3 union all select o_orderkey, o_custkey + 1, o_orderstatus, day from e where o_orderkey % 900 = 8)
 select o_orderkey, o_custkey, o_orderstatus, day, sum(n)::bigint as difference from (select *, 1 as n from b union all select *, -1 from e) group by all having sum(n) <> 0""")
def table_differences(spark, sf_dir):
    e = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    built = e.where("o_orderkey % 777 <> 5").unionByName(e.where("o_orderkey % 1000 = 3")).unionByName(e.where("o_orderkey % 900 = 8").withColumn("o_custkey", F.col("o_custkey") + 1))
    return verify.table_differences(built, e)


@query("select path, case when b is null then 'missing' when e is null then 'unexpected' else 'stale' end as problem from (select doc_id::varchar || '.txt' as path, case when doc_id % 13 = 0 then text || '.' else text end as b from documents where doc_id % 17 <> 0 union all select 'old/' || doc_id::varchar || '.txt', text from documents where doc_id % 19 = 0) full join (select doc_id::varchar || '.txt' as path, text as e from documents) using (path) where b is distinct from e")
def file_differences(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    expected = d.select(name.alias("path"), F.col("text").alias("content"))
    built = d.where("doc_id % 17 <> 0").select(name.alias("path"), F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("content"))
    return verify.file_differences(built.unionByName(d.where("doc_id % 19 = 0").select(F.concat(F.lit("old/"), name).alias("path"), F.col("text").alias("content"))), expected)


@F.pandas_udf(BinaryType())
def _packed(column: pd.Series) -> pd.Series:
    return column.map(lambda data: gzip.compress(bytes(data), 1, mtime=0), na_action="ignore")


def _artifacts(spark, sf_dir) -> DataFrame:
    """Documents as artifacts: with a packed companion, a broken one, one that the host has unpacked, or none; every eleventh without its raw file."""
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("g/"), "doc_id", F.lit(".json")).alias("path"), "doc_id", F.col("text").cast("binary").alias("content"))
    kind = F.col("doc_id") % 4
    packed = F.when(kind == 0, _packed(F.when(kind == 0, F.col("content")))).when(kind == 1, F.concat(F.unhex(F.lit("1F8B")), "content")).when(kind == 2, F.col("content"))
    companions = d.select(F.concat("path", F.lit(".gz")).alias("path"), packed.alias("content")).where("content is not null")
    return d.where("doc_id % 11 <> 0 or doc_id % 4 = 3").select("path", "content").unionByName(companions)


@query("""select 'g/' || doc_id::varchar || '.json' as name, case when doc_id % 4 = 0 then 'gzip' when doc_id % 4 = 2 then 'unpacked by host' when doc_id % 11 <> 0 or doc_id % 4 = 3 then 'raw' end as source,
 case when doc_id % 4 in (0, 2) or doc_id % 11 <> 0 or doc_id % 4 = 3 then sha256(text) end as digest from documents where text is not null""")
def artifact_loading(spark, sf_dir):
    return verify.loaded(_artifacts(spark, sf_dir)).select("name", "source", F.when(F.col("source").isNotNull(), F.sha2("content", 256)).alias("digest"))


@query("select 'g/' || doc_id::varchar || '.json' as name, case when doc_id % 11 = 0 and doc_id % 4 <> 3 then 'no raw file' when doc_id % 4 = 3 then 'no gzip companion' else 'gzip companion differs' end as problem from documents where text is not null and (doc_id % 4 <> 0 or doc_id % 11 = 0)")
def gzip_companions(spark, sf_dir):
    return verify.companion_problems(_artifacts(spark, sf_dir))


_FIELD = "case doc_id % 6 when 0 then '{{\"transcript\": {0}}}' when 1 then '{{a:1, confidence : {0}}}' when 2 then '\"a \\\"questions\\\": b\"' when 3 then 'the transcript: {0}' when 4 then '&quot;raw_body&quot;:' else '' end"


@query("select 'p/' || doc_id::varchar || case when doc_id % 5 = 0 then '.png' else '.json' end as path, case doc_id % 6 when 0 then 'transcript' when 1 then 'confidence' when 2 then 'questions' else 'raw_body' end as field from documents where doc_id % 5 <> 0 and doc_id % 6 in (0, 1, 2, 4)")
def private_fields(spark, sf_dir):
    """Private keys put before the text of each document: in quotes, bare, inside a string, as a word alone, in references, none."""
    k = F.col("doc_id") % 6
    head = F.when(k == 0, '{"transcript": 1}').when(k == 1, "{a:1, confidence : 2}").when(k == 2, '"a \\"questions\\": b"').when(k == 3, "the transcript: x").when(k == 4, "&quot;raw_body&quot;:").otherwise("")
    d = read(spark, sf_dir, "documents")
    return verify.private_fields(d.select(F.concat(F.lit("p/"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ".png").otherwise(".json")).alias("path"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content")))


_MODEL = {"id": "m", "dim": 64, "rule": "mean"}
_SHA = "sha256(coalesce(text, ''))"


@query(f"""select name, problem from (select doc_id::varchar as name, unnest(list_filter([case when doc_id % 3 = 0 then 'schema version' end, case when doc_id % 5 = 0 then 'unknown or missing keys' end, case when doc_id % 7 = 0 then 'vector file isn''t named by its digest' end, case when doc_id % 11 = 0 then 'another model' end, case when doc_id % 13 = 0 then 'duplicate unit u' || doc_id::varchar end], lambda x: x is not null)) as problem from documents where {_SHA} is not null)""")
def metadata_checks(spark, sf_dir):
    """A document of metadata for each text, its vector file named by the text's digest, with planted faults."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    model = F.when(k % 11 == 0, '{"dim": 65, "id": "m", "rule": "mean"}').otherwise('{"rule": "mean", "dim": 64, "id": "m"}')
    units = F.concat(F.lit('[{"id": "u'), k, F.lit('"}, {"id": "'), F.when(k % 13 == 0, F.concat(F.lit("u"), k)).otherwise("v"), F.lit('"}]'))
    text = F.concat(F.lit('{"schemaVersion": '), F.when(k % 3 == 0, "5").otherwise("6"), F.when(k % 5 == 0, ', "extra": 1').otherwise(""), F.lit(', "model": '), model, F.lit(', "vectors": {"file": "vectors.'), F.when(k % 7 == 0, "x").otherwise(""), sha, F.lit('.bin", "sha256": "'), sha, F.lit('"}, "units": '), units, F.lit("}"))
    return verify.metadata_problems(d.select(k.cast("string").alias("name"), text.alias("content")), _MODEL)


@query("""with l as (select 'd/' || doc_id::varchar || '/index.html' as path, unnest(['../' || (doc_id * 2)::varchar || '/', '/s/d/' || (doc_id + 1)::varchar || '/index.html#top', './', '../../../x', '/s/d/../d/' || doc_id::varchar, 'https://example.org/']) as target, unnest([doc_id * 2, doc_id + 1, doc_id, -1, doc_id, null]) as n from documents)
 select distinct path, target, case when n = -1 then 'leaves the base' else 'no such file' end as problem from l where n is not null and n not in (select doc_id from documents)""")
def page_links(spark, sf_dir):
    """A page for each document with links to others: beside it, from the root, to itself, out of the base, with dots, to another host."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    html = F.concat(F.lit('<a href="../'), k * 2, F.lit("/\">a</a><img src='/s/d/"), k + 1, F.lit("/index.html#top'><a href=\"./\">b</a><a href=\"../../../x\">c</a><a href=\"/s/d/../d/"), k, F.lit('">d</a><a href="https://example.org/">e</a>'))
    return verify.page_problems(d.select(F.concat(F.lit("d/"), k, F.lit("/index.html")).alias("path"), html.alias("content")), "/s/")


# --- sequences, references, nested documents, places


_VERSES = "select *, row_number() over (partition by file order by b, turn, n) as line from (select conv_id // 66 as file, conv_id % 66 as b, turn, 1 + turn // 4 as c, 1 + turn % 4 as v, g.n from conversations, range(0, 2) g(n) where (conv_id * 3 + turn) % 17 <> 5 and (g.n = 0 or (conv_id + turn) % 19 = 4))"


@query(f"""with l as ({_VERSES}), p as (select *, lag(b) over w as pb, lag(c) over w as pc, lag(v) over w as pv from l window w as (partition by file order by line))
 select file, line, kind from (select file, line, case when b > coalesce(pb, -1) + 1 then 'missing books' when b > coalesce(pb, -1) and c > 1 then 'missing chapters' when b > coalesce(pb, -1) and v > 1 then 'missing verses' when b > coalesce(pb, -1) then null when c > pc + 1 then 'missing chapters' when c > pc and v > 1 then 'missing verses' when c > pc then null when v = pv then 'repeated verse' when v > pv + 1 then 'missing verses' end as kind from p) where kind is not null""")
def verse_sequence(spark, sf_dir):
    """Every 66 conversations as a file of as many books, their turns as verses, four to a chapter, some taken out and some twice: what a scan of the lines finds."""
    c = read(spark, sf_dir, "conversations").selectExpr("conv_id", "conv_id div 66 as file", "conv_id % 66 as b", "turn", "1 + turn div 4 as chapter", "1 + turn % 4 as verse", "explode(sequence(0, 1)) as n")
    own = c.where("(conv_id * 3 + turn) % 17 <> 5 and (n = 0 or (conv_id + turn) % 19 = 4)")
    name = F.get(F.array(*[F.lit(names[0]) for names in BOOKS]), F.col("b").cast("int"))
    rows = own.selectExpr("*", "row_number() over (partition by file order by b, turn, n) as line").select("file", "line", F.concat(name, F.lit(" "), "chapter", F.lit(":"), "verse", F.lit("\tt")).alias("value"))
    found = known.verse_problems(known.verse_lines(rows), file="file")
    return found.select("file", F.col("line").cast("bigint").alias("line"), F.regexp_extract("problem", r"^(missing \w+|repeated verse)", 1).alias("kind"))


@query("""with r as (select n_name, n_nationkey + i as key from nation, range(0, 3) g(i) union all select n_name, n_nationkey from nation where n_nationkey % 6 = 0), v as (select s_suppkey as key from supplier)
 select n_name as subject, 'a verse twice' as problem from r group by n_name, key having count(*) > 1 union all select distinct key::varchar, 'missing verse' from r where key not in (select key from v) union all select key::varchar, 'unreferenced verse' from v where key not in (select key from r)""")
def verse_index_check(spark, sf_dir):
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    r = n.select(F.col("n_name").alias("canonical"), F.explode(F.sequence(F.col("n_nationkey").cast("bigint"), F.col("n_nationkey").cast("bigint") + 2)).alias("key"))
    twice = n.where("n_nationkey % 6 = 0").select(F.col("n_name").alias("canonical"), F.col("n_nationkey").cast("bigint").alias("key"))
    return verify.verse_index_problems(r.unionByName(twice), s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("text")))


def _nested(spark, sf_dir) -> DataFrame:
    """A JSON document for each part, with an id at a depth of its own: the number of arrays and objects around it grows with the part's size."""
    p = read(spark, sf_dir, "part")
    id_ = F.concat(F.lit("vid"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    one = F.concat(F.lit('{"youtube_id": "'), F.when(F.col("p_partkey") % 9 == 0, "short").otherwise(id_), F.lit('", "a": {"youtube_id": ["inside", {"youtube_id": "inside"}]}, "n": [1, null, "x"]}'))
    depth = F.col("p_size") % 12
    text = F.concat(F.repeat(F.lit('[{"k": 1, "b": '), depth), one, F.repeat(F.lit("}, 7]"), depth))
    return p.select("p_partkey", "p_size", text.alias("json"))


@query("select distinct 'vid' || lpad(p_partkey::varchar, 8, '0') as id from part where p_partkey % 9 <> 0 union select 'vid' || lpad((p_partkey + 100000)::varchar, 8, '0') from part where p_size % 3 = 0")
def known_ids(spark, sf_dir):
    uploads = read(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.concat(F.lit("vid"), F.lpad((F.col("p_partkey") + 100000).cast("string"), 8, "0")).alias("youtube_id"))
    return known.known_ids(_nested(spark, sf_dir), uploads, "p_partkey", "json")[0]


@query("select p_partkey, 'invalid id short' as problem from part where p_partkey % 9 = 0 union all select p_partkey, 'invalid id [\"inside\",{\"youtube_id\":\"inside\"}]' from part")
def invalid_ids(spark, sf_dir):
    return known.known_ids(_nested(spark, sf_dir), read(spark, sf_dir, "part").select(F.lit(None).cast("string").alias("youtube_id")), "p_partkey", "json")[1]


@query("""with i as (select p_partkey, replace(lower(p_brand || '.' || p_type || '.' || p_name), ' ', '.') as path from part), s as (select lower(p_brand || '.' || p_type) as path, min(p_partkey) as item from part where p_size % 2 = 0 group by 1 union all select lower(p_brand), -min(p_partkey) from part where p_size % 5 < 3 group by 1 union all select replace(lower(p_brand || '.' || p_type || '.' || p_name), ' ', '.'), 1000000 + min(p_partkey) from part where p_size % 7 = 0 group by 1)
 select i.p_partkey, i.path, (select arg_max(s.item, length(s.path)) from s where i.path = s.path or starts_with(i.path, s.path || '.')) as item from i""")
def issue_places(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    full = F.replace(F.lower(F.concat_ws(".", "p_brand", "p_type", "p_name")), F.lit(" "), F.lit("."))
    place = lambda where, path, item: p.where(where).groupBy(path.alias("path")).agg(item.alias("item"))
    least = F.min("p_partkey")
    places = place("p_size % 2 = 0", F.lower(F.concat_ws(".", "p_brand", "p_type")), least).unionByName(place("p_size % 5 < 3", F.lower("p_brand"), -least)).unionByName(place("p_size % 7 = 0", full, least + 1000000))
    return verify.placed(p.select("p_partkey", full.alias("path")), places)


# --- browse pages


_NAMES = "[" + ", ".join(f"'{names[0]}'" for names in BOOKS) + "]"
_DAY = "date '2024-01-01' + (doc_id % 365)::int"


@query(f"""with d as (select doc_id, lang, source, {_DAY} as day, {_NAMES}[doc_id % 66 + 1] as book, doc_id % 66 as book_ord from documents),
 r as (select 'scripture' as category, lower(replace(book, ' ', '-')) as facet, book as title, doc_id as item, book_ord as f, null as g, row_number() over (partition by book order by day desc, doc_id) as item_rank, count(*) over (partition by book) as n from d
  union all select 'topics', lang, lang, doc_id, 0, lang, row_number() over (partition by lang order by day desc, doc_id), count(*) over (partition by lang) from d where lang is not null
  union all select 'series', source, source, doc_id, 0, source, row_number() over (partition by source order by doc_id), count(*) over (partition by source) from d where source is not null
  union all select 'years', year(day)::varchar, year(day)::varchar, doc_id, -year(day), null, row_number() over (partition by year(day) order by day desc, doc_id), count(*) over (partition by year(day)) from d)
 select category, facet, title, dense_rank() over (partition by category order by f, g nulls first, facet) as facet_rank, n, item, item_rank from r""")
def browse_pages(spark, sf_dir):
    """Books in their own order, topics and series by title, years from the newest; items newest first, but a series as it is played."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("day"))
    ord_ = (F.col("doc_id") % 66).cast("int")
    book = F.get(F.array(*[F.lit(names[0]) for names in BOOKS]), ord_)
    newest = [-F.unix_date("day"), F.col("doc_id")]
    year = F.year("day").cast("string")
    out = archive.facet_rows(d, "scripture", F.lower(F.replace(book, F.lit(" "), F.lit("-"))), book, [ord_], "doc_id", newest)
    out = out.unionByName(archive.facet_rows(d, "topics", F.col("lang"), F.col("lang"), [F.col("lang")], "doc_id", newest))
    out = out.unionByName(archive.facet_rows(d, "series", F.col("source"), F.col("source"), [F.col("source")], "doc_id", [F.col("doc_id")]))
    return out.unionByName(archive.facet_rows(d, "years", year, year, [-F.year("day")], "doc_id", newest))


# --- times, addresses, sessions


@query("""select o_orderkey, array_to_string(list_transform(list_distinct_in_order, lambda x: printf('%.3f', x)), ' ') as times from (select o_orderkey, list_filter(t, lambda x, i: list_position(t, x) = i) as list_distinct_in_order from (select o_orderkey, list_transform([0.35, 0.5, 0.65], lambda s: round(greatest(a, least(a + (b - a) * s::double - 3, greatest(a, b - 30))), 3)) as t from (select o_orderkey, (o_custkey % 600)::double as a, (o_custkey % 600 + o_orderkey % 200 + 1)::double as b from orders)))""")
def candidate_times(spark, sf_dir):
    a, b = (F.col("o_custkey") % 600).cast("double"), (F.col("o_custkey") % 600 + F.col("o_orderkey") % 200 + 1).cast("double")
    times = evaluate.candidate_times(a, b, F.lit(1000.0))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(times, lambda t: F.format_string("%.3f", t)), " ").alias("times"))


@query("""select c_custkey, '/a/search/?q=' || url_encode(c_name) as search, '/a/browse/topics/' || replace(url_encode(c_mktsegment || ' ' || c_name), '+', '%20') || '/' as browse, '/a/edit/' || replace(url_encode(c_name), '+', '%20') || '/' || case when c_acctbal > 0 then '?t=' || floor(c_acctbal)::bigint::varchar else '' end as edit,
 'https://www.youtube.com/watch?v=' || url_encode(c_name) || '&t=' || greatest(0, floor(c_acctbal)::bigint)::varchar as video from (select *, replace(c_name, '#', '') as x from customer)""")
def page_addresses(spark, sf_dir):
    c, base = read(spark, sf_dir, "customer"), F.lit("a")
    return c.select("c_custkey", addresses.search_url(base, F.col("c_name")).alias("search"), addresses.browse_url(base, F.concat(F.lit("topics/"), F.concat_ws(" ", "c_mktsegment", "c_name"))).alias("browse"), addresses.edit_url(base, F.col("c_name"), F.col("c_acctbal")).alias("edit"), addresses.youtube_url(F.col("c_name"), F.col("c_acctbal")).alias("video"))


@query("""select o_orderkey, case when h > 0 then h::varchar || ' h' || case when m > 0 then ' ' || m::varchar || ' min' else '' end when m > 0 then m::varchar || ' min' || case when m < 10 and r > 0 then ' ' || r::varchar || ' s' else '' end else r::varchar || ' s' end as long, strftime(o_orderdate, '%-d %B %Y') as day, upper(o_orderpriority[1]) || replace(o_orderpriority[2:], '-', ' ') as kind from (select *, s // 3600 as h, s % 3600 // 60 as m, s % 60 as r from (select *, floor(o_totalprice / 50 + 0.5)::bigint as s from orders))""")
def durations(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", timecode.duration(F.col("o_totalprice") / 50).alias("long"), timecode.long_date(F.col("o_orderdate")).alias("day"), timecode.type_name(F.col("o_orderpriority")).alias("kind"))


@query("select user_id, (epoch_us(ts) // 1000) as at, event_type as query from (select *, lead(ts) over (partition by user_id order by ts) as after from (select user_id, ts, max(event_type) as event_type from events group by 1, 2)) where after is null or (epoch_us(after) // 1000) - (epoch_us(ts) // 1000) >= 3600000")
def settled_queries(spark, sf_dir):
    """What users asked and then left alone for an hour."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("query"))
    return jobs.settled(e, "user_id", delay_ms=3_600_000).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "query")


@query("""with p as (select *, lead(ts) over (partition by user_id order by ts) as after from (select user_id, ts, sum(event_id % 1000)::bigint as n from events group by 1, 2)), f as (select user_id, min(ts) as ts from p where (epoch_us(after) // 1000) - (epoch_us(ts) // 1000) > 36000000 group by 1)
 select f.user_id, (epoch_us(f.ts) // 1000) as at, sum(p.n)::bigint as received from f join p on p.user_id = f.user_id and p.ts <= f.ts group by 1, 2""")
def stalled_downloads(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_id") % 1000).alias("bytes"))
    return jobs.stalled(e, "user_id", stall_ms=36_000_000).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("received").cast("bigint").alias("received"))
