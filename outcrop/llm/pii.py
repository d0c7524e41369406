r"""Personal data by bootstrapped contextual extraction.

Seeds are what four exact forms find in a text: e-mail addresses, IPv4 addresses, card numbers that pass the Luhn test, and
international phone numbers. Identifiers in other forms are then found by their contexts. An instance is a run of up to WORDS words that have
a digit or an at sign, with five digits or an at sign in all, without the marks it begins or ends with; it may be of any length, and is a seed of a kind where it holds a seed span. Patterns are
what stands around it, digits written as 0: two words before, two words after, one on each side, and the word before with the shape of the
instance (runs of letters a, runs of digits 0); a neighbouring word counts by its NEAR nearest characters. Pattern and instance form a graph over the whole corpus, on distinct pairs, in which scores go
back and forth STEPS times: a pattern scores the mean of its instances, as if it had one more that scores 0; an instance that isn't a seed
scores the complement of the product of its patterns' complements. Then patterns with SUPPORT or more distinct seeds and a score of
CONFIDENT or more mark their other instances, which become seeds themselves and confirm further patterns, which mark further instances, until a
round marks none. What is marked as a card must pass a card's own test of digits. A marked instance is a span wherever it stands.

All on DataFrames: expressions of one row find spans, and the graph is joins and aggregates on distinct pairs, so copies of
a passage count once and a pattern with a large share of all rows is summed map-side. No form repeats a group without bound, since Java's
matcher takes a stack frame for each repetition: a text is first written so that the maximal run of one character class is the match.

Defined results: a null text is empty; spans are code points, end exclusive; a card, address or number that fails its test is dropped
without looking for a shorter one; ids may be null or repeated: rows are told apart by id and text, and equal ones get equal
results; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
STEPS, SUPPORT, CONFIDENT = 3, 5, 0.8
WORDS, NEAR = 6, 80
OPENING, CLOSING = r"^[(\[{<\"'«“‘*_]+", r"[)\]}>\"'»”’*_.,;:!?]+$"  # marks around an instance
BLOCK = 256

#: (a cheap test that a text has any; what is written for what, one character for another; what may stand before a match; the match). A match
#: starts where the last one ended or after a character that couldn't belong to it, so each run of such characters is tried once. Dots that
#: no label follows become a mark that ends the domain (and may begin the next address), as do spaces and hyphens that aren't between digits.
#: Runs too short for the digits that are wanted fail in any case and needn't be matched.
FORMS = {
    "email": (r"@[A-Za-z0-9-]", (r"\.(?![A-Za-z0-9-])", "%"), r"|.*?[^A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", None, r"|.*?[^0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", (r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "_"), r"|.*?[^0-9]", r"[0-9][\x20\x2D0-9]{12,}+"),
    "phone": (r"\+[0-9][\x20().0-9-]{7}", None, r".*?", r"\+[0-9][\x20().0-9-]{7,}[0-9]"),
}
RUN = r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
SPAN = "struct<kind:int,start:int,end:int>"


def _located(t: Column, before: str, match: str) -> Column:
    """[(start, end, value, gap)] of a pattern's matches from the left, gap being the text since the last one."""
    form = F.lit(rf"(?s)\G({before})({match})")  # from the last match's end on: what follows the last one is scanned once
    hits = F.arrays_zip(F.regexp_extract_all(t, form, F.lit(1)).alias("gap"), F.regexp_extract_all(t, form, F.lit(2)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,gap:string>>")
    taken = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    step = lambda acc, x: F.struct(
        (acc["at"] + taken(x)).alias("at"),
        F.array_append(acc["found"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + taken(x)).alias("end"), x["hit"].alias("value"), x["gap"].alias("gap"))).alias("found"),
    )

    # Appending copies, so hits are gone through in blocks, from where each block begins.
    def placed(every: Column) -> Column:
        block = lambda i: F.slice(every, (i * BLOCK + 1).cast("int"), F.lit(BLOCK))
        further = lambda acc, i: F.struct((acc["at"] + F.aggregate(block(i), F.lit(0), lambda n, x: n + taken(x))).alias("at"), F.array_append(acc["begin"], acc["at"]).alias("begin"))
        begin = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begin")), further, lambda acc: acc["begin"])
        return F.flatten(F.transform(begin, lambda at, i: F.aggregate(block(i), F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])))

    return F.get(F.transform(F.array(hits), lambda every: F.when(F.size(every) > 0, placed(every)).otherwise(none)), F.lit(0))


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(t: Column) -> Column:
    """[(kind, start, end)] of the four forms, by kind, then start."""

    def of(n: int, kind: str) -> Column:
        test, written, before, match = FORMS[kind]
        found = F.filter(_located(F.regexp_replace(t, *written) if written else t, before, match), lambda x: _valid(kind, x["value"]))
        spans = F.transform(found, lambda x: F.struct(F.lit(n).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(t.rlike(test), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _instances(t: Column) -> Column:
    """[(start, end, value, gap)]: runs of words with a digit or an at sign, single spaces between them."""
    runs = _located(t, r"|.*?[\x20\x09-\x0D]", rf"{RUN}(?:\x20{RUN}){{0,{WORDS - 1}}}")
    return F.when(t.rlike("[0-9@]"), runs).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,gap:string>>"))


def _contexts(x: Column) -> Column:
    """The patterns of an instance x with left and right, its neighbouring words from the nearest on."""
    word = lambda side, at: F.lower(F.regexp_replace(F.coalesce(F.get(x[side], F.lit(at)), F.lit("")), "[0-9]", "0"))
    shape = F.regexp_replace(F.regexp_replace(x["instance"], r"[\p{L}]+", "a"), "[0-9]+", "0")
    return F.array(
        F.concat_ws(" ", F.lit("<"), word("left", 1), word("left", 0)),
        F.concat_ws(" ", F.lit(">"), word("right", 0), word("right", 1)),
        F.concat_ws(" ", F.lit("|"), word("left", 0), word("right", 0)),
        F.concat_ws(" ", F.lit("="), word("left", 0), shape),
    )


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, more) for every row: spans of the four forms, and those that contexts add."""
    scratch = common.Scratch(docs.sparkSession, "pii")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    one = docs.select("doc_id", F.xxhash64(t).alias("text_hash"), t.alias("t")).select("doc_id", "text_hash", "t", base_spans(F.col("t")).alias("base"), _instances(F.col("t")).alias("runs"))
    one = one.withColumn("tail", F.substring(F.col("t"), F.coalesce(F.get("runs", F.size("runs") - 1)["end"], F.lit(0)) + 1, F.lit(NEAR)))
    part = lambda at, name: F.coalesce(F.get(F.col("runs"), at)[name], F.lit(""))
    bare = lambda r: F.regexp_replace(F.regexp_replace(r["value"], OPENING, ""), CLOSING, "")
    begin = lambda r: r["start"] + F.length(r["value"]) - F.length(F.regexp_replace(r["value"], OPENING, ""))
    around = F.transform("runs", lambda r, i: F.struct(
        begin(r).alias("start"), (begin(r) + F.length(bare(r))).alias("end"), F.lower(bare(r)).alias("instance"),
        F.filter("base", lambda s: (s["start"] >= r["start"]) & (s["end"] <= r["end"])).alias("held"),
        F.slice(F.reverse(common.words(F.concat(F.right(part(i - 1, "value"), F.lit(NEAR)), F.right(r["gap"], F.lit(NEAR))))), 1, 2).alias("left"),
        F.slice(common.words(F.when(i + 1 < F.size("runs"), F.concat(F.left(part(i + 1, "gap"), F.lit(NEAR)), F.left(part(i + 1, "value"), F.lit(NEAR)))).otherwise(F.col("tail"))), 1, 2).alias("right"),
    ))
    known = F.filter(around, lambda x: x["instance"].rlike(r"@|[0-9](?:[^0-9]*+[0-9]){4}"))
    found = scratch.save(one.select("doc_id", "text_hash", "base", known.alias("around")))
    seen = found.select("doc_id", "text_hash", F.explode("around").alias("x"))
    kind = F.get(F.col("x.held"), F.lit(0))["kind"]
    edges = scratch.save(seen.select(kind.alias("kind"), F.col("x.instance").alias("instance"), F.explode(_contexts(F.col("x"))).alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    marked = promoted(edges, scratch)
    new = seen.where(kind.isNull()).select("doc_id", "text_hash", "x.start", "x.end", "x.instance").join(marked.withColumnRenamed("kind", "as"), "instance")
    more = new.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_set(F.struct(F.col("as").alias("kind"), F.col("start"), F.col("end")))).alias("more"))
    joined = found.join(more, found["doc_id"].eqNullSafe(more["d"]) & (found["text_hash"] == more["h"]), "left")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")).alias("more"))


def promoted(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(instance, kind) of instances that aren't seeds of the forms, marked in rounds in which those marked before are seeds. edges: distinct (pattern, instance, kind or null)."""
    marked = scratch.save(edges.select("instance", "kind").limit(0))
    while True:
        # A card number is one by its digits, whatever is between them: a context alone makes none.
        new = scratch.save(confident(edges).where((F.col("kind") != KINDS.index("card")) | _valid("card", F.col("instance"))).groupBy("instance").agg(F.max("kind").alias("kind")))
        if new.isEmpty():
            return marked
        after = scratch.save(marked.unionByName(new))
        scratch.drop(marked)
        # Instances that are marked are seeds from here on, so each round marks others, and the rounds end.
        wider = scratch.save(edges.join(new.withColumnRenamed("kind", "as"), "instance", "left").select("pattern", "instance", F.coalesce("kind", "as").alias("kind")))
        scratch.drop(edges, new)
        edges, marked = wider, after


def confident(edges: DataFrame, steps: int = STEPS, support: int = SUPPORT, least: float = CONFIDENT) -> DataFrame:
    """(pattern, instance, kind) of instances that aren't seeds, marked by confident patterns. edges: distinct (pattern, instance, kind or null)."""
    seeds = edges.where("kind is not null").groupBy("pattern", F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("seeds"))
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # Patterns without enough seeds of a kind can mark nothing, and leave the graph at once.
    base = seeds.where(F.col("seeds") >= support).join(total, "pattern")
    scores = base.select("pattern", "k", "seeds", "n", (F.col("seeds") / (F.col("n") + 1)).alias("score"))
    open_edges = edges.where("kind is null").select("pattern", "instance")
    for _ in range(steps):
        on = open_edges.join(scores.select("pattern", "k", "score"), "pattern")
        instances = on.groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))).alias("belief"))
        gained = on.join(instances, ["instance", "k"]).groupBy("pattern", "k").agg(F.sum("belief").alias("gained"))
        scores = base.join(gained, ["pattern", "k"], "left").select("pattern", "k", "seeds", "n", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + 1)).alias("score"))
    return open_edges.join(scores.where(F.col("score") >= least), "pattern").groupBy("pattern", "instance").agg(F.max_by("k", F.struct("score", "k")).alias("kind"))


def query(spark, sf_dir: str) -> DataFrame:
    found = spans(common.read(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("bigint")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    every = F.sort_array(F.array_union("base", "more"))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"), F.size("more").cast("bigint").alias("n_more"), F.size(every).cast("bigint").alias("n_pii"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text): every span replaced by its kind in square brackets. Overlapping spans are replaced as one, by the first's kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    at = F.sort_array(F.transform(F.array_union("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = spans(docs, text).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), at.alias("at"))
    own = docs.select("doc_id", t.alias("t"), F.xxhash64(t).alias("text_hash"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["d"]) & (own["text_hash"] == found["h"]))
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["done"], F.struct(F.greatest(acc["done"], s["end"]).alias("done"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("done"), F.concat(acc["out"], F.substring(F.col("t"), acc["done"] + 1, s["start"] - acc["done"]), F.get(names, s["kind"])).alias("out")))
    return joined.select("doc_id", F.aggregate("at", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["done"] + 1, F.length("t")))).alias("text"))
