r"""Secret scan: candidate strings, and a random forest that removes the false positives among them.

A candidate is one of these: the value, of any length and any characters, that is assigned to a name with an announcing word in it
(in quotes all of it, else up to white space or the next `&name=`, without closing marks), or that such a name `is`, if it has a digit; the password in a URL; three parts joined by dots, the
last of 16 or more characters; a run of 16 or more characters of `[A-Za-z0-9_+/-]` with a digit in it, and the `=` that pad it.

Features come from the candidate (length; shares of digits, cases and marks; distinct characters; changes of character class; the mean log-odds of its character transitions; how much
dictionary words cover), from what stands before and after it (the log-odds of the neighbouring words: the nearest, and the mean of all; an assignment, a quote, a URL) and from its path (the log-odds of its parts, tests, documents,
settings). Log-odds of transitions, words and path parts are learnt from labelled findings, as is the dictionary, beside a small fixed one: from one half of them by hash; the
forest is trained on the other half, so it doesn't see odds that its own rows made. The labelled findings are given or, by default, a fixed set made by rule from a seed, with hard negatives: hashes, ids and
placeholders under announcing words, and secrets under words that don't announce. held_out() tells precision and recall on a fifth that neither half has. Candidates that the forest
scores below `THRESHOLD` are false positives; they stay in the result, marked.

What is learnt goes to the driver and into the plan: at most WORDS words of each kind and one number for each of SYMBOLS ** 2 transitions.

Expressions of one row find and describe candidates, and Spark's own forest scores them: no Python on the executors.

Defined results: null, empty and blank texts have no candidates; a null path is an empty one; labelled findings without a column
`after` have nothing after them; equal candidates and repeated rows each
give a row; an empty table gives an empty result; labelled findings of one kind give that kind's share as the score; other columns
aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
TREES, DEPTH, SEED = 30, 7, 11
FINDINGS = 4096
WORDS, OFTEN = 200, 3  # words that are learnt, and how often they must have been seen
BEFORE = 40  # characters before a candidate that are looked at, and after it
_RUN = r"[A-Za-z0-9_+/-]"

# Words by what they say about a string near them, and a small dictionary for coverage.
ANNOUNCES = "secret token passwd password pwd apikey api_key access_key private_key credential auth bearer signature client_secret".split()
DENIES = "sha1 sha256 md5 commit checksum digest uuid guid revision etag hash example sample placeholder dummy integrity build".split()
DICTIONARY = "account action address application array base build button cache class client code component config connection container content context controller count create data database default device document element email error event example factory field file format function group handler header image index input item key label language layer level library list local manager message method model module name network number object option order output page parameter parser password path pattern payment plugin policy process product profile project property provider query queue reader record reference register report request resource response result role route sample schema script search secret section server service session setting source state status storage string style system table target task template test text thread time token type update user utility value version view widget window worker writer".split()

FEATURES = ("length", "changes", "digits", "upper", "lower", "marks", "distinct", "hex", "transitions", "covered", "nearest", "next", "around", "path_odds", "test_path", "text_path", "settings_path", "assigned", "quoted", "in_url")
SYMBOLS = 30  # a to z, capitals, digits, _ and -, others

# A name that announces, up to its value. The empty groups 2 and 3 say to the value's pattern what stands before it.
_SECRETS = [x.replace("_", "[_-]?") for x in ANNOUNCES]
_NAME = rf"(?:(?<![A-Za-z])(?i:{'|'.join(_SECRETS)})|(?<=[a-z])(?:{'|'.join(x[0].upper() + x[1:] for x in _SECRETS)}))(?:s|S)?(?![a-z])[A-Za-z0-9_-]*+[\"'`\]]{{0,2}}[ \t]*+(?:(?:=>|:=|={{1,3}}|:)[ \t]*+|(?<=[ \t])(?:is|was)[ \t]++(?=[^\s]*[0-9]))"
_QUOTED = "|".join(rf"(?<={q})(?![^{q}\r\n]*\s)[^{q}\s]++(?={q})|(?<={q})(?![^{q}\r\n]*{_RUN}{{16}})[^{q}\r\n]++(?={q})" for q in ('"', "'", "`"))
_BARE = "".join(rf"(?!(?<={q})[^{q}\r\n]*+{q})" for q in ('"', "'", "`")) + r"&?+[^\s\"'`&]++(?:&(?![A-Za-z_][A-Za-z0-9_]*=)[^\s\"'`&]*+)*+"
_URL = r"://[^\s/:@\"'`]*+:"
_WHOLE_RUN = rf"(?=[A-Za-z_+/-]*[0-9]){_RUN}{{16,}}+={{0,2}}"
_DOTTED = r"(?=[A-Za-z_.-]*[0-9])(?:[A-Za-z0-9_-]++\.){2}[A-Za-z0-9_-]{16,}+"
_FORM = rf"(?s)\G(.*?(?:{_NAME}[\"'`]?+()|{_URL}()(?=[^\s/@\"'`]++@)|(?<!{_RUN})(?=[A-Za-z0-9_+/.-]{{16}})(?!{_RUN}*?{_NAME})))(\2(?:{_QUOTED}|{_BARE})|\3[^\s/@\"'`]++|(?!\2|\3)(?:{_DOTTED}|{_WHOLE_RUN}))"


@dataclass(frozen=True)
class Learnt:
    """What labelled findings say of words, path parts and character transitions, as log-odds of being a secret, and the words that cover ordinary names."""

    words: dict[str, float]
    paths: dict[str, float]
    transitions: list[float]
    dictionary: list[str]


def _symbols(text: Column) -> Column:
    """The characters of a text by kind, as numbers below SYMBOLS."""
    one = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("A", "Z"), 26).when(c.between("0", "9"), 27).when(c.isin("_", "-"), 28).otherwise(29)
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def _transitions(text: Column) -> Column:
    """Each two neighbouring characters, as one number."""
    x = _symbols(text)
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: a * SYMBOLS + b)


def _near(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+(?:_[\p{L}]+)*"), F.lit(0))


def _parts(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(path), F.lit(r"[a-z]+"), F.lit(0))


def _odds(rows: DataFrame, of: Column, most: int | None = WORDS) -> dict:
    """The smoothed log-odds of each element of an array column; of those seen OFTEN, at most `most`, the commonest first."""
    each = rows.select(F.col("label").cast("int").alias("y"), F.explode(F.array_distinct(of) if most else of).alias("x"))
    sums = each.groupBy("x").agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).first()
    yes, no = (total["yes"] or 0) + 2, (total["n"] or 0) - (total["yes"] or 0) + 2
    if most:
        sums = sums.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "x").limit(most)
    return {r["x"]: math.log((r["yes"] + 1) / yes) - math.log((r["n"] - r["yes"] + 1) / no) for r in sums.collect()}


def learn(findings: DataFrame) -> Learnt:
    """From labelled findings (candidate, before, path, label and, if given, after)."""
    f = findings if "after" in findings.columns else findings.withColumn("after", F.lit(""))
    around = F.concat(_near(F.col("before")), _near(F.col("after")))
    pairs = _odds(f, _transitions(F.col("candidate")), None)
    ordinary = f.where("label = 0").select(F.lit(0).alias("label"), F.filter(F.regexp_extract_all(F.lower(F.concat_ws(" ", F.regexp_replace("candidate", "(?<=[a-z])(?=[A-Z])", " "), "before", "after")), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3).alias("w"))
    said = _odds(ordinary, F.col("w"))
    return Learnt(_odds(f, around), _odds(f, _parts(F.col("path"))), [pairs.get(i, 0.0) for i in range(SYMBOLS**2)], sorted({w for w in DICTIONARY if len(w) > 3} | set(said), key=lambda w: (-len(w), w)))


def described(df: DataFrame, learnt: Learnt) -> DataFrame:
    """df with the columns candidate, before, path and, if it has it, after: FEATURES added."""
    c, before, after = F.col("candidate"), F.lower("before"), F.lower("after") if "after" in df.columns else F.lit("")
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / size
    classes = F.translate(c, "", "")
    for pattern, name in (("[0-9]", "0"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[^0Aa]", "-")):
        classes = F.regexp_replace(classes, pattern, name)
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)).otherwise(0.0)
    path = F.lower(F.coalesce(F.col("path"), F.lit("")))
    # The odds of every word around, once, as the row of a generator; what follows reads them.
    said = lambda words, odds: F.transform(words, lambda w: F.try_element_at(F.create_map(*[F.lit(x) for pair in (odds or {"": 0.0}).items() for x in pair]), w))
    n_before, n_all = F.size(_near(before)), F.concat(_near(before), _near(after))
    df = df.select(*df.columns, F.inline(F.array(F.struct(n_before.alias("_n"), said(n_all, learnt.words).alias("_said"), said(_parts(path), learnt.paths).alias("_parts")))))
    known = lambda c: mean(F.filter(c, lambda x: x.isNotNull()))
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("_said", i)), F.lit(0.0))
    pair = F.array(*[F.lit(float(x)) for x in learnt.transitions])
    named = lambda names: path.rlike(rf"(?<![a-z])(?:{names})(?![a-z])").cast("double")
    return df.withColumns({
        "length": size, "changes": (F.length(runs) - 1) / size, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "marks": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / size, "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "transitions": mean(F.transform(_transitions(c), lambda i: F.get(pair, i))), "covered": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(learnt.dictionary), "")) / size,
        "nearest": at(F.col("_n") - 1), "next": at(F.col("_n")), "around": known("_said"), "path_odds": known("_parts"),
        "test_path": named("tests?|spec|examples?|samples?|fixtures?|mocks?|demo"), "text_path": named("docs?|md|rst|txt|html"), "settings_path": named("ya?ml|env|json|toml|ini|cfg|conf|config|properties|settings"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"), "quoted": before.rlike(r"[\"'`]$").cast("double"), "in_url": (before.rlike(r"://[^\s/:@]*:$") & after.startswith("@")).cast("double"),
    }).drop("_n", "_said", "_parts")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, path, label) made by rule: n findings, half of them secrets. Numbers, hashes under their names, identifiers of
    dictionary words, placeholders, types and encoded words are the others."""
    words = F.array(*[F.lit(w) for w in DICTIONARY])
    word = lambda k: F.initcap(F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int")))
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(names))) + 1).cast("int"))
    hexed = F.sha2(F.concat(F.lit("f"), F.col("id")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[/+=]", "x")
    digits = F.regexp_replace(F.concat(F.abs(F.xxhash64("id")), F.abs(F.xxhash64("id", F.lit(9)))), "^", "4")
    secret = pick(1, *ANNOUNCES)
    other = pick(2, *DENIES)
    letters = F.translate(F.regexp_replace(F.base64(F.unhex(hexed)), "[/+=]", ""), "0123456789", "qWjKzXvBpG")
    mark = pick(13, "!", ".", "@", "&", ":", "")
    in_text = pick(12, '"', "'", " ", "", " and more", ", next")
    kinds = [
        (F.substring(hexed, 1, 40), F.concat(secret, pick(3, ' = "', "=", ": ", ": '")), 1),
        (F.substring(mixed, 1, 24), F.concat(secret, pick(3, ' = "', "=", ": ", " ")), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(hexed, 1, 16))), F.concat(word(4), pick(3, ' = "', "=", " ", ": ")), 1),
        (F.substring(hexed, 1, 32), F.concat(word(4), F.lit(" "), secret, pick(3, ' = "', ":", "='", " is ")), 1),
        (F.substring(hexed, 1, 40), F.concat(other, pick(3, " ", ": ", "=", "-")), 0),
        (F.concat(F.lower(word(5)), word(6), word(7), F.lit("2")), F.concat(word(8), pick(3, " ", "(", " = ", ".")), 0),
        (F.substring(digits, 1, 16), F.concat(word(8), pick(3, " ", ": ", ", ", " ")), 0),
        (F.concat(F.lit("your_"), F.lower(word(5)), F.lit("_here_123456")), F.concat(secret, pick(3, ' = "', "=", ": ", ": '")), 0),
        (F.concat(F.substring(mixed, 1, 5), mark, F.substring(mixed, 6, 5)), F.concat(secret, pick(3, ' = "', "=", ": ", ": '")), 1),
        (F.substring(letters, 1, 20), F.concat(secret, pick(3, ' = "', "=", ": ", ": '")), 1),
        (F.concat(F.substring(mixed, 2, 4), mark, F.substring(letters, 1, 5)), F.concat(F.lower(word(4)), F.lit("://"), F.lower(word(5)), F.lit(":")), 1),
        (F.concat(F.lower(F.substring(mixed, 3, 3)), mark, F.lower(F.substring(mixed, 7, 4))), F.concat(F.lower(word(4)), F.lit("://"), F.lower(word(5)), F.lit(":")), 1),
        (F.lower(word(5)), F.concat(secret, pick(3, ' = "', "=", ": ", " = ")), 0),
        (F.concat(F.lower(word(5)), pick(6, ".", "_", "(", " "), F.lower(word(7))), F.concat(secret, pick(3, ' = "', "=", ": ", " = ")), 0),
        # Hard ones: what a word announces and another one explains, ids and types under announcing words, secrets under words that announce nothing.
        (F.substring(hexed, 1, 40), F.concat(secret, F.lit(" "), pick(3, "for", "of", "in", "after"), F.lit(" "), other, pick(14, " ", ": ")), 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), F.concat(secret, pick(3, "_id: ", " request id ", " uuid=", "_ref = ")), 0),
        (F.substring(hexed, 1, 40), F.concat(pick(15, "my", "the", "our", "your", "this"), F.lit(" "), pick(16, "key", "pass", "pin", "cookie", "session", "code"), pick(3, " is ", ": ", " = ", " was ")), 1),
        (F.concat(F.lower(word(5)), F.substring(digits, 2, 3), F.lower(word(6)), F.substring(digits, 6, 2)), F.concat(secret, pick(3, " is ", " was ", ": ", " = ")), 1),
        (F.substring(hexed, 1, 64), F.concat(pick(16, "file", "layer", "package", "image", "blob"), F.lit(" "), other, pick(3, "=", ":", " = ", ": ")), 0),
        (F.substring(hexed, 1, 40), F.concat(word(8), pick(3, " ", ": ", " = ", ' = "')), 0),
    ]
    # What follows: the host of a URL, and for the last kind a word that says what the string is.
    in_url = (F.col("id") % len(kinds)).isin(10, 11)
    follows = F.when(in_url, F.concat(F.lit("@"), F.lower(word(7)), F.lit(".com"))).when(F.col("id") % len(kinds) == len(kinds) - 1, F.concat(F.lit(" "), other)).otherwise(in_text)
    rows = F.array(*[F.struct(c.alias("candidate"), b.alias("before"), F.lit(y).alias("label")) for c, b, y in kinds])
    made = spark.range(n).select("id", F.inline(F.array(F.element_at(rows, (F.col("id") % len(kinds) + 1).cast("int")))), follows.alias("after"))
    before = F.when(in_url, F.col("before")).otherwise(F.concat(F.lower(word(11)), F.lit(" "), F.col("before")))
    # Secrets lie in settings and code more often than in tests and documents.
    path = F.when(F.col("label") == 1, pick(10, "src/main.py", "config/settings.yaml", "deploy/prod.env", "tests/test_api.py", "web/app.js")).otherwise(pick(17, "src/main.py", "docs/intro.md", "tests/test_api.py", "go.sum", "web/app.js"))
    # Written once: what reads it again and again would make every finding anew, in each of its conditions.
    return common.Scratch(spark, "findings").save(made.select("candidate", before.alias("before"), "after", path.alias("path"), "label"))


def candidates(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, path, start, end, candidate, before, after); code points, end exclusive."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    form = F.lit(_FORM)
    one = docs.select("doc_id", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("path"), t.alias("t"))
    some = (F.col("t").rlike("[0-9]") & F.col("t").rlike(r"[A-Za-z0-9_+/.-]{16}")) | F.col("t").rlike(_NAME) | F.col("t").rlike(_URL)
    one = one.select("doc_id", "path", "t", F.when(some, F.arrays_zip(F.regexp_extract_all("t", form, F.lit(1)).alias("gap"), F.regexp_extract_all("t", form, F.lit(4)).alias("hit"))).otherwise(F.array().cast("array<struct<gap:string,hit:string>>")).alias("found"))
    none = F.array().cast("array<struct<start:int,whole:string,quoted:boolean>>")
    after = lambda acc, x: acc["at"] + F.length(x["gap"])
    one_more = lambda acc, x: F.struct(after(acc, x).alias("start"), x["hit"].alias("whole"), x["gap"].rlike(r"[\"'`]\z").alias("quoted"))
    step = lambda acc, x: F.struct((after(acc, x) + F.length(x["hit"])).alias("at"), F.array_append(acc["out"], one_more(acc, x)).alias("out"))
    placed = one.select("doc_id", "path", "t", F.inline(F.aggregate("found", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])))
    cut = placed.select("doc_id", "path", "t", "start", F.when(F.col("quoted"), F.col("whole")).otherwise(F.regexp_replace("whole", r"[,;.)\]}>]+\z", "")).alias("candidate")).where("candidate <> ''")
    return cut.selectExpr("doc_id", "path", "start", "start + length(candidate) as end", "candidate", f"substring(t, greatest(start - {BEFORE}, 0) + 1, least(start, {BEFORE})) as before", f"substring(t, start + length(candidate) + 1, {BEFORE}) as after")


def _fold(n: int) -> Column:
    """A number below n that a finding's own text gives."""
    return F.pmod(F.xxhash64("candidate", "before"), F.lit(n))


def train(findings: DataFrame):
    """(Learnt, forest) from labelled findings: odds from one half, the forest from the other."""
    learnt = learn(findings.where(_fold(2) == 0))
    rows = described(findings.where(_fold(2) == 1), learnt)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", F.col("label").cast("double").alias("label"))
    return learnt, RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def scored(rows: DataFrame, model) -> DataFrame:
    """rows (candidate, before, after, path) with `probability`."""
    learnt, forest = model
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(rows, learnt))
    return forest.transform(vectors).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, F.col("p").alias("probability"))


def held_out(findings: DataFrame, folds: int = 5) -> dict[str, float]:
    """Precision and recall on one fold in `folds` of labelled findings, of a model that the others trained."""
    known = findings if "after" in findings.columns else findings.withColumn("after", F.lit(""))
    fold = F.pmod(F.xxhash64("before", "candidate", F.lit("fold")), F.lit(folds)) == 0
    rows = scored(known.where(fold).select("candidate", "before", "after", "path", "label"), train(known.where(~fold)))
    yes = F.col("probability") >= THRESHOLD
    r = rows.agg(F.count_if(yes & (F.col("label") == 1)).alias("hit"), F.count_if(yes).alias("said"), F.count_if(F.col("label") == 1).alias("true")).first()
    return {"precision": r.hit / max(1, r.said), "recall": r.hit / max(1, r.true)}


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, start, end, candidate, probability, is_secret) of every candidate."""
    known = labelled_findings(docs.sparkSession) if findings is None else findings
    labels = [r[0] for r in known.select("label").distinct().limit(2).collect()]
    rows = candidates(docs, text, source)
    rows = scored(rows, train(known)) if len(labels) == 2 else rows.withColumn("probability", F.lit(float(labels[0]) if labels else 0.5))
    return rows.select("doc_id", "start", "end", "candidate", "probability", (F.col("probability") >= THRESHOLD).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret")
