"""Words, stems and padded phrases, as Spark columns and, for a query string on the driver, in plain Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no topic. Negations and "only" aren't among them.
STOP_WORDS = frozenset("a about above after again all am an and any are as at be because been before being below between both by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself now of off on once or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up us very was we were what when where which while who whom why with would you your yours yourself yourselves".split())
QUALIFIERS = ("no", "not", "never", "only")


@F.pandas_udf(StringType())
def nfkc(column: pd.Series) -> pd.Series:
    """NFKC with every white-space run one space. Spark has no normaliser; call it once when an index is built."""
    return column.map(nfkc_text, na_action="ignore")


def nfkc_text(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).replace("﻿", " ").split())


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(column: pd.Series) -> pd.Series:
    return column.map(lambda values: [v if v is None else nfkc_text(v) for v in values], na_action="ignore")


#: Letters and marks that NFKC leaves as they are, beside ASCII: most of what Latin texts are written in.
BEYOND = r"\u00A1\u00AB\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
STABLE = r"\x00-\x7F" + BEYOND
#: A character that isn't among these. ASCII is told apart first: a class of many ranges is slow, and most characters need one of them.
UNSTABLE = rf"[[^\x00-\x7F]&&[^{BEYOND}]]"


def normalised(texts: Column) -> Column:
    """An array of texts, each in NFKC. Arrays that hold nothing NFKC could change go to Python as nulls, so their texts don't leave the JVM."""
    return F.coalesce(_nfkc_all(F.when(F.exists(texts, lambda v: (F.octet_length(v) != F.length(v)) & v.rlike(UNSTABLE)), texts)), texts)


@F.pandas_udf(StringType())
def _casefold(column: pd.Series) -> pd.Series:
    return column.map(str.casefold, na_action="ignore")


def casefolded(text: Column) -> Column:
    """A text without differences of case. In most Latin letters that is lower case; texts with others go to Python."""
    return F.coalesce(_casefold(F.when(text.rlike(f"[^{STABLE}]|ß"), text)), F.lower(text))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: A light English stemmer for words of four or more letters a-z, as patterns that are replaced one after another: plural -ies and -s, then -ing and -ed
#: after a vowel, together with the second of two equal letters before it, then a last -e.
STEMMED = "^[a-z]{4,}$"
STEPS = (("ies$", "y"), ("(?<![sui])s$", ""), ("^(?=.*[aeiouy].*(?:ing|ed)$)(.*?)(?:(?<=([bdgmnprt]))\\2)?(?:ing|ed)$", "$1"), ("^(.{3,})e$", "$1"))

#: No step begins with a word that ends otherwise.
LAST = ("s", "g", "d", "e")


def stem(word: Column) -> Column:
    out = word
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(word.rlike(STEMMED), out).otherwise(word)


def stem_word(word: str) -> str:
    if word[-1:] in LAST and re.search(STEMMED, word):
        for pattern, by in STEPS:
            word = re.sub(pattern, by.replace("$", "\\"), word)
    return word


def words_of(term: str) -> list[str]:
    """Every word of which stem_word() makes a term: the steps undone from the last, each if it was taken."""
    before = [term, f"{term}e"]
    before += [f"{x}{double}{end}" for x in before for double in {"", x[-1:]} for end in ("ing", "ed")]
    before += [f"{x}s" for x in before]
    before += [f"{x[:-1]}ies" for x in before if x.endswith("y")]
    return [x for x in before if stem_word(x) == term]


def padded(text: Column) -> Column:
    """The stems of a text between single spaces, so that a word or phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words(text), stem), " "), F.lit(" "))


def query_words(query: str) -> list[str]:
    """As words(), on the driver."""
    out, run = [], []
    for c in nfkc_text(query).lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units below 2**16, as a long."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))
