"""Words of captions and titles, and texts freed of markup and escapes, as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import STABLE, casefolded

# Contractions that don't keep their word whole, and endings that leave the word that counts.
CONTRACTIONS = {"can't": "can", "shan't": "shall", "won't": "will"}
ENDINGS = ("'d", "'ll", "'m", "'re", "'s", "'ve")

# Words that stay in lower case within a title.
MINOR = "a an and as at but by for from in into nor of on or per the to via with without within through over under about against along before after between among amid despite onto than toward towards upon versus vs yet if so while when".split()

# References that stand for a character which no word holds.
ENTITIES = "amp apos gt lt nbsp quot".split()


def tokens(text: Column) -> Column:
    """Spoken words, casefolded, with one apostrophe inside; labels in square brackets are none. A word with letters of another script than
    Latin counts letter by letter."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", " "), "’", "'")
    found = F.regexp_extract_all(casefolded(plain), F.lit(r"[\p{L}\p{Lm}]+(?:'[\p{L}\p{Lm}]+)?"), F.lit(0))
    foreign = lambda w: F.regexp_replace(w, r"[\p{IsLatin}']", "") != ""
    return F.flatten(F.transform(found, lambda w: F.when(foreign(w), F.regexp_extract_all(w, F.lit(r"\p{L}"), F.lit(0))).otherwise(F.array(w))))


def dictionary_forms(word: Column) -> Column:
    """What a word may stand under in a dictionary: itself, and without a contraction or possessive ending. A left semi join on these decides."""
    odd = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    ending = F.regexp_extract(word, rf"^(.*)(?:{'|'.join(ENDINGS)})$", 1)
    bare = F.when(odd[word].isNotNull(), odd[word]).when(word.endswith("n't"), F.regexp_replace(word, "n't$", "")).when(ending != "", ending)
    return F.array_compact(F.array(word, bare))


def in_title_case(title: Column) -> Column:
    """Whether every word begins with a capital or a digit, but for short joining words inside."""
    w = F.filter(F.split(title, r"[\s–—]+"), lambda x: x != "")
    good = F.transform(w, lambda x, i: ((i > 0) & (i < F.size(w) - 1) & x.isin(*MINOR)) | x.rlike(r"^[^\p{L}]*[\p{Lu}\p{N}]"))
    return (F.size(w) > 0) & F.forall(good, lambda x: x)


def to_title_case(title: Column) -> Column:
    """Words of a title with a capital first letter, short joining words inside in lower case; spaces and dashes stay."""
    w = F.regexp_extract_all(F.trim(title), F.lit(r"[^\s–—]+|[\s]+|[–—]"), F.lit(0))
    is_word = lambda x: x.rlike(r"[^\s–—]")
    n = F.size(F.filter(w, is_word))
    place = F.aggregate(w, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + is_word(x).cast("int")))
    capital = lambda x: F.concat(F.regexp_extract(x, r"^([^\p{L}]*)", 1), F.upper(F.regexp_extract(x, r"^[^\p{L}]*(\p{L}?)", 1)), F.regexp_extract(x, r"^[^\p{L}]*\p{L}?(.*)$", 1))
    return F.array_join(F.zip_with(w, place, lambda x, k: F.when(~is_word(x), x).when((k > 1) & (k < n) & F.lower(x).isin(*MINOR), F.lower(x)).otherwise(capital(x))), "")


#: Everything that stands for another character or for none, each as one alternative.
_ESCAPES = re.compile(rf"\\u(?P<u>[0-9a-fA-F]{{4}})|\\x(?P<x>[0-9a-fA-F]{{2}})|&#[xX](?P<h>[0-9a-fA-F]+);|&#(?P<d>\d+);|&(?:{'|'.join(ENTITIES)});|<[^>]*>|\\[nrt]")


def _character(m: re.Match) -> str:
    kind = m.lastgroup
    code = int(m[kind], 10 if kind == "d" else 16) if kind else 0x110000
    return chr(code) if code <= 0x10FFFF else " "


def _unescaped(value: str) -> str:
    """An escape may spell out part of another one, so passes go on until one finds nothing."""
    found = 1
    while found:
        value, found = _ESCAPES.subn(_character, value)
    # Surrogates that were written as two escapes become their character.
    return unicodedata.normalize("NFKC", value.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


@F.pandas_udf(StringType())
def _unescape(column: pd.Series) -> pd.Series:
    return column.map(_unescaped, na_action="ignore")


def unescaped(text: Column) -> Column:
    r"""A text without \uXXXX, \xNN, character references and tags, NFKC: as a reader sees it. Texts without any of these, of characters that NFKC leaves alone, go to
    Python as nulls and so stay in the JVM."""
    return F.coalesce(_unescape(F.when(text.rlike(rf"[^{STABLE}]|\\[uxnrt]|&|<"), text)), text)


def issue_title(text: Column) -> Column:
    """A title that neither HTML nor Markdown changes: control characters become spaces, marks are escaped."""
    plain = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    return F.regexp_replace(plain, r"([\\`*_{}\[\]()#!|])", r"\\$1")


def book(reference: Column) -> Column:
    """The book of a reference: what stands before its numbers."""
    return F.regexp_replace(reference, r"(?s)\s+\d.*$", "")


def book_id(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "-")


def watch_url(base: str, recording: Column, start: Column, focus: Column | None = None) -> Column:
    """The address of a moment of a recording; a start of 0 and below isn't named."""
    at = F.when(start > 0, F.concat(F.lit("t="), F.floor(start).cast("string")))
    parts = [F.concat(F.lit("r="), F.url_encode(recording)), at] + ([F.concat(F.lit("focus="), F.url_encode(focus))] if focus is not None else [])
    return F.concat(F.lit(f"{base}watch/?"), F.concat_ws("&", *parts))


def watch_target(url: Column) -> Column:
    """(recording, start, focus) that an address names; a start that isn't a plain number is none."""
    asked = lambda key: F.nullif(F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key))), F.lit(""))
    start = asked("t")
    return F.struct(asked("r").alias("recording"), F.when(start.rlike(r"^\d+(?:\.\d+)?$"), start.cast("double")).alias("start"), asked("focus").alias("focus"))
