"""Passage references as intervals: parse, canonical form, overlap, coverage, mentions in prose.

Verse counts are data, {book: [verses of chapter 1, 2, ...]}; sources.archive.verse_counts() derives them from a verse table.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The books in order, with the short names by which they are cited.
BOOKS = [line.split(",") for line in """\
Genesis,Gen,Ge,Gn
Exodus,Exod,Ex,Exo
Leviticus,Lev,Le,Lv
Numbers,Num,Nu,Nm,Nb
Deuteronomy,Deut,Dt,Deu
Joshua,Josh,Jos
Judges,Judg,Jdg,Jdgs
Ruth,Rth,Ru
1 Samuel,1 Sam,1 Sa,1 Sm
2 Samuel,2 Sam,2 Sa,2 Sm
1 Kings,1 Kgs,1 Ki
2 Kings,2 Kgs,2 Ki
1 Chronicles,1 Chron,1 Chr,1 Ch
2 Chronicles,2 Chron,2 Chr,2 Ch
Ezra,Ezr
Nehemiah,Neh,Ne
Esther,Esth,Est
Job,Jb
Psalms,Psalm,Ps,Psa,Pss
Proverbs,Prov,Pr,Prv
Ecclesiastes,Eccl,Eccles,Ecc
Song of Solomon,Song of Songs,Song,Songs,SOS,Canticles,Cant
Isaiah,Isa,Is
Jeremiah,Jer,Je,Jr
Lamentations,Lam,La
Ezekiel,Ezek,Eze,Ezk
Daniel,Dan,Da,Dn
Hosea,Hos,Ho
Joel,Jl
Amos,Am
Obadiah,Obad,Ob
Jonah,Jon,Jnh
Micah,Mic,Mi
Nahum,Nah,Na
Habakkuk,Hab,Hb
Zephaniah,Zeph,Zep
Haggai,Hag,Hg
Zechariah,Zech,Zec,Zc
Malachi,Mal,Ml
Matthew,Matt,Mt
Mark,Mk,Mrk
Luke,Lk,Luk
John,Jn,Jhn
Acts,Ac
Romans,Rom,Ro,Rm
1 Corinthians,1 Cor,1 Co
2 Corinthians,2 Cor,2 Co
Galatians,Gal,Ga
Ephesians,Eph,Ephes
Philippians,Phil,Php,Pp
Colossians,Col,Co
1 Thessalonians,1 Thess,1 Thes,1 Th
2 Thessalonians,2 Thess,2 Thes,2 Th
1 Timothy,1 Tim,1 Ti
2 Timothy,2 Tim,2 Ti
Titus,Tit,Ti
Philemon,Philem,Phlm,Phm
Hebrews,Heb
James,Jas,Jm
1 Peter,1 Pet,1 Pe,1 Pt
2 Peter,2 Pet,2 Pe,2 Pt
1 John,1 Jn,1 Jhn
2 John,2 Jn,2 Jhn
3 John,3 Jn,3 Jhn
Jude,Jud
Revelation,Rev,Re,Rv,Revelations,Apocalypse""".split("\n")]  # fmt: skip

NAMES = [b[0] for b in BOOKS]
_ROMAN = {"1": "i", "2": "ii", "3": "iii"}
TYPE = "struct<canonical:string,book:string,lo:int,hi:int>"


def _key(name: str) -> str:
    return re.sub(r"[.\s]", "", unicodedata.normalize("NFKC", name).lower())


_ALIASES = {_key(form): b[0] for b in BOOKS for name in b for form in (name, _ROMAN.get(name[0], name[0]) + name[1:])}


def book_of(name: str) -> str | None:
    return _ALIASES.get(_key(name))


@dataclass(frozen=True)
class Reference:
    """A passage; lo and hi number its first and last verse within the book."""

    canonical: str
    book: str
    lo: int
    hi: int


_NUMBERS = r"([1-9]\d*)(?:\s*:\s*([1-9]\d*))?(?:\s*-\s*([1-9]\d*)(?:\s*:\s*([1-9]\d*))?)?"
_WHOLE = re.compile(rf"(.*?)\s*{_NUMBERS}")


def _built(book: str, numbers: tuple, counts: dict[str, list[int]]) -> Reference | None:
    chapter, verse, second, third = (int(x) if x else None for x in numbers)
    if third and not verse:
        return None
    # What the number after the dash is: with a verse of its own a chapter, after a verse a verse, else a chapter.
    last_chapter = second if third or (second and not verse) else chapter
    sizes = counts.get(book, [])
    if not (chapter <= len(sizes) and last_chapter <= len(sizes)):
        return None
    first, last = verse or 1, third or (second if verse and second else verse) or sizes[last_chapter - 1]
    if first > sizes[chapter - 1] or last > sizes[last_chapter - 1] or (chapter, first) > (last_chapter, last):
        return None
    name = f"{book} {chapter}" + (f":{verse}" if verse else "")
    if third:
        name += f"-{last_chapter}:{third}" if last_chapter > chapter else f"-{third}" if third != verse else ""
    elif second and second != (verse or chapter):
        name += f"-{second}"
    return Reference(name, book, sum(sizes[: chapter - 1]) + first, sum(sizes[: last_chapter - 1]) + last)


def parse(text: str | None, counts: dict[str, list[int]]) -> Reference | None:
    """One whole reference, or None."""
    m = _WHOLE.fullmatch(unicodedata.normalize("NFKC", text or "").translate({0x2013: "-", 0x2014: "-"}).strip())
    book = m and book_of(m[1])
    return _built(book, m.groups()[1:], counts) if book else None


# Names that are also words of the language, so that in lower case they aren't references.
COMMON = frozenset("acts cant job judges mark numbers song songs".split())
_MENTION = re.compile(rf"(?<![^\W_])((?:[1-3]\s*|i{{1,3}}\s+)?[^\W\d_]+\.?(?:\s+of\s+[^\W\d_]+)?)\s*{_NUMBERS}(?![\w])", re.I)


def mentions(text: str | None, counts: dict[str, list[int]]) -> list[Reference]:
    """References within prose, in order. A book's number is never taken from the reference before it."""
    value = unicodedata.normalize("NFKC", text or "").translate({0x2013: "-", 0x2014: "-"})
    out, at = [], 0
    while m := _MENTION.search(value, at):
        at = m.end()
        name = m[1].strip(" .")
        if (book := book_of(m[1])) is None:
            name = re.sub(r"^(?:[1-3]\s*|[iI]{1,3}\s+)", "", name)  # a number before the name that isn't the book's
            book = book_of(name)
        if book is None:
            at = m.end(1)  # the number may belong to the name that follows
            continue
        if name == name.lower() and (len(name) < 4 or name in COMMON):
            continue
        if reference := _built(book, m.groups()[1:], counts):
            out.append(reference)
    return out


def parse_udf(counts: dict[str, list[int]]):
    """A column of reference strings to structs (null where it is none). Used when tables are built, not in queries."""

    @F.pandas_udf(TYPE)
    def f(column: pd.Series) -> pd.DataFrame:
        found = [parse(x, counts) for x in column]
        return pd.DataFrame([(r.canonical, r.book, r.lo, r.hi) if r else (None,) * 4 for r in found], columns=["canonical", "book", "lo", "hi"]).astype({"lo": "Int32", "hi": "Int32"})

    return f


def mentions_udf(counts: dict[str, list[int]]):
    """A column of arrays of texts to the references that each of them mentions by itself."""

    @F.pandas_udf(f"array<{TYPE}>")
    def f(column: pd.Series) -> pd.Series:
        return column.map(lambda fields: [{"canonical": r.canonical, "book": r.book, "lo": r.lo, "hi": r.hi} for x in fields for r in mentions(x, counts)])

    return f


def overlaps(references: Column, book, lo, hi) -> Column:
    """Whether any of an array of references shares a verse with a passage."""
    return F.exists(references, lambda r: (r["book"] == book) & (r["lo"] <= hi) & (r["hi"] >= lo))


def coverage(spans: Column, lo: Column, hi: Column) -> Column:
    """The share of whole positions lo to hi that lie in any of an array of spans (lo, hi), each position once."""
    inside = F.filter(F.transform(spans, lambda s: F.struct(F.greatest(s["lo"], lo).alias("lo"), F.least(s["hi"], hi).alias("hi"))), lambda s: s["lo"] <= s["hi"])
    start = F.struct(F.lit(0).cast("bigint").alias("n"), (lo - 1).cast("bigint").alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["hi"] - F.greatest(s["lo"] - 1, acc["upto"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(acc["upto"], s["hi"]).cast("bigint").alias("upto"))
    return F.aggregate(F.sort_array(inside), start, step, lambda acc: acc["n"] / (hi - lo + 1))
