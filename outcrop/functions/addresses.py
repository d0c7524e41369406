"""Addresses of pages, and checks of addresses and names that others give, as Spark columns: null where a value isn't accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(value: Column) -> Column:
    """A part of a path: spaces as %20, and the marks that need no escape as they are."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def base_path(base: Column) -> Column:
    """`/a/b/` of a deployment root, `/` of an empty one; null where a part has other characters than letters, digits, - and _."""
    parts = F.filter(F.split(base, "/"), lambda x: x != "")
    path = F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))).otherwise("/")
    return F.when(F.forall(parts, lambda x: x.rlike("^[A-Za-z0-9_-]+$")), path)


def site_url(base: Column, path: Column) -> Column:
    return F.concat(base_path(base), F.regexp_replace(path, "^/+", ""))


def search_url(base: Column, query: Column) -> Column:
    q = F.trim(F.coalesce(query, F.lit("")))
    return F.concat(site_url(base, F.lit("search/")), F.when(q != "", F.concat(F.lit("?q="), F.url_encode(q))).otherwise(""))


def browse_url(base: Column, path: Column) -> Column:
    parts = F.array_join(F.transform(F.split(path, "/"), encoded), "/")
    return F.concat(site_url(base, F.lit("browse/")), F.when(path != "", F.concat(parts, F.lit("/"))).otherwise(""))


def service_url(base: Column, recording: Column) -> Column:
    return F.concat(site_url(base, F.lit("services/")), encoded(recording), F.lit("/"))


def edit_url(base: Column, recording: Column, start: Column) -> Column:
    at = F.when(start > 0, F.concat(F.lit("?t="), F.floor(start).cast("string"))).otherwise("")
    return F.concat(site_url(base, F.lit("edit/")), encoded(recording), F.lit("/"), at)


def youtube_url(video: Column, start: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), F.url_encode(video), F.lit("&t="), F.greatest(F.lit(0), F.floor(F.coalesce(start, F.lit(0)))).cast("string"))


def scripture_url(canonical: Column) -> Column:
    return F.concat(F.lit("https://www.esv.org/"), encoded(canonical), F.lit("/"))


def repository_url(value: Column) -> Column:
    """A public repository's plain address, without a last slash or .git."""
    form = r"^https://github\.com/([A-Za-z0-9][A-Za-z0-9-]*)/([A-Za-z0-9_.-]+)/?$"
    name = F.regexp_replace(F.regexp_extract(value, form, 2), r"\.git$", "")
    return F.when(value.rlike(form) & ~name.isin("", ".", ".."), F.concat(F.lit("https://github.com/"), F.regexp_extract(value, form, 1), F.lit("/"), name))


def correction_url(value: Column) -> Column:
    """A mail address or an https address without a user."""
    mail = value.rlike(r"^mailto:[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    web = value.rlike(r"^(?i)https://[^/?#@:\[\]]+(?::\d+)?(?:[/?#]|$)")
    return F.when(~value.rlike(r"[\s\\]|(?i)%0[ad]") & (mail | web), value)


def source_ref(value: Column) -> Column:
    """A branch or commit name as git takes it."""
    marks = value.rlike(r"[\s~^:?*\[\\\x00-\x1f\x7f]")
    part = F.exists(F.split(value, "/"), lambda p: (p == "") | p.startswith(".") | p.endswith(".") | p.endswith(".lock"))
    return F.when(~(value.isin("", "HEAD", "@") | marks | value.contains("..") | value.contains("@{") | value.startswith("-") | part), value)
