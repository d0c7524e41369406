"""Checks of what is published: budgets, sizes, checksums, links, names and contents that mustn't be there, line differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files and contents that are never published.
MEDIA = "mp4 mkv webm mp3 wav m4a ogg opus flac json3 vtt srt ttml onnx gguf part bin".split()
FORBIDDEN = rf"(?i)(?:^|/)(?:\.env(?:\..+)?|\.local|node_modules|cookies?(?:\..+)?|media-authorization\.json|[^/]+\.(?:{'|'.join(MEDIA)}))$"
PRIVATE_FOLDERS = r"^(?:\.local|node_modules|site/public/(?:generated|models|onnx))/"
RECORDING_FILE = r"^services/\d{4}-\d{2}-\d{2}(?:-\d+)?\.yaml$"
CREDENTIAL = r"-----BEGIN (?:OPENSSH|RSA|EC|DSA) PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}"


def budget(operator: Column, value: Column, limit: Column) -> Column:
    """pass or fail, or unsupported where nothing could be measured."""
    ok = F.when(operator == "<", value < limit).when(operator == "==", value == limit).otherwise(value <= limit)
    return F.when(value.isNull(), "unsupported").when(ok, "pass").otherwise("fail")


def forbidden(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, problem) of files that mustn't be published, by name or by content."""
    p = F.col(path)
    private = p.rlike(FORBIDDEN) | p.rlike(PRIVATE_FOLDERS)
    stray = p.startswith("services/") & ~p.rlike(RECORDING_FILE)
    problem = F.when(private, "private, media or cache file").when(stray, "no recording file").when(F.col(content).rlike(CREDENTIAL), "credential")
    return files.select(path, problem.alias("problem")).where("problem is not null")


def sizes(files: DataFrame, by: str, content: str) -> DataFrame:
    """(by, files, bytes): what each group of artifacts takes."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(F.coalesce(F.col(content), F.lit("")))).alias("bytes"))


def unbound(metadata: DataFrame, artifacts: DataFrame, key: str, content: str) -> DataFrame:
    """(key, problem) of artifacts that aren't what their metadata (key, sha256, n_rows) says: the digest of their content, their number of lines."""
    own = artifacts.select(key, F.sha2(F.col(content), 256).alias("own_sha256"), F.size(F.split(content, "\n")).alias("own_rows"))
    problem = F.when(F.col("sha256").isNull(), "no metadata").when(F.col("own_sha256").isNull(), "no artifact").when(F.col("sha256") != F.col("own_sha256"), "another content").when(F.col("n_rows") != F.col("own_rows"), "another number of rows")
    return metadata.join(own, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def dead_links(pages: DataFrame, url: str, content: str, base: str) -> DataFrame:
    """(url, target) of links and sources under base that no page has as its address. Queries and fragments don't count."""
    found = pages.select(url, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']([^\"'#?]*)"), F.lit(1)))).alias("target"))
    there = pages.select(F.regexp_replace(url, "[#?].*$", "").alias("target")).distinct()
    return found.where(F.col("target").startswith(base)).join(there, "target", "left_anti").select(url, "target")


def _ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How long the longest common subsequences of x with each beginning of y are."""
    best = np.zeros(len(y) + 1, np.int32)
    for v in x:
        best[1:] = np.maximum.accumulate(np.maximum(np.where(y == v, best[:-1] + 1, 0), best[1:]))
    return best


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory of the length of b: a is halved, b is cut where both halves have most in common, and so on down."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if ie - i == 1:
            out += [(i, j + int(k)) for k in np.flatnonzero(b[j:je] == a[i])[:1]]
        elif ie - i > 1 and je > j:
            middle = (i + ie) // 2
            both = _ends(a[i:middle], b[j:je]) + _ends(a[middle:ie][::-1], b[j:je][::-1])[::-1]
            cut = j + int(both.argmax())
            todo += [(i, middle, j, cut), (middle, ie, cut, je)]
    return sorted(out)


def _diff(before: str, after: str, context: int) -> list[tuple[int, str, str]]:
    """(hunk, kind, line): what two texts have in common and not, removals before additions, as hunks: changes that are no more than twice the context apart, with that
    many lines around them."""
    a, b = before.split("\n"), after.split("\n")
    numbers = {x: n for n, x in enumerate(dict.fromkeys(a + b))}
    script, i, j = [], 0, 0
    for p, q in [*_common(*(np.array([numbers[x] for x in side]) for side in (a, b))), (len(a), len(b))]:
        script += [("removed", x) for x in a[i:p]] + [("added", x) for x in b[j:q]] + [("same", x) for x in a[p : p + 1]]
        i, j = p + 1, q + 1
    changed = np.array([k for k, (kind, _) in enumerate(script) if kind != "same"])
    rows = []
    for hunk, part in enumerate(np.split(changed, np.flatnonzero(np.diff(changed) > 2 * context + 1) + 1) if len(changed) else [], 1):
        rows += [(hunk, *line) for line in script[max(0, part[0] - context) : part[-1] + context + 1]]
    return rows


def line_diffs(pairs: DataFrame, key: str, before: str, after: str, context: int = 3) -> DataFrame:
    """(key, n, hunk, kind, line) of the changed regions of each pair of texts. A pair is a file, so it is compared in its task."""

    @F.pandas_udf("array<struct<hunk:int,kind:string,line:string>>")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[{"hunk": h, "kind": k, "line": x} for h, k, x in _diff(o or "", n or "", context)] for o, n in zip(old, new, strict=True)])

    changed = pairs.where(~F.col(before).eqNullSafe(F.col(after)))
    return changed.select(key, F.posexplode(diff(before, after)).alias("n", "x")).select(key, "n", "x.*")
